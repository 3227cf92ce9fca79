"""The snapshot holds all four projections, row for row as their own queries give them."""

import json

from postmill import queries


def test_snapshot_is_whole(spark, sf_dir):
    rows = [(r.kind, json.loads(r.row)) for r in queries.replay_snapshot(spark, sf_dir).collect()]
    kind = lambda k: [x for own, x in rows if own == k]
    messages, found = kind("message"), kind("thread")
    fields = ("message_id", "account_id", "provider_id", "blob_id", "received_at")
    live = [r.asDict() for r in queries.replay_messages(spark, sf_dir).collect()]
    assert sorted(str([x.get(f) for f in fields]) for x in messages) == sorted(str([x[f] for f in fields]) for x in live) and live
    want = sorted((r.message_id, r.keyword) for r in queries.replay_keywords(spark, sf_dir).collect())
    assert sorted((x["message_id"], k) for x in messages for k in x.get("keywords", [])) == want
    threaded = [(x["account_id"], x["thread_id"]) for x in messages if "thread_id" in x]
    assert found and sum(x["message_count"] for x in found) == len(threaded)
    assert {(x["account_id"], x["thread_id"]) for x in found} == set(threaded)
    assert kind("mailbox") and kind("cursor")
