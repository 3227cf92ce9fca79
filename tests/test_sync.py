"""Convergence: whatever the user changes and however the provider fails, both sides end up equal."""

import json
import random

import pytest

from postmill.sources import change_feed
from postmill.sources.change_feed import FAULTS, ChangeFeed, Server
from postmill.streaming import sync


def mailbox(seed):
    server = Server(seed)
    for k in range(6):
        server.deliver(f"p{k}", ["$seen"] if k % 2 else [])
    return server


@pytest.mark.parametrize("seed", range(60))
def test_convergence(seed):
    r = random.Random(seed)
    server = mailbox(seed)
    engine = sync.Engine(server, page=3)
    engine.settle()
    for _ in range(r.randrange(7)):
        server.inject(r.choice(["*", "changes", "fetch", "apply"]), r.choice(FAULTS), times=r.randrange(1, 3), probability=r.choice([1.0, 0.5]))
    for k in range(r.randrange(1, 9)):
        op = r.choice(["keywords.change", "mailboxes.change", "message.destroy"])
        values = ["$flagged", "$seen"] if op == "keywords.change" else ["work", "inbox"]
        engine.change({"id": f"i{k}", "op": op, "provider_id": f"p{r.randrange(6)}", "add": r.sample(values, 1), "remove": r.sample(values, r.randrange(2))})
        if r.random() < 0.3:
            server.deliver(f"q{k}")
        if r.random() < 0.3:
            engine.settle(1)
    engine.settle()
    assert not engine.outstanding()
    assert engine.snapshot() == server.snapshot()


def test_no_double_effect_and_rejection():
    server = mailbox(1)
    engine = sync.Engine(server)
    engine.settle()
    server.inject("apply", "apply-then-fail")
    engine.change({"id": "i1", "op": "keywords.change", "provider_id": "p0", "add": ["$flagged"], "remove": []})
    engine.settle()
    assert engine.intents[0]["state"] == "settled" and engine.intents[0]["attempts"] == 2
    server.destroy("p1")
    engine.change({"id": "i2", "op": "keywords.change", "provider_id": "p1", "add": ["x"], "remove": []})
    engine.settle()
    assert engine.intents[1]["state"] == "rejected" and engine.snapshot() == server.snapshot()


def test_guard_budget():
    guard = sync.Guard()
    guard.expect("keywords", ["a"], [])
    stale = {"keywords": [], "mailboxes": []}
    assert [guard.believe(stale) for _ in range(sync.READ_BUDGET)] == [False] * (sync.READ_BUDGET - 1) + [True]
    guard.expect("keywords", [], ["a"])
    assert guard.believe(stale) and guard.satisfied


def test_change_feed_source(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [{"mod_seq": i, "kind": "created", "provider_id": f"p{i}"} for i in range(1, 8)]
    (feed / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(ChangeFeed)
    assert spark.read.format("mail_changes").option("cursor", 3).load(str(feed)).count() == 4
    q = (
        spark.readStream.format("mail_changes").option("page", 3).load(str(feed))
        .writeStream.format("memory").queryName("feed").option("checkpointLocation", str(tmp_path / "c")).start()
    )
    try:
        q.processAllAvailable()
        assert spark.table("feed").count() == 7
    finally:
        q.stop()


def test_guarded_stream(spark, tmp_path):
    schema = "provider_id string, at bigint, kind string, field string, keywords array<string>, mailboxes array<string>, add array<string>, remove array<string>"
    src = tmp_path / "reads"
    rows = [
        ("p1", 1, "expect", "keywords", [], [], ["a"], []), ("p1", 2, "read", "", [], [], [], []), ("p1", 3, "read", "", ["a"], [], [], []), ("p2", 1, "read", "", ["x"], [], [], []),
    ]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    q = (
        sync.guarded(spark.readStream.schema(schema).parquet(str(src)))
        .writeStream.format("memory").queryName("guarded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    )
    try:
        q.processAllAvailable()
        assert {(r.provider_id, r.at) for r in spark.table("guarded").collect()} == {("p1", 3), ("p2", 1)}
    finally:
        q.stop()


def test_provider_calls():
    s = Server(3)
    told = []
    stop = s.watch(told.append)
    for k in range(5):
        s.deliver(f"p{k}", raw=f"raw {k}".encode())
    assert told == ["messages"] * 5 and s.raw("p2") == b"raw 2"
    blob = s.upload(b"draft bytes")
    assert s.apply({"id": "d1", "op": "draft.save", "blob": blob, "mailbox": "inbox"}) == "applied" and s.messages["draft-d1"]["keywords"] == ["$draft"]
    assert s.apply({"id": "d2", "op": "draft.save", "blob": blob, "mailbox": "inbox", "replaces": "draft-d1"}) == "applied" and s.messages["draft-d1"]["destroyed"]
    assert s.apply({"id": "d3", "op": "draft.save", "blob": "none", "mailbox": "inbox"}) == "rejected"
    assert s.apply({"id": "b1", "op": "mailbox.create", "name": "New"}) == s.apply({"id": "b1", "op": "mailbox.create", "name": "New"}) == "applied"
    assert s.apply({"id": "b2", "op": "mailbox.rename", "mailbox": "box-b1", "name": "Newer"}) == "applied"
    assert [b["name"] for b in s.list_mailboxes()] == ["Inbox", "Newer"]
    assert s.apply({"id": "b3", "op": "mailbox.destroy", "mailbox": "box-b1"}) == "applied" and s.apply({"id": "b4", "op": "mailbox.destroy", "mailbox": "box-b1"}) == "rejected"
    assert s.apply({"id": "x", "op": "no such thing"}) == "rejected"
    s.inject("submit", "apply-then-fail")
    with pytest.raises(change_feed.Unreachable):
        s.submit("k", blob, "a@x", ["b@x"])
    assert s.submit("k", blob, "a@x", ["b@x"]) == "sent" and len(s.outbox) == 1 and s.submit("k2", blob, "a@x", []) == "rejected"
    s.destroy("p2")
    with pytest.raises(KeyError):
        s.raw("p2")
    with pytest.raises(ValueError):
        s.fetch([str(k) for k in range(501)])
    stop()
    n = len(told)
    s.deliver("p9")
    assert len(told) == n


def test_backfill_meets_every_message_once():
    s = Server(4)
    for k in range(11):
        s.deliver(f"p{k}")
    s.inject("backfill", "short-batch")
    seen, mark, done = [], None, False
    while not done:
        ids, mark, done = s.backfill(mark, 3)
        seen += ids
        s.deliver(f"new{len(seen)}")  # arrives above every watermark
    assert sorted(seen) == sorted(f"p{k}" for k in range(11))
    e = sync.Engine(s, 4)
    e.cursor = s.mod_seq  # begin now: only the backfill brings what was there
    e.settle()
    assert e.snapshot() == s.snapshot() and e.status()["backfilled"] and e.status()["phase"] == "idle"


def test_feed_reads_only_what_a_page_needs(spark, tmp_path):
    import json

    folder = tmp_path / "feed"
    folder.mkdir()
    for part in range(4):
        (folder / f"{part}.jsonl").write_text("".join(json.dumps({"mod_seq": 1 + part * 10 + k, "kind": "created", "provider_id": f"p{part}{k}"}) + "\n" for k in range(10)))
    feed = change_feed.Feed(str(folder))
    assert feed.last() == 40 and feed.page_end(0, 15) == 15 and feed.page_end(40, 5) == 40
    assert [(p.rsplit("/", 1)[1], a, b) for p, a, b in feed.parts(9, 21)] == [("0.jsonl", 9, 10), ("1.jsonl", 10, 20), ("2.jsonl", 20, 21)]
    spark.dataSource.register(ChangeFeed)
    got = spark.read.format("mail_changes").option("path", str(folder)).option("cursor", 12).load()
    assert sorted(r.mod_seq for r in got.collect()) == list(range(13, 41))
