"""Projections: rebuilding, following batches and dropping accounts come to the same tables."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from postmill.operators import event_log, projection
from postmill.schemas import EVENTS

NOW = datetime(2026, 10, 1, tzinfo=timezone.utc)
T0 = datetime(2026, 1, 1)


def entry(seq, account, type_, **payload):
    fields = ("message_id", "blob_id", "size", "provider_id", "received_at", "keywords", "mailbox_ids", "mailbox", "mailbox_id", "collection", "cursor")
    return (seq, account, T0 + timedelta(minutes=seq), "remote", type_, tuple(payload.get(f) for f in fields))


def observed(seq, account, k, blob=None, at=None):
    return entry(seq, account, "message.observed", message_id=f"m{k}", blob_id=blob or f"b{k}", provider_id=f"p{k}", received_at=T0 + timedelta(hours=at or k))


LOG = [
    entry(1, "a", "blob.stored", blob_id="b1", size=111), observed(2, "a", 1), entry(3, "a", "message.keywords.set", message_id="m1", keywords=["$seen", "x", "$seen"]),
    entry(4, "a", "mailbox.upserted", mailbox=("mb1", "Inbox", "inbox")), entry(5, "a", "message.mailboxes.set", message_id="m1", mailbox_ids=["mb1"]), observed(6, "a", 2),
    entry(7, "a", "sync.cursor.advanced", collection="messages", cursor="7"), observed(8, "b", 3), entry(9, "b", "message.removed", message_id="m3"),
    observed(10, "b", 4, blob="b1"), entry(11, "a", "mailbox.removed", mailbox_id="mb1"), observed(12, "a", 5), entry(13, "b", "message.removed", message_id="m4"),
    entry(14, "b", "sync.cursor.advanced", collection="messages", cursor="14"), observed(15, "a", 1, blob="b9"),
]


def raw(subject, own, parent=None):
    return (f"From: Ann <ann@x.test>\r\nTo: bob@x.test\r\nSubject: {subject}\r\nMessage-ID: <{own}@x>\r\n" + (f"In-Reply-To: <{parent}@x>\r\n" if parent else "") + "\r\ntext").encode()


BLOBS = [("b1", bytearray(raw("Plan", "1"))), ("b2", bytearray(raw("Re: Plan", "2", "1"))), ("b5", bytearray(raw("Else", "5"))), ("b9", bytearray(raw("Plan two", "1"))), ("b3", bytearray(b""))]


@pytest.fixture()
def data(spark):
    return spark.createDataFrame(LOG, EVENTS), spark.createDataFrame(BLOBS, "id string, bytes binary")


def state(p):
    out = {}
    for name in projection.TABLES:
        rows = p.read(name)
        out[name] = sorted(map(str, event_log.snapshot(rows, name, F.lit("x")).collect()))
    return out


def test_rebuild_apply_and_drop(spark, data, tmp_path):
    log, blobs = data
    whole = projection.Projection(spark, f"file://{tmp_path}/whole")
    whole.rebuild(log, blobs, NOW)
    m = {r.id: r for r in whole.read("messages").collect()}
    assert set(m) == {"m1", "m2", "m5"}  # m3 and m4 are gone
    assert m["m1"].subject == "Plan two" and m["m1"].blob_id == "b9" and m["m1"].size is None and m["m1"].keywords == ["$seen", "x"] and m["m1"].mailbox_ids == ["mb1"]
    assert m["m2"].thread_id == m["m1"].thread_id == "t:1@x" != m["m5"].thread_id and [a.address for a in m["m2"].from_addr] == ["ann@x.test"]
    t = {r.thread_id: r for r in whole.read("threads").collect()}
    assert t["t:1@x"].message_ids == ["m1", "m2"] and t["t:1@x"].participants == ["ann@x.test", "bob@x.test"]
    assert {(r.account_id, r.cursor) for r in whole.read("cursors").collect()} == {("a", "7"), ("b", "14")}

    steps = projection.Projection(spark, f"file://{tmp_path}/steps")
    steps.rebuild(log.filter("seq <= 6"), blobs, NOW)
    for low, high in ((6, 11), (11, 99)):
        new = log.filter((F.col("seq") > low) & (F.col("seq") <= high))
        steps.apply(log.filter(F.col("seq") <= high), new, blobs, NOW)
    assert state(steps) == state(whole)

    steps.drop("a")
    assert steps.read("messages").count() == steps.read("threads").count() == 0
    assert {r.account_id for r in steps.read("cursors").collect()} == {"a", "b"}
    steps.apply(log, log.filter("account_id = 'a'").limit(1), blobs, NOW)
    assert state(steps) == state(whole)


def test_one_provider_id_twice_fails_the_batch(spark, data, tmp_path):
    log, blobs = data
    again = spark.createDataFrame([observed(20, "a", 1)], EVENTS).withColumn("payload", F.col("payload").withField("message_id", F.lit("other")))
    with pytest.raises(ValueError, match="m1 and other"):
        projection.Projection(spark, f"file://{tmp_path}/x").rebuild(log.unionByName(again), blobs, NOW)


def test_first_upsert_after_removal_keeps_its_account(spark):
    rows = [entry(1, "a", "mailbox.upserted", mailbox=("mb", "One", "inbox")), entry(2, "b", "mailbox.upserted", mailbox=("mb", "Two", None)), entry(5, "c", "mailbox.upserted", mailbox=("x", "Old", None)),
            entry(6, "c", "mailbox.removed", mailbox_id="x"), entry(7, "d", "mailbox.upserted", mailbox=("x", "New", None)), entry(8, "e", "mailbox.upserted", mailbox=("x", "Newer", "sent"))]
    got = {(r.mailbox_id, r.account_id, r.name, r.role) for r in event_log.replay_mailboxes(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("mb", "a", "Two", None), ("x", "d", "Newer", "sent")}
