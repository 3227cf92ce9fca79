"""Conversations: cases, and the distributed build against one pass over a whole account."""

import random
from datetime import datetime, timedelta

import pytest

from postmill.operators import threads

PERSON = "array<struct<name:string,address:string>>"
SCHEMA = f"account_id string, id string, received_at timestamp, subject string, message_id_header array<string>, in_reply_to array<string>, refs array<string>, from_addr {PERSON}"
T0 = datetime(2026, 1, 1)


def rows(*items):
    return [("a", i, T0 + timedelta(hours=h), s, [own] if own else [], irt, refs, None) for i, h, s, own, irt, refs in items]


def built(spark, data):
    return {frozenset(r.message_ids): (r.thread_id, r.subject) for r in threads.threads(spark.createDataFrame(data, SCHEMA)).collect()}


def test_references_and_subjects(spark):
    data = rows(
        ("m1", 0, "Lunch", "1@x", [], []), ("m2", 1, "Re: Lunch", "2@x", ["1@x"], []), ("m3", 2, "Re: Re: Lunch", "3@x", [], ["1@x", "2@x"]),
        ("m4", 3, "RE: Lunch", "4@x", [], []), ("m5", 4, "Fwd: Lunch", "5@x", [], []), ("m6", 5, "Lunch", "6@x", [], []),
        ("m7", 6, "Alone", None, [], ["gone@x"]), ("m8", 7, "Other", "1@x", [], []),
    )
    got = built(spark, data)
    assert got[frozenset({"m1", "m2", "m3", "m4"})] == ("t:1@x", "Lunch")
    assert frozenset({"m5"}) in got and frozenset({"m6"}) in got and frozenset({"m8"}) in got and frozenset({"m7"}) in got


def test_missing_parent_and_loop(spark):
    data = rows(("m1", 0, "a", "1@x", ["0@x"], []), ("m2", 1, "b", "2@x", ["0@x"], []), ("m3", 2, "c", "3@x", [], ["4@x"]), ("m4", 3, "d", "4@x", [], ["3@x"]))
    got = built(spark, data)
    assert got[frozenset({"m1", "m2"})][0] == "t:0@x" and frozenset({"m3", "m4"}) in got


@pytest.mark.parametrize("seed", range(2))
def test_every_message_once_and_in_any_order(spark, seed):
    r = random.Random(seed)
    pool = [f"{k}@x" for k in range(13)]
    data = []
    for k in range(25):
        subject = r.choice(["", "one", "two", "three"])
        data += rows((f"m{k}", r.randrange(30), r.choice(["", "Re: ", "Fwd: "]) + subject, r.choice([None, *pool]), r.choice([[], [r.choice(pool)]]), r.sample(pool, r.randrange(4))))
    first = built(spark, data)
    assert sorted(i for s in first for i in s) == sorted(d[1] for d in data)
    r.shuffle(data)
    assert built(spark, data) == first


def test_long_ids(spark):
    got = built(spark, rows(("m1", 0, "s", "x" * 500 + "@h", [], [])))
    (name,) = {v[0] for v in got.values()}
    assert name.startswith("t:xxx") and name[442] == "~" and len(name) == 451


def test_empty(spark):
    assert built(spark, []) == {}
