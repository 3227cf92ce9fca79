"""Optimistic effects: the closed form per value against applying intents one after the other."""

import random
from datetime import datetime, timedelta

import pytest

from postmill.operators import intents
from postmill.schemas import INTENTS

T0 = datetime(2026, 1, 1)


def one_by_one(log, state):
    now = {i: [set(k), set(m), False] for i, (k, m) in state.items()}
    for r in sorted(log, key=lambda r: (r[2], r[0])):
        for i in r[4]:
            if i not in now:
                continue
            if r[3] == "message.destroy":
                now[i][2] = True
            else:
                at = 0 if r[3] == "keywords.change" else 1
                now[i][at] = (now[i][at] - set(r[6] or ())) | set(r[5] or ())
    out = set()
    for i, (k, m, gone) in now.items():
        k0, m0 = map(set, state[i])
        if gone:
            out.add((i, "message.removed", None))
        else:
            out |= {(i, t, tuple(sorted(a))) for t, a, b in (("message.keywords.set", k, k0), ("message.mailboxes.set", m, m0)) if a != b}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_local_events(spark, seed):
    r = random.Random(seed)
    some = lambda: r.choice([None, [], *[r.sample("abcd", r.randrange(1, 3)) for _ in range(4)]])
    state = {f"m{k}": (r.sample("abcd", r.randrange(3)), r.sample("abcd", r.randrange(3))) for k in range(6)}
    log = [
        (f"i{k:02}", "acc", T0 + timedelta(minutes=r.randrange(8)), r.choice(["keywords.change"] * 4 + ["mailboxes.change"] * 4 + ["message.destroy", "mailbox.create"]), r.sample([*state, "gone"], r.randrange(1, 4)), some(), some(), "pending", 0, None, None)
        for k in range(30)
    ]
    known = [x for x in log if x[3] != "mailbox.create"]
    messages = spark.createDataFrame([(i, list(k), list(m), "x", "y") for i, (k, m) in state.items()], "id string, keywords array<string>, mailbox_ids array<string>, op string, v string")
    got = intents.local_events(spark.createDataFrame(log, INTENTS), messages)
    assert {(e.message_id, e.type, None if e["values"] is None else tuple(e["values"])) for e in got.collect()} == one_by_one(known, state)


def test_record_update_and_empty(spark):
    empty = spark.createDataFrame([], INTENTS)
    row = ("i1", "acc", T0, "message.destroy", ["m1"], None, None, "pending", 0, None, None)
    log = spark.createDataFrame([row], INTENTS)
    assert intents.record(log, spark.createDataFrame([row, row, ("i2", *row[1:])], INTENTS)).select("id").collect() == [("i2",)]
    done = intents.update(log, spark.createDataFrame([("i1", "settled", None)], "id string, state string, attempts int")).first()
    assert done.state == "settled" and done.attempts == 0
    messages = spark.createDataFrame([], "id string, keywords array<string>, mailbox_ids array<string>")
    assert intents.local_events(empty, messages).count() == intents.local_events(log, messages).count() == 0
