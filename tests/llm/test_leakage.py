"""Problem 8: the automaton against windows of words."""

import random

import pytest

from postmill.llm import leakage
from postmill.llm.tokens import WORD


def windows(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("seed", range(20))
def test_automaton_equals_windows(seed):
    r = random.Random(seed)
    words = ["a", "b", "c", "Ä", "d1"]
    text = lambda n: r.choice([" ", ", ", "\n> "]).join(r.choice(words) for _ in range(n))
    items = [(f"i{k}", text(r.randrange(0, 14))) for k in range(8)] + [("none", None), ("same", "a b c a b c"), ("same2", "a b c a b c")]
    auto = leakage.Automaton(items, 4)
    for _ in range(30):
        doc = text(r.randrange(0, 60)) + r.choice(["", " zz ", " a b c a b c"])
        want = {k for k, p in items if windows(p, 4) & windows(doc, 4)}
        assert set(auto.matches(doc)) == want


def test_tables(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = [(1, "x " * 50 + passage[: len(passage)] + " y" * 40), (2, " ".join(f"w{k}" for k in range(11))), (3, None), (4, ""), (5, passage.upper().replace(" ", ", ")), (6, "long " * 30_000 + " ".join(f"w{k}" for k in range(5, 17)))]
    d = spark.createDataFrame([(i, t, "clash", "c") for i, t in docs], "doc_id bigint, text string, item_id string, passage string")
    e = spark.createDataFrame([("e1", passage, "x"), ("e1", passage, "x"), ("e2", passage, "x"), ("e3", None, "x"), (None, passage, "x"), ("e4", "short", "x")], "item_id string, passage string, text string")
    want = {(i, k) for i in (1, 5, 6) for k in ("e1", "e2")}
    got = [(r.doc_id, r.item_id) for r in leakage.leaked_items(d, e).collect()]
    assert set(got) == want and len(got) == len(want)
    split = leakage.leaked_items(d, e, block_chars=100)  # several blocks, each with its own pass
    assert {(r.doc_id, r.item_id) for r in split.collect()} == want
    clean = {r.doc_id: r for r in leakage.without_leaks(d, e).collect()}
    assert len(clean) == 6 and "w3" not in clean[1].text and clean[1].removed_words == 20 and clean[5].text is None and clean[2].text == docs[1][1]
    assert leakage.leaked_items(d, e.limit(0)).count() == 0 and leakage.leaked_items(d.limit(0), e).count() == 0


def test_removal_does_not_depend_on_blocks(spark):
    """Items that share words, or cover a text only together: any number of blocks gives the rows of one."""
    w = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    items = [("a", w(0, 30)), ("b", w(20, 50)), ("c", w(100, 145)), ("d", w(145, 190)), ("e", w(300, 320)), ("f", w(0, 30))]
    texts = [f"x y {w(0, 30)} {w(30, 40)} z" + " more" * 20, w(100, 190) + " tail " * 5, w(300, 315) + ", " + w(0, 15), "nothing here", None, "", f"q {w(20, 50)}", f"x y {w(0, 30)} {w(30, 40)} z" + " more" * 20]
    rows = [(k % 7, t) for k, t in enumerate(texts)] + [(0, "another text of the same id " + w(300, 320)), (None, w(0, 20) + " null id " * 9)]
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, digest string, ends string")
    e = spark.createDataFrame(items, "item_id string, passage string")
    state = lambda df: sorted(map(str, df.collect()))
    one, many = leakage.without_leaks(d, e), leakage.without_leaks(d, e, block_chars=100)
    assert state(one) == state(many) and one.count() == len(rows)
    got = {r.doc_id: r for r in one.filter("doc_id in (1, 3)").collect()}
    assert got[1].text is None and got[1].removed_words == 90 and got[3].text == "nothing here"
    assert any((r.text or "").startswith("x y  z more") and r.removed_words == 40 for r in one.collect())
    assert state(leakage.leaked_items(d, e)) == state(leakage.leaked_items(d, e, block_chars=100))
    assert state(leakage.without_leaks(d, e.limit(0))) == state(d.selectExpr("doc_id", "text", "0L as removed_words"))


@pytest.mark.parametrize("seed", range(10))
def test_cut_equals_brute_force(seed):
    r = random.Random(seed)
    items = [(f"i{k}", " ".join(r.choice("abc") for _ in range(r.randrange(3, 9)))) for k in range(5)]
    auto = leakage.Automaton(items, 3)
    for _ in range(30):
        words = [r.choice("abcd") for _ in range(r.randrange(0, 30))]
        text = " ".join(words)
        runs = {g for _, p in items for g in windows(p, 3)}
        gone = {k + x for k in range(len(words) - 2) for x in range(3) if tuple(words[k : k + 3]) in runs}
        got, removed = leakage.cut(text, [e for es in auto.matches(text).values() for e in es], 3, 1.0)
        assert removed == len(gone) and got.split() == [w for k, w in enumerate(words) if k not in gone]
