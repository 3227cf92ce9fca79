"""Problem 7: every item once, no container too full, little room lost."""

import numpy as np
from hypothesis import given, settings, strategies as st

from postmill.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_sum_of_squares_is_the_rule(sizes):
    """Against the definition: the place with the least sum of squares, an open gap before a new container."""
    cap = 40
    bins = packing.sum_of_squares(np.array(sizes, np.int64), cap)
    gaps: list[int] = []
    for s, b in zip(sizes, bins):
        def total(g):
            return sum(g.count(x) ** 2 for x in set(g) if 0 < x < cap)

        options = [total(gaps[:i] + [g - s] + gaps[i + 1 :]) for i, g in enumerate(gaps) if g >= s] + [total(gaps + [cap - s])]
        if b == len(gaps):
            gaps.append(cap - s)
        else:
            assert gaps[b] >= s
            gaps[b] -= s
        assert total(gaps) == min(options)


def test_documents(spark):
    schema = "doc_id bigint, text string, container string, size bigint, item string"
    r = np.random.default_rng(3)
    texts = [" ".join(["w"] * int(n)) for n in r.integers(0, 60, 900)]
    rows = [(i, t, "c", 1, "x") for i, t in enumerate(texts)] + [(900, None, "c", 1, "x"), (901, "", "c", 1, "x"), (902, " ".join(["w"] * 250), "c", 1, "x"), (903, " ".join(["w"] * 100), "c", 1, "x"), (None, "a b", "c", 1, "x")]
    df = spark.createDataFrame(rows, schema)
    got = packing.pack_documents(df, 100, shard_items=120).collect()
    assert len(got) == len(rows) + 2 and len({(g.doc_id, g.part) for g in got}) == len(got)
    fill: dict = {}
    for g in got:
        fill[g.container] = fill.get(g.container, 0) + g.size
    assert max(fill.values()) <= 100 and all(fill[g.container] == g.fill for g in got)
    sizes = {g.doc_id: 0 for g in got}
    for g in got:
        sizes[g.doc_id] += g.size
    assert all(sizes[i] == len(t.split()) for i, t in enumerate(texts)) and sizes[902] == 250
    assert len([f for f in fill.values() if f]) <= 1.05 * sum(sizes.values()) / 100 + 2
    assert packing.pack_documents(df.limit(0), 100).count() == 0
