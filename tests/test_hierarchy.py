"""Problem 4: trees against a walk up the parents."""

import random

import numpy as np
import pytest

from postmill.operators import hierarchy

SCHEMA = "grp string, node_id string, rank bigint, parents array<string>, extra string"


def brute(rows):
    nodes = {(g, n) for g, n, _, _, _ in rows if g and n}
    parent = {}
    for g, n, _, ps, _ in sorted(rows, key=lambda r: r[2]):
        for p in ps or []:
            if (g, p) in nodes:
                parent.setdefault((g, n), (g, p))
                break
    out = {}
    for x in nodes:
        seen, at, depth = set(), x, 0
        while at in parent and at not in seen:
            seen.add(at)
            at, depth = parent[at], depth + 1
        out[x] = ("", -1) if at in seen else (at[1], depth)
    return out, parent


def random_rows(seed, n=120, groups=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = f"g{r.randrange(groups)}"
        ps = r.choice([None, [], [f"n{max(0, i - r.randrange(1, 4))}"], [f"n{r.randrange(n)}", "absent"], ["absent", f"n{i}"], ["gone"]])
        rows.append((g, f"n{i}", i, ps, "x"))
    rows += [r.choice(rows) for _ in range(20)]
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [1000, 15])
def test_equals_walk(spark, seed, block):
    rows = random_rows(seed)
    want, _ = brute(rows)
    got = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA), block_nodes=block)
    assert {(r.grp, r.node_id): (r.root_id, r.depth) for r in got.collect()} == want


def test_paths_and_descendants(spark):
    rows = random_rows(9, n=60, groups=1)
    want, parent = brute(rows)
    got = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA), lists=True).collect()
    for r in got:
        if r.depth < 0:
            assert r.path == [] and r.descendants == []
            continue
        up, at = [r.node_id], (r.grp, r.node_id)
        while at in parent:
            at = parent[at]
            up.append(at[1])
        assert r.path == up[::-1] and len(r.path) == r.depth + 1
    lists = {r.node_id: set(r.descendants) for r in got if r.depth >= 0}
    for r in got:
        if r.depth >= 0:
            assert lists[r.node_id] == {x.node_id for x in got if x.depth > r.depth and r.node_id in x.path}
            assert r.subtree_size == len(lists[r.node_id]) + 1


def test_single_tree_beyond_the_bound_keeps_root_and_depth(spark):
    rows = [("g", f"n{i}", i, [f"n{i - 1}"] if i else [], "x") for i in range(50)]
    got = hierarchy.hierarchy(spark.createDataFrame(rows, SCHEMA), block_nodes=10)
    assert {(r.node_id, r.root_id, r.depth) for r in got.collect()} == {(f"n{i}", "n0", i) for i in range(50)}


def test_chain_and_loop_kernel():
    root, depth, size = hierarchy.peel(np.array([-1, 0, 1, 4, 3, 5, 3]))
    assert depth.tolist() == [0, 1, 2, -1, -1, -1, -1] and size.tolist()[:3] == [3, 2, 1] and root.tolist()[:3] == [0, 0, 0]


def test_empty_and_messages(spark, sf_dir):
    assert hierarchy.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    messages = spark.read.parquet(f"{sf_dir}/messages.parquet").withColumnRenamed("preview", "node_id")
    assert hierarchy.message_hierarchy(messages).count() > 0
