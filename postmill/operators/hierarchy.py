"""Parent-child links to full hierarchies: root, depth, path, subtree size, descendants, loops.

Leaf peeling, bottom up: all nodes without open children are taken off together and hand their subtree
size to their parents; what is left when nothing can be taken off are the loops. In reverse peel order
each node then takes root and depth from its parent. The peel runs vectorised inside a task over every
tree of a *block* (a partition that holds whole groups), so the number of Spark stages does not depend on
how deep the trees are.

A group (an account) of at most ``block_nodes`` rows goes whole into a block. A larger one is first cut
into its trees: pointer doubling, in rounds of shuffle joins, gives every node its top, so a tree of at
most ``block_nodes`` nodes goes whole into a block. A single tree beyond that bound is never in one task:
its subtree sizes and paths double as the pointers do, and its descendants are its paths turned round.

Edge cases: null group or node ids are dropped; repeated rows of a node take effect in order of ``rank``
(the first that names a known parent wins); a node naming itself is a loop; nodes whose way up ends in a
loop have root '' and depth -1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.ids import first_message_id, message_id_key
from postmill.session import materialise

BLOCK_NODES = 400_000
SCHEMA = "grp string, node_id string, root_id string, depth bigint, subtree_size bigint"


def message_links(messages: DataFrame) -> DataFrame:
    """grp, node_id, rank, parents: candidate parents, in_reply_to in order and then refs from last to first."""
    empty = F.array().cast("array<string>")
    named = F.concat(F.coalesce("in_reply_to", empty), F.reverse(F.coalesce("refs", empty)))
    return messages.select(
        F.col("account_id").alias("grp"),
        first_message_id(F.col("message_id_header")).alias("node_id"),
        F.col("delivery_id").alias("rank"),
        F.filter(F.transform(named, message_id_key), lambda x: x.isNotNull()).alias("parents"),
    ).filter(F.col("grp").isNotNull() & F.col("node_id").isNotNull())


def _hashed(links: DataFrame) -> DataFrame:
    """Node names as 64-bit hashes salted with the group; the string stays with its own row only."""
    return links.select(
        "grp",
        "node_id",
        "rank",
        F.xxhash64("grp", "node_id").alias("h"),
        F.transform("parents", lambda p: F.xxhash64("grp", p)).alias("parents"),
    )


def peel(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root index, depth and subtree size of every node; ``parent`` holds indices, -1 for none.

    Nodes on loops, or under them, get root -1 and depth -1.
    """
    n = len(parent)
    size = np.ones(n, np.int64)
    has = parent >= 0
    open_children = np.bincount(parent[has], minlength=n)
    leaves = np.flatnonzero(open_children == 0)
    order = []
    while len(leaves):
        order.append(leaves)
        child = leaves[parent[leaves] >= 0]
        up = parent[child]
        np.add.at(size, up, size[child])
        np.subtract.at(open_children, up, 1)
        up = np.unique(up)
        leaves = up[open_children[up] == 0]
    root = np.full(n, -1, np.int64)
    depth = np.full(n, -1, np.int64)
    for layer in reversed(order):
        up = parent[layer]
        top = layer[up < 0]
        root[top], depth[top] = top, 0
        below = layer[up >= 0]
        up = parent[below]
        root[below] = root[up]
        depth[below] = np.where(root[up] >= 0, depth[up] + 1, -1)
    return root, depth, size


def resolve(h: np.ndarray, rank: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes (row index of each) and their parents (index into the nodes, -1 for none)."""
    by = np.lexsort((rank, h))
    hs = h[by]
    starts = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, np.int64)
    names, rows = hs[starts], by[starts]
    at = np.searchsorted(names, values)
    at[at == len(names)] = 0
    known = names[at] == values if len(names) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(h)), lengths)[known]
    place = np.flatnonzero(known)
    node = np.searchsorted(names, h[owner])
    parent = np.full(len(names), -1, np.int64)
    if len(place):
        first = np.lexsort((place, rank[owner], node))
        node = node[first]
        take = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        parent[node[take]] = at[place[first[take]]]
    return rows, parent


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    cands = t["parents"].combine_chunks()
    rows, parent = resolve(
        t["h"].to_numpy(),
        t["rank"].to_numpy(),
        cands.flatten().to_numpy(),
        pa.compute.fill_null(pa.compute.list_value_length(cands), 0).to_numpy(),
    )
    root, depth, size = peel(parent)
    names = t["node_id"].combine_chunks().take(pa.array(rows))
    top = names.take(pa.array(np.where(root < 0, 0, root)))
    out = pa.table(
        {
            "grp": t["grp"].combine_chunks().take(pa.array(rows)),
            "node_id": names,
            "root_id": pa.compute.if_else(pa.array(root >= 0), top, ""),
            "depth": depth,
            "subtree_size": size,
        }
    )
    yield from out.to_batches(max_chunksize=10_000)


def _tree_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_block``, with paths and descendants; these are made and sent node range by node range."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts).combine_chunks()
    cands = t["parents"].combine_chunks()
    rows, parent = resolve(
        t["h"].to_numpy(),
        t["rank"].to_numpy(),
        cands.flatten().to_numpy(),
        pa.compute.fill_null(pa.compute.list_value_length(cands), 0).to_numpy(),
    )
    root, depth, size = peel(parent)
    n = len(parent)
    names = t["node_id"].combine_chunks().take(pa.array(rows)).to_pylist()
    groups = t["grp"].combine_chunks().take(pa.array(rows)).to_pylist()
    # preorder: a node's descendants are the slice after it; siblings lie in order of their name
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in sorted(range(n), key=lambda i: names[i]):
        if parent[i] >= 0 and root[i] >= 0:
            kids[parent[i]].append(i)
    order, at = [], np.zeros(n, np.int64)
    for r in np.flatnonzero(depth == 0):
        stack = [int(r)]
        while stack:
            i = stack.pop()
            at[i] = len(order)
            order.append(names[i])
            stack.extend(reversed(kids[i]))
    schema = pa.schema(
        [("grp", pa.string()), ("node_id", pa.string()), ("root_id", pa.string()), ("depth", pa.int64()),
         ("subtree_size", pa.int64()), ("path", pa.list_(pa.string())), ("descendants", pa.list_(pa.string()))]
    )
    rows_out, cells = [], 0
    for i in range(n):
        if root[i] < 0:
            rows_out.append((groups[i], names[i], "", -1, int(size[i]), [], []))
        else:
            path, j = [], i
            while j >= 0:
                path.append(names[j])
                j = int(parent[j])
            below = order[at[i] + 1 : at[i] + int(size[i])]
            rows_out.append((groups[i], names[i], names[root[i]], int(depth[i]), int(size[i]), path[::-1], below))
            cells += len(path) + len(below)
        if cells > 100_000 or len(rows_out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_out), schema)], schema=schema)
            rows_out, cells = [], 0
    if rows_out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_out), schema)], schema=schema)


def hierarchy(links: DataFrame, lists: bool = False, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """grp, node_id, root_id, depth, subtree_size of every node; with ``lists`` also path and descendants.

    ``links``: grp, node_id, rank, parents (candidates, best first), as ``message_links`` gives them.
    """
    kernel, schema = (_tree_block, SCHEMA + ", path array<string>, descendants array<string>") if lists else (_block, SCHEMA)
    sizes = links.groupBy("grp").agg(F.count("*").alias("n"))
    total, most, large = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") > block_nodes)
    ).first()
    least = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _hashed(links)
    blocks = max(least, -(-4 * total // block_nodes))
    if most <= block_nodes:
        return rows.repartition(blocks, "grp").mapInArrow(kernel, schema)
    # at most total / block_nodes groups are large
    big = sizes.filter(F.col("n") > block_nodes).select("grp")
    small = rows.join(big, "grp", "left_anti").repartition(blocks, "grp").mapInArrow(kernel, schema)
    tops = materialise(tree_tops(rows.join(big, "grp", "left_semi")), "tops")
    trees = tops.groupBy("top").agg(F.count("*").alias("n"))
    giant = trees.filter(F.col("n") > block_nodes).select("top")
    whole = (
        tops.join(giant, "top", "left_anti")
        .select("grp", "node_id", F.lit(0).cast("bigint").alias("rank"), "h", F.array_compact(F.array("parent")).alias("parents"), "top")
        .repartition(blocks, "top")
        .drop("top")
        .mapInArrow(kernel, schema)
    )
    placed = small.unionByName(whole)
    if giant.isEmpty():
        return placed
    return placed.unionByName(_beyond(tops.join(giant, "top", "left_semi"), lists))


def _beyond(nodes: DataFrame, lists: bool) -> DataFrame:
    """Trees that fit into no block, by doubling: after k rounds a node has the size of its subtree, and its path, within 2^k steps.

    ``nodes``: whole trees as ``tree_tops`` gives them. The nodes of a loop hand nothing on, as in ``peel``.
    """
    nodes = materialise(nodes, "beyond")
    state = nodes.select(
        "h", F.when(~F.col("on_loop"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("n"), *([F.array("node_id").alias("path")] if lists else [])
    )
    while True:
        state = materialise(state, "subtrees")
        moving = state.filter("up is not null")
        if moving.isEmpty():
            break
        more = moving.groupBy(F.col("up").alias("h")).agg(F.sum("n").alias("more"))
        ahead = state.select(F.col("h").alias("up"), F.col("up").alias("up2"), *([F.col("path").alias("above")] if lists else []))
        longer = moving.join(ahead, "up").select("h", F.col("up2").alias("up"), "n", *([F.concat("above", "path").alias("path")] if lists else []))
        state = state.filter("up is null").unionByName(longer).join(more, "h", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).drop("more")
    named = nodes.select(F.col("h").alias("top"), F.col("node_id").alias("root_name"))
    found = (
        nodes.join(state, "h")
        .join(named, "top", "left")
        .select(
            "grp",
            "node_id",
            F.when(F.col("loops"), "").otherwise(F.col("root_name")).alias("root_id"),
            F.when(F.col("loops"), F.lit(-1)).otherwise(F.col("depth")).cast("bigint").alias("depth"),
            F.col("n").alias("subtree_size"),
            *(["path"] if lists else []),
        )
    )
    if not lists:
        return found
    none = F.array().cast("array<string>")
    # a tree in order of its paths is in preorder with siblings in order of their name, as in the blocks
    ordered = materialise(found.filter("depth >= 0").orderBy("path").withColumn("pos", F.monotonically_increasing_id()), "preorder")
    pairs = ordered.select("grp", "pos", F.col("node_id").alias("x"), F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node_id"))
    below = pairs.groupBy("grp", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("descendants"))
    trees = ordered.drop("pos").join(below, ["grp", "node_id"], "left").withColumn("descendants", F.coalesce("descendants", none))
    return trees.unionByName(found.filter("depth < 0").withColumn("path", none).withColumn("descendants", none))


def tree_tops(rows: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Per node (hash ``h``): its parent, the top of its tree, its depth, whether its way up ends in a loop and whether it is on one.

    Pointer doubling: after k rounds a node points 2^k steps up. Pointers that still move after as many
    rounds as the number of nodes allows are on loops; the least node of a loop then names the tree.
    """
    picked = rows.select("h", "rank", F.posexplode("parents").alias("pos", "p"))
    known = rows.select(F.col("h").alias("p")).distinct()
    parents = picked.join(known, "p", "left_semi").groupBy("h").agg(F.min_by("p", F.struct("rank", "pos")).alias("parent"))
    nodes = rows.groupBy("h").agg(F.first("grp").alias("grp"), F.first("node_id").alias("node_id"))
    base = materialise(nodes.join(parents, "h", "left"), "nodes")
    total = base.count()
    state = base.select(
        "h",
        F.coalesce("parent", "h").alias("up"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.col("parent").isNull().alias("done"),
        F.least("h", F.coalesce("parent", "h")).alias("low"),
    )
    for round_no in range(max_rounds):
        state = materialise(state, "pointers")
        if 2**round_no > total or state.filter(~F.col("done")).isEmpty():
            break
        ahead = state.select(
            F.col("h").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("done").alias("d2"), F.col("low").alias("low2")
        )
        moving = state.filter(~F.col("done")).join(ahead, "up").select(
            "h",
            F.col("up2").alias("up"),
            (F.col("steps") + F.col("s2")).alias("steps"),
            F.col("d2").alias("done"),
            F.least("low", "low2").alias("low"),
        )
        state = state.filter("done").unionByName(moving)
    # Below a loop, the least node seen on the way is not one name for the whole tree; the loop's own nodes agree
    # on theirs, and after enough rounds every pointer lies on the loop.
    loop = state.filter(~F.col("done")).select(F.col("h").alias("up"), F.col("low").alias("loop_low"))
    looped = state.filter(~F.col("done")).select(F.col("up").alias("h"), F.lit(True).alias("on_loop")).distinct()
    named = state.join(loop, "up", "left").join(looped, "h", "left").select(
        "h",
        F.when(F.col("done"), F.col("up")).otherwise(F.col("loop_low")).alias("top"),
        F.col("steps").alias("depth"),
        (~F.col("done")).alias("loops"),
        F.coalesce("on_loop", F.lit(False)).alias("on_loop"),
    )
    return base.join(named, "h")


def message_hierarchy(messages: DataFrame, **options) -> DataFrame:
    """Reply trees of the messages of each account."""
    return hierarchy(message_links(messages), **options)
