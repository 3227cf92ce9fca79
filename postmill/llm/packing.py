"""Filling containers of fixed capacity by sum-of-squares packing.

Each item goes where the sum, over all gap sizes, of the squared number of open containers with that gap
becomes smallest; a new container counts as a gap of the whole capacity. Items come in hash order, as
the method wants them (a stream of independent sizes). Only sizes matter, so a task moves 16 bytes an item, never the text.

Items are spread evenly over shards by a hash of their id (no key can be hot) and each shard packs its
own. What a shard leaves badly filled goes on, as larger items (a container's contents stay together), to
a next round with fewer shards, down to one. An item larger than the capacity fills whole containers of
its own; only its rest is packed. Items of size 0 (null, empty and blank texts) take no room: they join
the first container of their shard.

Result: every container's total is at most the capacity; every item has exactly one container, or, beyond
the capacity, one row for each of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.tokens import token_sizes
from postmill.session import materialise

CAPACITY = 2048
SHARD_ITEMS = 20_000
#: Containers filled less than this share of the capacity are packed again in the next round.
FULL = 0.98


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item, the items taken in the order given; sizes are 1 to ``capacity``."""
    out = np.empty(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; gap 0 is closed, capacity is a new one
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for k, s in enumerate(sizes.tolist()):
        # change of the sum: a gap g becomes g - s: 2(count[g-s] - count[g]) + 2, its first or second part absent at the ends
        change = 2 * (count[: capacity + 1 - s] - count[s:]) + 2
        change[0] = 1 - 2 * count[s]  # gap s is filled exactly
        change[-1] = 2 * count[capacity - s] + 1  # a new container
        if s == capacity:
            change[0] = 0
        else:
            inner = change[:-1]
            inner[count[s:-1] == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        gap = at + s
        if gap == capacity:
            bin_no, used = used, used + 1
        else:
            bin_no = open_at[gap].pop()
            count[gap] -= 1
        if gap > s:
            open_at[gap - s].append(bin_no)
            count[gap - s] += 1
        out[k] = bin_no
    return out


def _shard(capacity: int):
    def kernel(key: tuple, t: pa.Table) -> pa.Table:
        ids, sizes = t["item"], t["size"].to_numpy()
        order = np.argsort(t["h"].to_numpy(), kind="stable")
        bins = np.zeros(len(sizes), np.int64)
        sized = order[sizes[order] > 0]
        bins[sized] = sum_of_squares(sizes[sized], capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        return pa.table({"item": ids, "size": sizes, "shard": np.full(len(sizes), key[0].as_py()), "bin": bins, "fill": fill[bins]})

    return kernel


def _round(items: DataFrame, number: int, shards: int, capacity: int) -> DataFrame:
    """item, size, container (a name unique over all rounds), fill."""
    spread = items.withColumn("h", F.xxhash64("item", F.lit(number))).withColumn("s", F.pmod("h", F.lit(shards)))
    packed = spread.groupBy("s").applyInArrow(_shard(capacity), "item string, size bigint, shard bigint, bin bigint, fill bigint")
    name = F.concat_ws("-", F.lit(f"c{number}"), F.col("shard"), F.col("bin"))
    return packed.select("item", "size", name.alias("container"), "fill")


def pack_sizes(
    items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, full: float = FULL, rounds: int = 8
) -> DataFrame:
    """item, container, size, fill for ``items`` (item STRING, size BIGINT of 0 to ``capacity``)."""
    placed, number = [], 0
    todo = items
    members = None  # item to the container of the last round that holds it
    while True:
        n = todo.count()
        shards = max(1, -(-n // shard_items))
        now = materialise(_round(todo, number, shards, capacity), "packed")
        members = now.select("item", "size", "container", "fill") if members is None else materialise(
            # both sides grow with the items, so neither is to be broadcast
            members.join(now.select(F.col("item").alias("was"), F.col("container").alias("c"), F.col("fill").alias("f")).hint("merge"), F.col("container") == F.col("was"))
            .select("item", "size", F.col("c").alias("container"), F.col("f").alias("fill")),
            "members",
        )
        loose = F.col("fill") < full * capacity
        number += 1
        if shards == 1 or number == rounds:
            placed.append(members)
            break
        placed.append(members.filter(~loose))
        members = members.filter(loose)
        todo = now.filter(loose).select(F.col("container").alias("item"), F.col("fill").alias("size")).distinct()
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.select("item", "container", "size", "fill")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, part, size, container, fill: the container of every document (and of every part of an oversized one)."""
    sized = materialise(token_sizes(documents), "sizes")
    whole = F.floor(F.col("tokens") / capacity)
    rest = F.col("tokens") - whole * capacity
    fits = F.col("tokens") <= capacity
    item = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.when(fits, 0).otherwise(whole).cast("string"))
    items = sized.filter(fits | (rest > 0)).select(
        item.alias("item"), F.when(fits, F.col("tokens")).otherwise(rest).alias("size")
    )
    packed = pack_sizes(items, capacity, **options)
    parts = F.split("item", ":")
    own = sized.filter(~fits).select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("part"), F.lit(capacity).cast("bigint").alias("size")
    )
    return packed.select(
        F.nullif(parts[0], F.lit("")).cast("bigint").alias("doc_id"), parts[1].cast("bigint").alias("part"), "size", "container", "fill"
    ).unionByName(
        own.select("doc_id", "part", "size", F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container"), F.col("size").alias("fill"))
    )
