"""Applying a feed of inserts, updates and deletes: a log-structured merge store on Parquet.

Entries are appended as *runs*: immutable folders of one Parquet file a bucket, each sorted by (key, seq). Reading
a bucket is a k-way merge of the runs' files in one pass, batch by batch, without a shuffle: a task holds one batch
of each run. The merge sums up every key and range of ``SEGMENT`` sequence numbers (tombstone, first insert after it,
last value of each set); buckets are hashed by key *and* range, so no key, however hot, fills one. One aggregate by
key then joins the ranges' summaries. When a level has ``FANOUT`` runs they are compacted into one run of the next
level, without the entries that later ones shadow for good. The live runs stand in a numbered manifest in the folder,
so a store can be opened again, and a lost job leaves nothing behind that is read.

The merged state of a key is a function of four values: the last removal (the tombstone), the first insert after it,
and the last value of each set after that insert. Ranges of seq are disjoint, so the summaries of the ranges merge
exactly, and all of them are maxima and minima: entries may arrive any number of times and in any order, the same seq
twice changes nothing.

Edge cases: entries with a null key, seq or type are ignored; null sets count as empty; null members of
sets are dropped, repeated members count once; an empty log gives an empty state.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import list_files, read_text, remove_path, scratch_path, shuffle_partitions, write_new

#: Sequence numbers of one range. Nothing ever holds more than this many entries of a key at once.
SEGMENT = 1 << 20
#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Rows a task holds of each run while it merges a bucket.
BATCH_ROWS = 50_000

ENTRY = "key string, seq bigint, op string, first_set array<string>, second_set array<string>"
INSERT, DELETE, FIRST, SECOND = "insert", "delete", "first", "second"


def message_changes(event_log: DataFrame) -> DataFrame:
    """The entries of an event log that concern messages, as store entries, with their batch number if the log has one."""
    op = (
        F.when(F.col("type") == "message.observed", INSERT)
        .when(F.col("type") == "message.removed", DELETE)
        .when(F.col("type") == "message.keywords.set", FIRST)
        .when(F.col("type") == "message.mailboxes.set", SECOND)
    )
    return event_log.filter(
        F.col("type").isin("message.observed", "message.removed", "message.keywords.set", "message.mailboxes.set")
    ).select(
        F.col("payload.message_id").alias("key"),
        "seq",
        op.alias("op"),
        F.col("payload.keywords").alias("first_set"),
        F.col("payload.mailbox_ids").alias("second_set"),
        *[c for c in ("batch_no",) if c in event_log.columns],
    ).filter(F.col("key").isNotNull() & F.col("seq").isNotNull())


def merge(entries: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """Current state: key, first_set, second_set (sorted, distinct), one row per present key; the same without a store.

    Always summed up by (key, range of ``limit`` sequence numbers) first, so no key is special; a range holds at most ``limit`` inserts.
    """
    at = lambda op: F.when(F.col("op") == op, F.col("seq"))
    last = lambda op, value: F.max(F.when(F.col("op") == op, F.struct("seq", F.col(value).alias("v"))))
    grouped = entries.groupBy("key", F.floor(F.col("seq") / limit).alias("segment")).agg(
        F.max(at(DELETE)).alias("gone"),
        F.collect_set(at(INSERT)).alias("inserts"),
        last(FIRST, "first_set").alias("first"),
        last(SECOND, "second_set").alias("second"),
    )
    born = F.array_min(F.filter("inserts", lambda s: s > F.coalesce(F.col("gone"), F.lit(-(2**63)))))
    return _joined(grouped.select("key", "gone", born.alias("born"), "first", "second"))


def _joined(ranges: DataFrame) -> DataFrame:
    """State from the summaries of disjoint ranges: key, gone, born, first (seq, v), second (seq, v)."""
    joined = ranges.groupBy("key").agg(
        F.max("gone").alias("gone"), F.collect_list("born").alias("born"), F.max("first").alias("first"), F.max("second").alias("second")
    )
    # ranges before the tombstone are void, so the first insert is the least one after it
    born = F.array_min(F.filter("born", lambda s: s > F.coalesce(F.col("gone"), F.lit(-(2**63)))))
    return joined.withColumn("born", born).filter(F.col("born").isNotNull()).select(
        "key", _live(F.col("first")).alias("first_set"), _live(F.col("second")).alias("second_set")
    )


def _live(last: Column) -> Column:
    """Members of the last set if it came after the key was born, else none."""
    members = F.array_sort(F.array_distinct(F.filter(last["v"], lambda x: x.isNotNull())))
    empty = F.array().cast("array<string>")
    return F.when(last["seq"] > F.col("born"), F.coalesce(members, empty)).otherwise(empty)


RUN = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("op", pa.string()), ("first_set", pa.list_(pa.string())), ("second_set", pa.list_(pa.string()))])
_SET = pa.list_(pa.string())
SUMMARY = "key string, gone bigint, born bigint, first_seq bigint, first_set array<string>, second_seq bigint, second_set array<string>"


def _open(path: str):
    """File system and path for pyarrow of a path as Spark names it."""
    from pyarrow import fs

    where = re.sub(r"^s3[an]:", "s3:", path)
    where = re.sub(r"^file:/+", "file:///", where)
    return fs.FileSystem.from_uri(where) if ":" in where.split("/", 1)[0] else (fs.LocalFileSystem(), where)


def _batches(path: str, rows: int) -> Iterator[pa.Table]:
    import pyarrow.parquet as pq

    system, where = _open(path)
    with pq.ParquetFile(system.open_input_file(where)) as f:
        for b in f.iter_batches(rows, columns=RUN.names):
            if b.num_rows:
                yield pa.Table.from_batches([b]).cast(RUN)


def merged(runs: Sequence[Iterator[pa.Table]]) -> Iterator[pa.Table]:
    """K-way merge of streams sorted by (key, seq): tables in that order, of what lies up to the least end of the streams' batches."""
    heads = [t for t in ((next(r, None), r) for r in runs) if t[0] is not None]
    while heads:
        ends = [(t["key"][t.num_rows - 1].as_py(), t["seq"][t.num_rows - 1].as_py()) for t, _ in heads]
        cut = min(ends)
        ready, rest = [], []
        for (t, r), end in zip(heads, ends):
            n = t.num_rows
            if end != cut:
                key = t["key"]
                low = pc.less(key, cut[0])
                same = pc.and_(pc.equal(key, cut[0]), pc.less_equal(t["seq"], cut[1]))
                n = pc.sum(pc.or_(low, same)).as_py() or 0
            ready.append(t.slice(0, n))
            left = t.slice(n)
            if left.num_rows == 0:
                left = next(r, None)
            if left is not None:
                rest.append((left, r))
        heads = rest
        some = pa.concat_tables([t for t in ready if t.num_rows])
        if some.num_rows:
            yield some.take(pc.sort_indices(some, [("key", "ascending"), ("seq", "ascending")])) if len(ready) > 1 else some


class _Ranges:
    """Keys and ranges of a sorted table, and what each holds of the four values."""

    def __init__(self, t: pa.Table, segment: int) -> None:
        self.table = t = t.combine_chunks()
        self.codes = pc.dictionary_encode(t["key"]).combine_chunks().indices.to_numpy()
        self.seq = t["seq"].to_numpy()
        op = t["op"]
        n = len(self.seq)
        part = self.seq // segment
        self.starts = np.flatnonzero(np.r_[True, (self.codes[1:] != self.codes[:-1]) | (part[1:] != part[:-1])])
        self.group = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, n]))
        self.is_ = {k: pc.fill_null(pc.equal(op, k), False).to_numpy(zero_copy_only=False) for k in (INSERT, DELETE, FIRST, SECOND)}
        low = np.iinfo(np.int64).min
        self.gone = np.maximum.reduceat(np.where(self.is_[DELETE], self.seq, low), self.starts)
        self.alive = self.is_[INSERT] & (self.seq > self.gone[self.group])
        self.born = np.minimum.reduceat(np.where(self.alive, self.seq, np.iinfo(np.int64).max), self.starts)
        place = np.arange(n)
        self.last = {k: np.maximum.reduceat(np.where(self.is_[k], place, -1), self.starts) for k in (FIRST, SECOND)}


def _summarised(t: pa.Table, segment: int) -> pa.RecordBatch:
    r = _Ranges(t, segment)
    t = r.table
    known = lambda values, bad: pa.array(values, pa.int64(), mask=values == bad)
    columns = [t["key"].take(pa.array(r.starts)), known(r.gone, np.iinfo(np.int64).min), known(r.born, np.iinfo(np.int64).max)]
    for k, name in ((FIRST, "first_set"), (SECOND, "second_set")):
        at = pa.array(r.last[k], pa.int64(), mask=r.last[k] < 0)
        columns += [t["seq"].take(at), t[name].take(at)]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, ["key", "gone", "born", "first_seq", "first_set", "second_seq", "second_set"])


def _kept(t: pa.Table, segment: int) -> pa.Table:
    """The entries of a sorted table that no later arrival can make void: the tombstone, the inserts after it, the last value of each set."""
    r = _Ranges(t, segment)
    place = np.arange(len(r.seq))
    keep = r.alive | (r.is_[DELETE] & (r.seq == r.gone[r.group]))
    for k in (FIRST, SECOND):
        keep |= place == r.last[k][r.group]
    same = np.r_[False, (r.codes[1:] == r.codes[:-1]) & (r.seq[1:] == r.seq[:-1])]  # the same entry once more
    return r.table.filter(pa.array(keep & ~(same & np.r_[False, keep[:-1]])))


class ChangeStore:
    """Runs of change entries in a folder of a file system that all executors share.

    ``append`` adds sorted runs and compacts full levels, ``state`` reads all runs merged, ``compact`` makes one run of all. A store
    opened at a path that holds one goes on with it. One writer at a time: a second one fails on the manifest's number. Late entries
    may come after a compaction: it drops only what no later arrival can revive (entries before the tombstone of their range, sets
    before the last). ``vacuum`` removes the folders of runs that are no longer live; readers of older states must have ended.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, segment: int = SEGMENT) -> None:
        self.spark, self.fanout = spark, fanout
        self.path = (path or scratch_path(spark, "changes")).rstrip("/")
        numbers = [int(m.group(1)) for f in list_files(spark, f"{self.path}/manifest") if (m := re.search(r"/v(\d+)\.json$", f))]
        self.version = max(numbers, default=0)
        if self.version:
            m = json.loads(read_text(spark, f"{self.path}/manifest/v{self.version}.json"))
            self.buckets, self.segment, self.runs = m["buckets"], m["segment"], m["runs"]
        else:
            self.buckets, self.segment, self.runs = shuffle_partitions(spark), segment, []

    def _commit(self, runs: list[dict]) -> None:
        text = json.dumps({"buckets": self.buckets, "segment": self.segment, "runs": runs})
        write_new(self.spark, f"{self.path}/manifest/v{self.version + 1}.json", text)
        self.version, self.runs = self.version + 1, runs

    def _written(self, sorted_rows: DataFrame, level: int) -> dict:
        """Write a run whose partition number is its bucket; returns its entry in the manifest."""
        name = f"run-{uuid.uuid4().hex}"
        sorted_rows.write.option("maxRecordsPerFile", 0).parquet(f"{self.path}/{name}")
        files = [f for f in list_files(self.spark, f"{self.path}/{name}") if re.search(r"/part-\d+-[^/]*\.parquet$", f)]
        return {"name": name, "level": level, "files": sorted([int(re.search(r"/part-(\d+)-", f).group(1)), f.rsplit("/", 1)[1]] for f in files)}

    def append(self, entries: DataFrame, runs: int = 1) -> None:
        """Add ``entries`` as ``runs`` sorted runs of successive batches (by ``batch_no`` if there is one)."""
        parts = [F.lit(True)]
        if runs > 1 and "batch_no" in entries.columns:
            low, high = entries.agg(F.min("batch_no"), F.max("batch_no")).first()
            if low is not None:
                width = (high - low) // runs + 1
                number = F.coalesce(F.floor((F.col("batch_no") - low) / width), F.lit(0))
                parts = [number == k for k in range(runs)]
        for part in parts:
            rows = entries.filter(part).filter("key is not null and seq is not null").select("key", "seq", "op", "first_set", "second_set")
            # hashed by range of seq too, so that no key, however hot, makes one bucket
            bucketed = rows.repartition(self.buckets, "key", F.floor(F.col("seq") / self.segment)).sortWithinPartitions("key", "seq")
            self._commit([*self.runs, self._written(bucketed, 0)])
            level = 0
            while sum(r["level"] == level for r in self.runs) >= self.fanout:
                self._compact(level)
                level += 1

    def _bucket_files(self, runs: list[dict]) -> list[list[str]]:
        files: list[list[str]] = [[] for _ in range(self.buckets)]
        for r in runs:
            for bucket, name in r["files"]:
                files[bucket].append(f"{self.path}/{r['name']}/{name}")
        return files

    def _merged(self, runs: list[dict], kernel, schema: str) -> DataFrame:
        """``kernel`` of every merged table, bucket by bucket; bucket k is partition k."""
        files = self._bucket_files(runs)
        buckets = self.spark.range(0, self.buckets, 1, self.buckets)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for bucket in b["id"].to_pylist():
                    for t in merged([_batches(f, BATCH_ROWS) for f in files[bucket]]):
                        yield from kernel(t)

        return buckets.mapInArrow(read, schema)

    def _compact(self, level: int | None) -> None:
        old = [r for r in self.runs if level is None or r["level"] == level]
        segment = self.segment

        def kernel(t: pa.Table) -> list[pa.RecordBatch]:
            return _kept(t, segment).combine_chunks().to_batches()

        top = max((r["level"] for r in old), default=0) + 1
        new = self._written(self._merged(old, kernel, ENTRY), top)
        self._commit([r for r in self.runs if r not in old] + [new])

    def compact(self) -> None:
        """Make one run of all, without the entries that later ones shadow for good."""
        if self.runs:
            self._compact(None)

    def vacuum(self) -> None:
        """Remove the folders of runs that the manifest no longer names."""
        live = {r["name"] for r in self.runs}
        found = {m.group(1) for f in list_files(self.spark, self.path, recursive=True) if (m := re.search(r"/(run-[0-9a-f]{32})/", f))}
        for name in found - live:
            remove_path(self.spark, f"{self.path}/{name}")

    def entries(self) -> DataFrame:
        """All entries of the live runs, as they lie."""
        paths = [f"{self.path}/{r['name']}" for r in self.runs]
        return self.spark.read.schema(ENTRY).parquet(*paths) if paths else self.spark.createDataFrame([], ENTRY)

    def state(self) -> DataFrame:
        """key, first_set, second_set (sorted, distinct) of the present keys."""
        segment = self.segment

        def kernel(t: pa.Table) -> list[pa.RecordBatch]:
            return [_summarised(t, segment)]

        ranges = self._merged(self.runs, kernel, SUMMARY)
        pair = lambda name: F.when(F.col(f"{name}_seq").isNotNull(), F.struct(F.col(f"{name}_seq").alias("seq"), F.col(f"{name}_set").alias("v"))).alias(name)
        return _joined(ranges.select("key", "gone", "born", pair("first"), pair("second")))


def facets(state: DataFrame) -> DataFrame:
    """State as rows: (key, ``present``, ''), (key, ``keyword``, k), (key, ``mailbox``, id)."""
    item = lambda kind, value: F.struct(F.lit(kind).alias("facet"), value.alias("value"))
    return state.select(
        F.col("key").alias("message_id"),
        F.explode(
            F.concat(
                F.array(item("present", F.lit(""))),
                F.transform("first_set", lambda k: item("keyword", k)),
                F.transform("second_set", lambda m: item("mailbox", m)),
            )
        ).alias("x"),
    ).select("message_id", "x.facet", "x.value")


def apply_changes(event_log: DataFrame, runs: int = FANOUT + 2) -> DataFrame:
    """Current messages of an event log, through a change store: key, first_set (keywords), second_set (mailboxes).

    The log comes in ``runs`` runs; the first ``FANOUT`` of them are compacted on the way, the rest are merged when read.
    """
    store = ChangeStore(event_log.sparkSession)
    store.append(message_changes(event_log), runs=runs)
    return store.state()
