"""The search index on disk: postings by token, documents, and a manifest with the statistics.

Documents come in *segments*. A segment holds postings (token, field, message, positions), partitioned by a hash of the token
and sorted by it, and documents (message, account, length, body tokens), partitioned by a hash of the message. A search reads
the partitions of its own words only, in all accounts for the statistics. Adding a message that is there replaces it: its old
place (message, segment) becomes a row of the table of the dead, which is anti-joined; so deleting reads ids and lengths,
never postings, and costs the same however large the index. ``optimise`` rewrites the live rows as one segment. Number and
total length of the live documents stand in the manifest and are kept by every change.

Scale: one shuffle of postings, by (token bucket, salt), so the postings of a word that is everywhere are split over ``SALT``
writers; nothing is gathered but the manifest.

Edge cases: repeated rows of a message count once; null fields have no tokens; removing what is not there does nothing; an
index without documents answers every search with no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import tokens
from postmill.session import list_files, materialise, read_text, remove_path, spread, write_new

FIELDS = ("subject", "sender", "recipients", "body")
BUCKETS = 64
SALT = 8
POSTINGS = "token string, field int, message_id string, account_id string, dl bigint, positions array<int>"
DOCUMENTS = "message_id string, account_id string, dl bigint, body array<string>"
DEAD = "message_id string, segment string"


def unique_documents(documents: DataFrame) -> DataFrame:
    """One row per message: repeated rows fall together, of differing ones the greatest stays."""
    rest = [c for c in documents.columns if c != "message_id"]
    return documents.groupBy("message_id").agg(F.max(F.struct(*rest)).alias("d")).select("message_id", "d.*")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each field with their places, document by document; sent on in batches of bounded size."""
    schema = pa.schema([("token", pa.string()), ("field", pa.int32()), ("message_id", pa.string()), ("account_id", pa.string()), ("dl", pa.int64()), ("positions", pa.list_(pa.int32()))])
    rows: list[tuple] = []
    for b in batches:
        heads = zip(b["message_id"].to_pylist(), b["account_id"].to_pylist(), b["dl"].to_pylist())
        for (message, account, dl), *fields in zip(heads, *(b[f].to_pylist() for f in FIELDS)):
            for k, words in enumerate(fields):
                places: dict[str, list[int]] = {}
                for at, w in enumerate(words):
                    places.setdefault(w, []).append(at)
                rows += [(w, k, message, account, dl, at) for w, at in places.items()]
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class SearchIndex:
    """An index in a folder that all executors share; opened where there is one, else empty. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        numbers = [int(m.group(1)) for f in list_files(spark, f"{self.path}/manifest") if (m := re.search(r"/v(\d+)\.json$", f))]
        self.version = max(numbers, default=0)
        state = json.loads(read_text(spark, f"{self.path}/manifest/v{self.version}.json")) if self.version else {"buckets": buckets, "segments": [], "dead": [], "documents": 0, "length": 0}
        self.buckets, self.segments, self.dead, self.documents, self.length = (state[k] for k in ("buckets", "segments", "dead", "documents", "length"))

    def _commit(self, segments: list[str], dead: list[str], documents: int, length: int) -> None:
        text = json.dumps({"buckets": self.buckets, "segments": segments, "dead": dead, "documents": documents, "length": length})
        write_new(self.spark, f"{self.path}/manifest/v{self.version + 1}.json", text)
        self.version, self.segments, self.dead, self.documents, self.length = self.version + 1, segments, dead, documents, length

    def bucket(self, of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, schema: str) -> DataFrame:
        """Rows of all segments with their segment, the dead ones left out; ``bucket`` is a partition column."""
        if not self.segments:
            return self.spark.createDataFrame([], f"{schema}, segment string, bucket int")
        rows = self.spark.read.schema(f"{schema}, segment string, bucket int").option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s}" for s in self.segments])
        if not self.dead:
            return rows
        gone = self.spark.read.schema(DEAD).parquet(*[f"{self.path}/dead/{d}" for d in self.dead])
        return rows.join(gone, ["message_id", "segment"], "left_anti")

    def postings(self, words: list[str]) -> DataFrame:
        """Postings of some words; only their buckets are read."""
        buckets = {r[0] for r in self.spark.range(1).select(F.explode(F.array(*[self.bucket(F.lit(w)) for w in words]))).collect()} if words else set()
        return self._read("postings", POSTINGS).filter(F.col("bucket").isin(sorted(buckets)) & F.col("token").isin(words))

    def all_postings(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def live(self) -> DataFrame:
        """message_id, account_id, dl, body, segment of the live documents."""
        return self._read("documents", DOCUMENTS)

    def count(self) -> int:
        return self.documents

    def _kill(self, places: DataFrame) -> tuple[str | None, int, int]:
        """Write (message_id, segment, dl) rows to the dead; returns the table's name, how many they are and their total length."""
        if not self.segments:
            return None, 0, 0
        gone = materialise(places.select("message_id", "segment", "dl").distinct(), "dead")
        n, length = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return None, 0, 0
        name = uuid.uuid4().hex
        gone.select("message_id", "segment").write.parquet(f"{self.path}/dead/{name}")
        return name, n, length

    def add(self, documents: DataFrame) -> None:
        """Add or replace documents (message_id, account_id and the four fields; other columns are ignored)."""
        rows = unique_documents(documents.select("message_id", "account_id", *FIELDS).filter("message_id is not null"))
        words = spread(rows).select("message_id", "account_id", *[tokens(F.col(f)).alias(f) for f in FIELDS])
        words = words.withColumn("dl", sum((F.size(f) for f in FIELDS), F.lit(0)).cast("bigint"))
        segment = uuid.uuid4().hex
        # tokenised once: the documents are written first, and read again for the postings
        words.withColumn("bucket", self.bucket(F.col("message_id"))).repartition("bucket").sortWithinPartitions("bucket", "message_id").write.partitionBy("bucket").parquet(f"{self.path}/documents/segment={segment}")
        schema = "message_id string, account_id string, dl bigint, " + ", ".join(f"{f} array<string>" for f in FIELDS)
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/documents/segment={segment}")
        made = stored.select("message_id", "account_id", "dl", *FIELDS).mapInArrow(_postings, POSTINGS).withColumn("bucket", self.bucket(F.col("token")))
        (
            made.repartition("bucket", F.pmod(F.xxhash64("message_id"), F.lit(SALT))).sortWithinPartitions("bucket", "token", "account_id", "message_id")
            .write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        )
        n, length = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        name, fewer, shorter = self._kill(self.live().join(stored.select("message_id"), "message_id", "left_semi"))
        self._commit([*self.segments, segment], [*self.dead, *([name] if name else [])], self.documents + n - fewer, self.length + length - shorter)

    def remove(self, ids: DataFrame) -> None:
        """Remove the messages of ``ids`` (message_id)."""
        self._less(self.live().join(ids.select("message_id"), "message_id", "left_semi"))

    def clear(self, account: str) -> None:
        """Remove all messages of an account."""
        self._less(self.live().filter(F.col("account_id") == account))

    def _less(self, places: DataFrame) -> None:
        name, fewer, shorter = self._kill(places)
        if name:
            self._commit(self.segments, [*self.dead, name], self.documents - fewer, self.length - shorter)

    def optimise(self) -> None:
        """Rewrite the live rows as one segment and forget the dead."""
        if len(self.segments) < 2 and not self.dead:
            return
        segment, old = uuid.uuid4().hex, self.segments
        fields = ", ".join(f"{f} array<string>" for f in FIELDS)
        documents = self._read("documents", f"message_id string, account_id string, dl bigint, {fields}").drop("segment")
        documents.repartition("bucket").sortWithinPartitions("bucket", "message_id").write.partitionBy("bucket").parquet(f"{self.path}/documents/segment={segment}")
        postings = self.all_postings().drop("segment")
        (
            postings.repartition("bucket", F.pmod(F.xxhash64("message_id"), F.lit(SALT))).sortWithinPartitions("bucket", "token", "account_id", "message_id")
            .write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={segment}")
        )
        self._commit([segment], [], self.documents, self.length)
        for s in old:
            remove_path(self.spark, f"{self.path}/documents/segment={s}")
            remove_path(self.spark, f"{self.path}/postings/segment={s}")
