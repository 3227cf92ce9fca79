"""Messages delivered more than once: keyed state of seen identifiers, with late-arrival lookup.

Stage 1 is a Structured Streaming query: every delivery yields its identifiers as keys (account and
provider id; account, Message-ID and sender address), and ``dropDuplicatesWithinWatermark`` keeps the
first delivery of each key in the state store (RocksDB). State expires with the event-time watermark;
the checkpoint and the file sink's log commit together, so each key is emitted once per life of its state.
Stage 2 is the late-arrival lookup: all deliveries look their keys up in the emitted table, which also
finds keys whose state has expired. A key that was emitted again after expiry resolves to its first
emission; a delivery the stream refused as too late resolves among the late ones. Stage 3 links the
anchors of a delivery's two keys (connected components over the few that differ).

Edge cases: a null or blank identifier matches nothing; a null account matches nothing; null delivery
times count as the epoch; an empty table gives an empty result; further columns are kept by ``unique``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.ids import first_message_id
from postmill.operators.components import connected_components
from postmill.session import materialise, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def identifier_keys() -> Column:
    """Array of the (at most two) identifier keys of a delivery."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    sender = blank(F.lower(F.get("from_addr", F.lit(0))["address"]))
    sep = F.lit("\x1f")
    return F.filter(
        F.array(
            F.concat(F.lit("p"), sep, F.col("account_id"), sep, blank(F.col("provider_id"))),
            F.concat(F.lit("m"), sep, F.col("account_id"), sep, first_message_id(F.col("message_id_header")), sep, sender),
        ),
        lambda k: k.isNotNull(),
    )


def keyed(messages: DataFrame) -> DataFrame:
    """delivery_id, event time and one row per identifier key (128-bit digest of it)."""
    return messages.select(
        "delivery_id",
        F.coalesce("delivered_at", F.timestamp_seconds(F.lit(0))).alias("at"),
        F.explode(identifier_keys()).alias("k"),
    ).select("delivery_id", "at", F.unhex(F.md5("k")).alias("key"))


def seen_identifiers(
    spark: SparkSession, path: str, schema, expiry: str = "30 days", files_per_batch: int = 1000
) -> DataFrame:
    """Run the stream over all files at ``path`` that are there now; returns the emitted (key, delivery_id)."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    out, check = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    try:
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # streams read folders
            reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
        rows = keyed(reader.parquet(path)).withWatermark("at", expiry)
        query = (
            rows.dropDuplicatesWithinWatermark(["key"])
            .select("key", "delivery_id")
            .writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", check)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)
    return spark.read.schema("key binary, delivery_id bigint").parquet(out)


def classes(messages: DataFrame, seen: DataFrame) -> DataFrame:
    """delivery_id, class_id: the class is named by its first anchor; deliveries without identifiers are their own."""
    first = seen.groupBy("key").agg(F.min("delivery_id").alias("anchor"))
    looked = keyed(messages).select("delivery_id", "key").join(first, "key", "left")
    looked = materialise(looked.select("delivery_id", "key", "anchor"), "anchors")
    late = looked.filter(F.col("anchor").isNull())
    resolved = looked.filter(F.col("anchor").isNotNull()).select("delivery_id", "anchor")
    if not late.isEmpty():  # refused by the watermark: they resolve among themselves
        own = late.groupBy("key").agg(F.min("delivery_id").alias("own"))
        resolved = resolved.unionByName(late.join(own, "key").select("delivery_id", F.col("own").alias("anchor")))
    per = resolved.groupBy("delivery_id").agg(F.min("anchor").alias("a"), F.max("anchor").alias("b"))
    # an anchor's own two keys link it too: a delivery may be first for one key and a copy for the other
    links = per.filter(F.col("a") != F.col("b")).select("a", "b")
    named = connected_components(links).withColumnRenamed("component", "c")
    return (
        messages.select("delivery_id")
        .join(per, "delivery_id", "left")
        .join(named, F.col("a") == F.col("node"), "left")
        .select("delivery_id", F.coalesce("c", "a", "delivery_id").alias("class_id"))
    )


def message_classes(spark: SparkSession, path: str, **options) -> DataFrame:
    """delivery_id and class_id of every delivery in the Parquet table at ``path``."""
    messages = spark.read.parquet(path)
    return classes(messages, seen_identifiers(spark, path, messages.schema, **options))


def unique_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row per message and account: the delivery with the least (delivered_at, delivery_id) of each class."""
    messages = spark.read.parquet(path)
    named = message_classes(spark, path, **options)
    order = F.struct(F.coalesce("delivered_at", F.timestamp_seconds(F.lit(0))), F.col("delivery_id"))
    kept = (
        messages.select("delivery_id", "delivered_at")
        .join(named, "delivery_id")
        .groupBy("class_id")
        .agg(F.min_by("delivery_id", order).alias("delivery_id"), F.count("*").alias("deliveries"))
    )
    return messages.drop("class_id", "deliveries").join(kept.select("delivery_id", "class_id", "deliveries"), "delivery_id")


def class_sizes(named: DataFrame) -> DataFrame:
    """class_id, deliveries of the classes of two or more: the duplicates without a row for each pair."""
    return named.groupBy("class_id").agg(F.count("*").alias("deliveries")).filter("deliveries > 1")


def duplicate_pairs(named: DataFrame) -> DataFrame:
    """All pairs of deliveries of one class, the smaller id first. Only classes of two or more meet themselves.

    The pairs of a class of n are n(n-1)/2 rows; where that is too many, ``class_sizes`` and the classes themselves say the same.
    """
    several = materialise(named.join(class_sizes(named).select("class_id").hint("merge"), "class_id", "left_semi"), "several")
    left = several.select("class_id", F.col("delivery_id").alias("delivery_id_1"))
    right = several.select("class_id", F.col("delivery_id").alias("delivery_id_2"))
    return left.join(right.hint("merge"), "class_id").filter("delivery_id_1 < delivery_id_2").select("delivery_id_1", "delivery_id_2")
