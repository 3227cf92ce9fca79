"""The event log: appending, scanning, and the tables that follow from it.

Replay is stateless: every projection is an aggregate over the whole log (or over one partition of it), so
a rebuild and an incremental overwrite give the same rows, in whatever order the entries arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.changes import facets, merge, message_changes
from postmill.schemas import valid_event
from postmill.session import materialise


def append(log: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries`` with the next sequence numbers, in order of ``position``; an invalid one fails the whole batch.

    One writer per log. The batch is sorted by range and numbered range by range: what is gathered is one count a partition.
    """
    start = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("m")).first()[0]
    checked = entries.withColumn(
        "type", F.when(valid_event(F.col("type"), F.col("payload")), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("input.invalid: "), F.coalesce("type", F.lit("null")))))
    )
    ordered = materialise(checked.repartitionByRange("position").sortWithinPartitions("position").withColumn("_at", F.monotonically_increasing_id()), "append")
    place = F.shiftright("_at", 33)  # the partition; the rest is the row's number in it
    counts = ordered.groupBy(place.alias("p")).count().orderBy("p").collect()
    before, offsets = start, []
    for r in counts:
        offsets.append((r["p"], before))
        before += r["count"]
    known = F.create_map(*[F.lit(x).cast("bigint") for pair in offsets for x in pair]) if offsets else F.lit(None).cast("map<bigint,bigint>")
    return ordered.withColumn("seq", known[place] + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("position", "_at")


def since(log: DataFrame, account: str, seq: int, limit: int = 10_000) -> DataFrame:
    """The account's entries after ``seq``, in order."""
    return log.filter((F.col("account_id") == account) & (F.col("seq") > seq)).orderBy("seq").limit(limit)


def distinct_entries(log: DataFrame) -> DataFrame:
    """Every seq once."""
    return log.dropDuplicates(["seq"])


def latest(log: DataFrame) -> DataFrame:
    """Last seq (0 for an empty log) and number of distinct entries."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest_seq"), F.count_distinct("seq").alias("entries"))


def replay_sets(log: DataFrame) -> DataFrame:
    """message_id, facet, value of the live messages."""
    return facets(merge(message_changes(log)))


def collected_sets(log: DataFrame) -> DataFrame:
    """message_id, keywords, mailbox_ids (sorted) of the live messages that have any."""
    of = lambda facet: F.array_sort(F.collect_set(F.when(F.col("facet") == facet, F.col("value"))))
    return replay_sets(log).groupBy("message_id").agg(of("keyword").alias("keywords"), of("mailbox").alias("mailbox_ids"))


def replay_messages(log: DataFrame) -> DataFrame:
    """Live messages: the fields of their latest observation, account and provider id of the first after the last removal."""
    live = message_changes(log).groupBy("key").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"))
    seen = log.filter(F.col("type") == "message.observed").select(
        F.col("payload.message_id").alias("key"), "seq", "account_id", "payload.blob_id", "payload.provider_id", "payload.received_at"
    )
    after = seen.join(live, "key").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return after.groupBy(F.col("key").alias("message_id")).agg(
        F.min_by("account_id", "seq").alias("account_id"),
        F.min_by("provider_id", "seq").alias("provider_id"),
        F.max_by("blob_id", "seq").alias("blob_id"),
        F.max_by("received_at", "seq").alias("received_at"),
    )


def replay_mailboxes(log: DataFrame) -> DataFrame:
    """Mailboxes with an upsert after their last removal: name and role of the last upsert, the account of the first since then."""
    rows = log.filter(F.col("type").isin("mailbox.upserted", "mailbox.removed")).select(
        F.coalesce(F.col("payload.mailbox.id"), F.col("payload.mailbox_id")).alias("mailbox_id"),
        "seq",
        "account_id",
        (F.col("type") == "mailbox.removed").alias("removed"),
        F.col("payload.mailbox.name").alias("name"),
        F.col("payload.mailbox.role").alias("role"),
    )
    gone = rows.groupBy("mailbox_id").agg(F.max(F.when(F.col("removed"), F.col("seq"))).alias("gone"))
    live = rows.filter(~F.col("removed")).join(gone, "mailbox_id").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return live.groupBy("mailbox_id").agg(
        F.min_by("account_id", "seq").alias("account_id"), F.max_by("name", "seq").alias("name"), F.max_by("role", "seq").alias("role")
    )


def replay_cursors(log: DataFrame) -> DataFrame:
    """Last cursor of each account and collection, and when it was set (null where the entry has no time)."""
    rows = log.filter(F.col("type") == "sync.cursor.advanced").select("seq", "account_id", "event_at", F.col("payload.collection").alias("collection"), F.col("payload.cursor").alias("cursor"))
    return rows.groupBy("account_id", "collection").agg(F.max_by(F.struct("cursor", "event_at"), "seq").alias("x")).select(
        "account_id", "collection", "x.cursor", F.col("x.event_at").alias("updated_at")
    )


def blob_sizes(log: DataFrame) -> DataFrame:
    """blob_id and size of every blob the log says is stored."""
    return log.filter(F.col("type") == "blob.stored").groupBy(F.col("payload.blob_id").alias("blob_id")).agg(F.max("payload.size").alias("size"))


def conflicts(messages: DataFrame) -> DataFrame:
    """Provider ids that two messages of one account claim: a batch that has any must not be applied."""
    return messages.groupBy("account_id", "provider_id").agg(F.count_distinct("message_id").alias("n"), F.min("message_id").alias("first"), F.max("message_id").alias("last")).filter("n > 1")


def snapshot(df: DataFrame, kind: str, key: Column) -> DataFrame:
    """kind, id, row: a table as sorted JSON, for comparing two states with ``exceptAll``."""
    return df.select(F.lit(kind).alias("kind"), key.alias("id"), F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("row"))


def same(left: DataFrame, right: DataFrame) -> bool:
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
