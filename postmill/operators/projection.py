"""The tables that follow from the log and the blobs, kept on disk: messages, mailboxes, threads, cursors.

A projection is a folder with one Parquet table each, partitioned by account. ``rebuild`` makes all of them from the whole
log; ``apply`` takes a batch of new entries and makes those accounts anew that the batch touches, in one job for each
table however many entries the batch has, and threads once for the whole batch. Both use the same stateless replay, so they
give the same rows. ``drop`` empties one account's tables; cursors stay, for they say how far the provider was read.

Observing a message parses its blob (each blob once, however many messages hold it); replaying takes the fields of the
latest observation, the account and provider id of the first since the last removal. Messages get the id of their thread.

Edge cases: a blob that is missing or no message leaves the derived fields null; a size the log does not know is null; an
account without live rows has no rows; an empty log gives empty tables; two messages with one provider id in an account fail
the batch, naming both.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from postmill.functions import mime
from postmill.operators import event_log, listing, threads
from postmill.session import materialise, read_text, remove_path, write_new

TABLES = ("messages", "mailboxes", "threads", "cursors")
PARSED = ("subject", "from_addr", "to_addr", "cc_addr", "bcc_addr", "reply_to_addr", "message_id_header", "in_reply_to", "refs", "list_id", "sent_at", "has_attachment", "preview")


def messages_of(log: DataFrame, blobs: DataFrame, now: datetime) -> DataFrame:
    """Live messages with their sets, sizes and what their blobs say. ``blobs``: id, bytes; ``now`` bounds plausible dates."""
    live = materialise(event_log.replay_messages(log), "live")
    empty = F.array().cast("array<string>")
    wanted = live.select(F.col("blob_id").alias("id")).filter("id is not null").distinct()
    parsed = mime.parse(blobs.select("id", "bytes").join(wanted, "id", "left_semi").dropDuplicates(["id"]), now).select(F.col("id").alias("blob_id"), *PARSED)
    rows = (
        live.join(event_log.collected_sets(log), "message_id", "left")
        .join(event_log.blob_sizes(log), "blob_id", "left")
        .join(parsed, "blob_id", "left")
    )
    sets = {c: F.coalesce(c, empty) for c in ("keywords", "mailbox_ids", "message_id_header", "in_reply_to", "refs")}
    return rows.withColumns(sets).withColumnRenamed("message_id", "id")


def with_thread_ids(messages: DataFrame) -> DataFrame:
    """Messages with ``thread_id``: that of the conversation they belong to by their headers and subjects."""
    placed = threads.assign(messages).select("account_id", "id", threads.thread_id(F.col("root")).alias("thread_id"))
    return messages.drop("thread_id").join(placed, ["account_id", "id"], "left")


def thread_rows(messages: DataFrame) -> DataFrame:
    """account_id, thread_id, subject, counts, member ids and participants of the threads of messages that know theirs."""
    found = threads.threads(messages).join(listing.participants(messages), ["account_id", "thread_id"], "left")
    return found.withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))


def _unclaimed(messages: DataFrame) -> DataFrame:
    """The messages, or a failing query where an account has one provider id twice."""
    bad = event_log.conflicts(messages.withColumnRenamed("id", "message_id").filter("provider_id is not null")).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['account_id']}: {r['provider_id']} is claimed by {r['first']} and {r['last']}" for r in bad))
    return messages


class Projection:
    """The tables of one store in a folder; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _tables(self, log: DataFrame, blobs: DataFrame, now: datetime) -> dict[str, DataFrame]:
        messages = materialise(with_thread_ids(_unclaimed(materialise(messages_of(log, blobs, now), "projected"))), "threaded")
        return {"messages": messages, "mailboxes": event_log.replay_mailboxes(log), "threads": thread_rows(messages), "cursors": event_log.replay_cursors(log)}

    def _write(self, tables: dict[str, DataFrame], mode: str) -> None:
        for name, df in tables.items():
            if mode == "static":  # a new table: its schema lies beside it, for a table without rows has no files
                remove_path(self.spark, f"{self.path}/{name}.schema.json")
                write_new(self.spark, f"{self.path}/{name}.schema.json", df.schema.json())
            out = df.withColumn("account", F.coalesce("account_id", F.lit("")))
            # an account is one writer's task unless it is large; then AQE splits it
            (
                out.hint("rebalance", F.col("account")).write.mode("overwrite").option("partitionOverwriteMode", mode)
                .partitionBy("account").parquet(f"{self.path}/{name}")
            )

    def rebuild(self, log: DataFrame, blobs: DataFrame, now: datetime) -> None:
        """All tables anew from the whole log."""
        self._write(self._tables(log, blobs, now), "static")

    def apply(self, log: DataFrame, entries: DataFrame, blobs: DataFrame, now: datetime) -> None:
        """Follow a batch: ``log`` is the whole log with ``entries`` in it; the accounts of these are made anew, all others stay."""
        touched = materialise(entries.select("account_id").distinct(), "touched")
        tables = self._tables(log.join(touched, "account_id", "left_semi"), blobs, now)
        self._write(tables, "dynamic")
        for name, df in tables.items():  # a dynamic overwrite leaves partitions that have no rows any more
            for r in touched.join(df.select("account_id").distinct(), "account_id", "left_anti").toLocalIterator():
                self._remove(name, r["account_id"])

    def _remove(self, name: str, account: str) -> None:
        remove_path(self.spark, f"{self.path}/{name}/account={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(account)}")

    def drop(self, account: str) -> None:
        """Empty the account's tables but for its cursors."""
        for name in TABLES:
            if name != "cursors":
                self._remove(name, account)

    def read(self, name: str, accounts: list[str] | None = None) -> DataFrame:
        """One of ``TABLES``, or some accounts' part of it, which prunes the partitions that are read."""
        own = StructType.fromJson(json.loads(read_text(self.spark, f"{self.path}/{name}.schema.json")))
        rows = self.spark.read.schema(StructType([*own.fields, StructField("account", StringType())])).parquet(f"{self.path}/{name}")
        return (rows if accounts is None else rows.filter(F.col("account").isin(accounts))).drop("account")
