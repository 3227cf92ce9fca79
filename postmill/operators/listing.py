"""Reading messages, mailboxes and threads: filters, keyset pages, counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_messages(deliveries: DataFrame, account: str | None = None) -> DataFrame:
    """One row per message id: the delivery with the greatest delivery_id. Combines on the map side, so no id is hot.

    ``account`` restricts the deliveries before that (an id belongs to one account), so the filter reaches the scan.
    """
    if account is not None:
        deliveries = deliveries.filter(F.col("account_id") == account)
    rest = [c for c in deliveries.columns if c not in ("id", "delivery_id")]
    # one aggregate for each column: those a query does not use are pruned, down to the scan
    return deliveries.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.max("delivery_id").alias("delivery_id"), *[F.max_by(c, "delivery_id").alias(c) for c in rest]
    )


def current_mailboxes(mailboxes: DataFrame) -> DataFrame:
    """Mailboxes without repeated rows, names without stray blanks."""
    return mailboxes.withColumn("name", F.trim("name")).distinct()


@dataclass(frozen=True)
class Filter:
    """Conditions of a list request; None and empty mean no condition."""

    account: str
    mailbox: str | None = None
    thread: str | None = None
    keywords: tuple[str, ...] = ()
    not_keywords: tuple[str, ...] = ()
    received_after: datetime | None = None
    received_before: datetime | None = None
    after: tuple[datetime, str] | None = None  # the last row of the page before: (received_at, id)
    limit: int = 50


def has(column: str, value: str) -> Column:
    return F.coalesce(F.array_contains(column, value), F.lit(False))


def condition(f: Filter) -> Column:
    tests = [F.col("account_id") == f.account]
    if f.mailbox is not None:
        tests.append(has("mailbox_ids", f.mailbox))
    if f.thread is not None:
        tests.append(F.col("thread_id") == f.thread)
    tests += [has("keywords", k) for k in f.keywords] + [~has("keywords", k) for k in f.not_keywords]
    if f.received_after is not None:
        tests.append(F.col("received_at") >= F.lit(f.received_after))
    if f.received_before is not None:
        tests.append(F.col("received_at") < F.lit(f.received_before))
    if f.after is not None:
        at, last = F.lit(f.after[0]), f.after[1]
        tests.append((F.col("received_at") < at) | ((F.col("received_at") == at) & (F.col("id") < last)))
    return reduce(Column.__and__, tests)


def list_messages(messages: DataFrame, f: Filter) -> DataFrame:
    """One page, newest first, ties by id; the account filter reaches the scan and the page is a top-k, not a sort."""
    return messages.filter(condition(f)).orderBy(F.desc("received_at"), F.desc("id")).limit(f.limit)


def read_message(messages: DataFrame, message_id: str) -> DataFrame:
    return messages.filter(F.col("id") == message_id)


def list_mailboxes(mailboxes: DataFrame, account: str) -> DataFrame:
    return mailboxes.filter(F.col("account_id") == account).orderBy("sort_order", "name", "id")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account_id").agg(F.count("*").alias("messages"))


def thread_members(messages: DataFrame) -> DataFrame:
    """Per thread: size, last date, member ids from old to new. Threads are bounded by what a conversation holds."""
    return messages.filter(F.col("thread_id").isNotNull()).groupBy("account_id", "thread_id").agg(
        F.count("*").alias("message_count"),
        F.max("received_at").alias("last_message_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("received_at", "id"))), lambda x: x["id"]).alias("message_ids"),
    )


def participants(messages: DataFrame) -> DataFrame:
    """Per thread: everyone on it by first appearance (message date, then from, to, cc), once per address."""
    empty = F.array().cast("array<struct<name:string,address:string>>")
    people = F.concat(*[F.coalesce(c, empty) for c in ("from_addr", "to_addr", "cc_addr")])
    rows = messages.filter(F.col("thread_id").isNotNull()).select("account_id", "thread_id", "received_at", "id", F.posexplode(people).alias("pos", "p"))
    key = F.lower("p.address")
    first = rows.filter(F.coalesce(key, F.lit("")) != "").groupBy("account_id", "thread_id", key.alias("address")).agg(
        F.min(F.struct("received_at", "id", "pos")).alias("at")
    )
    return first.groupBy("account_id", "thread_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "address"))), lambda x: x["address"]).alias("participants")
    )


def nearest_rank(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """``by`` and the percentile of ``value`` by nearest rank: element floor(n * share) of the sorted values, the last one at most.

    Equal values are counted first, so what is ordered within a group are its different values, each with how many lie up to it.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(by))
    ranked = counted.select(by, value, upto.alias("_upto"), F.least(total - 1, F.floor(total * share)).alias("_at"))
    return ranked.filter(F.col("_upto") > F.col("_at")).groupBy(by).agg(F.min(value).alias(value))
