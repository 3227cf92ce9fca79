"""Pending changes: the intent log, their optimistic effect, and reconciling with a server's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.schemas import OUTSTANDING, value_set


def record(log: DataFrame, new: DataFrame) -> DataFrame:
    """Intents to append: those whose id is not known yet, once each."""
    return new.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti")


def outstanding(log: DataFrame, account: str, limit: int = 200) -> DataFrame:
    return log.filter((F.col("account_id") == account) & F.col("state").isin(*OUTSTANDING)).orderBy("created_at", "id").limit(limit)


def count_by_state(log: DataFrame) -> DataFrame:
    return log.groupBy("account_id", "state").agg(F.count("*").alias("n"))


def count_outstanding(log: DataFrame) -> DataFrame:
    return log.groupBy("account_id").agg(F.count_if(F.col("state").isin(*OUTSTANDING)).alias("n"))


def update(log: DataFrame, patches: DataFrame) -> DataFrame:
    """Log with state, attempts and error of ``patches`` (id and any of these); what a patch leaves null stays."""
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in ("state", "attempts", "last_error") if c in patches.columns])
    joined = log.join(p, "id", "left")
    for c in ("state", "attempts", "last_error"):
        if f"_{c}" in joined.columns:
            joined = joined.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return joined


def changed_set(current: Column, add: Column, remove: Column) -> Column:
    """The set after removing, then adding: a value in both is in."""
    empty = F.array().cast("array<string>")
    return value_set(F.array_union(F.array_except(F.coalesce(current, empty), F.coalesce(remove, empty)), F.coalesce(add, empty)))


def local_events(intents: DataFrame, messages: DataFrame) -> DataFrame:
    """Events (absolute sets, removals) that show intents before the server has answered, applied in order of creation.

    Whether a value is in a set afterwards is told by the last intent that names it (in one that adds and removes it, adding wins), and by
    the set itself where none does. So the order is a maximum per value, combined before the shuffle; no list of a message's intents is
    ever gathered, only its different values.
    """
    empty = F.array().cast("array<string>")
    named = lambda c, flag: F.transform(F.coalesce(c, empty), lambda v: F.named_struct(F.lit("v"), v, F.lit("on"), F.lit(flag)))
    rows = intents.filter(F.col("op").isin("keywords.change", "mailboxes.change", "message.destroy")).select(
        "account_id", "op", "created_at", F.col("id").alias("intent_id"), F.concat(named("remove", 0), named("add", 1)).alias("values"), F.explode("message_ids").alias("message_id")
    )
    touched = rows.select("account_id", "message_id", "op", "created_at", "intent_id", F.explode_outer("values").alias("x"))
    last = touched.groupBy("account_id", "message_id", "op", F.col("x.v").alias("v")).agg(F.max(F.struct("created_at", "intent_id", "x.on")).alias("by"))
    at = lambda op, on: F.collect_set(F.when((F.col("op") == op) & (F.col("by.on") == on), F.col("v")))
    per = last.groupBy("account_id", "message_id").agg(
        at("keywords.change", 1).alias("k_on"), at("keywords.change", 0).alias("k_off"), at("mailboxes.change", 1).alias("m_on"), at("mailboxes.change", 0).alias("m_off"),
        F.bool_or(F.col("op") == "message.destroy").alias("gone"),
    )
    state = per.join(messages.select(F.col("id").alias("message_id"), "keywords", "mailbox_ids"), "message_id")
    after = state.select(
        "account_id", "message_id", "gone", changed_set(F.col("keywords"), F.col("k_on"), F.col("k_off")).alias("k"), changed_set(F.col("mailbox_ids"), F.col("m_on"), F.col("m_off")).alias("m"),
        value_set(F.col("keywords")).alias("k0"), value_set(F.col("mailbox_ids")).alias("m0"),
    )
    none = F.lit(None).cast("array<string>")
    event = lambda t, values: F.struct(F.lit(t).alias("type"), values.alias("values"))
    events = F.array_compact(
        F.array(
            F.when(F.col("gone"), event("message.removed", none)),
            F.when(~F.col("gone") & (F.col("k") != F.col("k0")), event("message.keywords.set", F.col("k"))),
            F.when(~F.col("gone") & (F.col("m") != F.col("m0")), event("message.mailboxes.set", F.col("m"))),
        )
    )
    return after.select("account_id", "message_id", F.explode(events).alias("e")).select("account_id", "message_id", "e.type", "e.values")


def refresh_events(local: DataFrame, server: DataFrame) -> DataFrame:
    """Events that make the local state equal the server's: message_id, type, values. The server wins.

    ``local`` and ``server``: id, keywords, mailbox_ids. What the server does not know is removed.
    """
    a = local.select("id", value_set(F.col("keywords")).alias("k"), value_set(F.col("mailbox_ids")).alias("m"), F.lit(True).alias("here"))
    b = server.select("id", value_set(F.col("keywords")).alias("k2"), value_set(F.col("mailbox_ids")).alias("m2"), F.lit(True).alias("there"))
    none = F.lit(None).cast("array<string>")
    event = lambda t, values: F.struct(F.lit(t).alias("type"), values.alias("values"))
    events = F.array_compact(
        F.array(
            F.when(F.col("there").isNull(), event("message.removed", none)),
            F.when(F.col("here").isNull(), event("message.observed", none)),
            F.when(F.col("there") & ~F.col("k").eqNullSafe(F.col("k2")), event("message.keywords.set", F.col("k2"))),
            F.when(F.col("there") & ~F.col("m").eqNullSafe(F.col("m2")), event("message.mailboxes.set", F.col("m2"))),
        )
    )
    return a.join(b, "id", "full_outer").select(F.col("id").alias("message_id"), F.explode(events).alias("e")).select("message_id", "e.type", "e.values")
