"""Filter clauses of the search language as column predicates over messages."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.operators.listing import has
from postmill.plans.query_language import Clause


def _people(*columns: str):
    empty = F.array().cast("array<struct<name:string,address:string>>")
    return F.concat(*[F.coalesce(c, empty) for c in columns])


def _named(people: Column, value: str) -> Column:
    return F.exists(people, lambda p: F.contains(F.lower(F.concat_ws(" ", p["name"], p["address"])), F.lit(value.lower())))


def predicate(clause: Clause) -> Column:
    """Column for one clause other than ``in:``, never null."""
    v = clause.value
    low = F.lit(v.lower())
    if clause.kind == "from":
        test = _named(_people("from_addr"), v)
    elif clause.kind == "to":
        test = _named(_people("to_addr", "cc_addr"), v)
    elif clause.kind == "subject":
        test = F.contains(F.lower("subject"), low)
    elif clause.kind == "list":
        test = F.contains(F.lower("list_id"), low)
    elif clause.kind == "keyword":
        test = has("keywords", v)
    elif clause.kind == "attachment":
        test = F.col("has_attachment")
    elif clause.kind == "before":
        test = F.col("received_at") < F.lit(datetime.fromisoformat(v))
    elif clause.kind == "after":
        test = F.col("received_at") >= F.lit(datetime.fromisoformat(v))
    else:
        raise ValueError(f"not a filter: {clause.kind}")
    test = F.coalesce(test, F.lit(False))
    return ~test if clause.negated else test


def named_mailboxes(mailboxes: DataFrame, account: str, value: str) -> DataFrame:
    """Ids of the account's mailboxes that ``in:value`` names: by name, in any case, or by id."""
    rows = mailboxes.filter((F.col("account_id") == account) & ((F.lower(F.trim("name")) == value.lower()) | (F.col("id") == value)))
    return rows.select(F.col("id").alias("mailbox_id")).distinct()


def all_of(account: str, clauses: list[Clause]) -> Column:
    """The account and all clauses but those of mailboxes."""
    return reduce(Column.__and__, [predicate(c) for c in clauses if c.kind != "mailbox"], F.col("account_id") == account)


def matching(messages: DataFrame, mailboxes: DataFrame, account: str, clauses: list[Clause]) -> DataFrame:
    """The account's messages that all clauses let through. Mailboxes are resolved by a semi join, an anti join where negated,
    of the messages the other clauses leave; so any number of mailboxes may bear a name."""
    rows = messages.filter(all_of(account, clauses))
    for c in clauses:
        if c.kind == "mailbox":
            placed = rows.select("id", F.explode("mailbox_ids").alias("mailbox_id"))
            held = placed.join(named_mailboxes(mailboxes, account, c.value), "mailbox_id", "left_semi").select("id").distinct()
            rows = rows.join(held, "id", "left_anti" if c.negated else "left_semi")
    return rows
