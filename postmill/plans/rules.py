"""Rules and capabilities: condition trees compiled to columns, first-match evaluation, stale annotations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    condition: dict
    actions: tuple[str, ...]
    enabled: bool = True
    trigger: str = "message.observed"  # or message.annotated, manual
    stop_on_match: bool = False


def _addresses(*columns: str) -> Column:
    empty = F.array().cast("array<struct<name:string,address:string>>")
    people = F.concat(*[F.coalesce(c, empty) for c in columns])
    return F.flatten(F.transform(people, lambda p: F.array(F.coalesce(p["name"], F.lit("")), F.coalesce(p["address"], F.lit("")))))


def _field(name: str, path: str | None) -> tuple[str, Column]:
    """Kind (texts, text, number, flag, time) and column of a rule field."""
    texts = {"from": ("from_addr",), "to": ("to_addr",), "cc": ("cc_addr",), "recipients": ("to_addr", "cc_addr", "bcc_addr")}
    if name in texts:
        return "texts", _addresses(*texts[name])
    if name in ("mailbox", "keyword"):
        return "texts", F.coalesce(F.col("mailbox_ids" if name == "mailbox" else "keywords"), F.array().cast("array<string>"))
    if name == "annotation":
        return "text", F.element_at("annotations", F.lit(path or ""))
    columns = {"subject": ("text", "subject"), "body": ("text", "body"), "listId": ("text", "list_id"), "hasAttachment": ("flag", "has_attachment"), "size": ("number", "size"), "receivedAt": ("time", "received_at")}
    kind, column = columns[name]
    return kind, F.col(column)


def _test(op: str, value: Any, kind: str, x: Column) -> Column:
    if op == "exists":
        return x.isNotNull()
    if op == "in":
        return F.lower(x).isin([str(v).lower() for v in value]) if kind == "text" else x.isin(list(value))
    if op in ("gt", "lt"):
        limit = F.lit(value).cast("timestamp") if kind == "time" else F.lit(value)
        return x > limit if op == "gt" else x < limit
    if kind in ("flag", "number", "time"):
        return x == (F.lit(value).cast("timestamp") if kind == "time" else F.lit(value))
    low, wanted = F.lower(x), str(value).lower()
    return {
        "contains": lambda: F.contains(low, F.lit(wanted)), "equals": lambda: low == wanted, "startsWith": lambda: low.startswith(wanted),
        "endsWith": lambda: low.endswith(wanted), "matches": lambda: x.rlike(f"(?i){value}"),
    }[op]()


def compile_condition(c: dict) -> Column:
    """all / any / not over field tests. Total: a null gives false; empty ``all`` is true, empty ``any`` false."""
    if "all" in c:
        return reduce(Column.__and__, map(compile_condition, c["all"]), F.lit(True))
    if "any" in c:
        return reduce(Column.__or__, map(compile_condition, c["any"]), F.lit(False))
    if "not" in c:
        return ~compile_condition(c["not"])
    kind, column = _field(c["field"], c.get("path"))
    if kind == "texts":
        if c["op"] == "exists":
            return F.size(column) > 0
        return F.coalesce(F.exists(column, lambda x: _test(c["op"], c["value"], "text", x)), F.lit(False))
    return F.coalesce(_test(c["op"], c["value"], kind, column), F.lit(False))


def evaluate(messages: DataFrame, rules: list[Rule], trigger: str = "message.observed") -> DataFrame:
    """id, rule_id, actions of all rules that fire, in one scan; nothing after a rule that stops."""
    live = [r for r in rules if r.enabled and r.trigger == trigger]
    fired = F.array(*[
        F.when(compile_condition(r.condition), F.struct(F.lit(i).alias("i"), F.lit(r.id).alias("rule_id"), F.array(*map(F.lit, r.actions)).alias("actions"), F.lit(r.stop_on_match).alias("stop")))
        for i, r in enumerate(live)
    ])
    rows = messages.select("id", F.array_compact(fired).alias("fired"))
    stop = F.array_min(F.transform(F.filter("fired", lambda x: x["stop"]), lambda x: x["i"]))
    return rows.withColumn("last", stop).select("id", F.explode("fired").alias("x"), "last").filter(F.col("last").isNull() | (F.col("x.i") <= F.col("last"))).select("id", "x.rule_id", "x.actions")


def granted(held: Column, required: Column) -> Column:
    """Exact, or by a trailing * inside a namespace (the part before it holds a colon)."""
    return F.exists(
        held, lambda h: (h == required) | (h.endswith("*") & F.contains(F.regexp_replace(h, r"\*$", ""), F.lit(":")) & F.startswith(required, F.regexp_replace(h, r"\*$", "")))
    )


def missing_capabilities(held: Column, required: Column) -> Column:
    return F.filter(required, lambda r: ~granted(held, r))


def stale(inputs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Inputs (subject_id, producer, producer_version, input_hash) that have no annotation of just this version and input."""
    keys = ["subject_id", "producer", "producer_version", "input_hash"]
    return inputs.join(annotations.select(*keys), keys, "left_anti")
