"""Annotations of messages: reading what holds now, and writing without a second copy.

An annotation is named by (subject_kind, subject_id, namespace, key, producer); writing one that is there replaces it. Nothing is
derived from annotations, so they may be dropped at any time and made again (``plans.rules.stale`` tells which).

Edge cases: of several drafts of one name in a batch the latest stays, then the greatest id; a confidence outside 0 to 1 fails the
batch; null expiry never expires; empty tables give empty results.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("subject_kind", "subject_id", "namespace", "key", "producer")


def write(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """``existing`` with ``drafts`` in it: one row a name, a draft before what was there. One shuffle by name, combined before it."""
    bad = F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)
    checked = drafts.withColumn("confidence", F.when(bad, F.raise_error(F.concat(F.lit("input.invalid: confidence of "), F.col("id")))).otherwise(F.col("confidence")))
    rows = existing.withColumn("_new", F.lit(0)).unionByName(checked.select(*existing.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in existing.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct("_new", F.coalesce("created_at", F.timestamp_seconds(F.lit(0))), "id")).alias("x")
    return rows.groupBy(*KEY).agg(newest).select(*KEY, "x.*").select(*existing.columns)


def listed(annotations: DataFrame, now: datetime, subject_id: str | None = None, namespace: str | None = None) -> DataFrame:
    """What holds at ``now``, of one subject or namespace if given; the filters reach the scan."""
    rows = annotations.filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    if subject_id is not None:
        rows = rows.filter(F.col("subject_id") == subject_id)
    return rows if namespace is None else rows.filter(F.col("namespace") == namespace)
