"""Content-addressed blobs: put, get, stat, verify, collect garbage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.ids import blob_id


def put(existing: DataFrame, contents: DataFrame) -> DataFrame:
    """Blobs to append: id, size, bytes of the ``bytes`` that are not stored yet; equal contents once, null never.

    The contents are reduced to their digests before they meet the stored ids; no bytes go through the join.
    """
    named = contents.filter(F.col("bytes").isNotNull()).select(blob_id(F.col("bytes")).alias("id"), F.length("bytes").cast("bigint").alias("size"), "bytes")
    return named.join(existing.select("id"), "id", "left_anti").groupBy("id").agg(F.first("size").alias("size"), F.first("bytes").alias("bytes"))


def get(blobs: DataFrame, wanted: str) -> DataFrame:
    """The blob, or a failing query where it is missing."""
    hit = blobs.filter(F.col("id") == wanted).agg(F.first("bytes").alias("bytes"))
    return hit.select(F.when(F.col("bytes").isNull(), F.raise_error(F.lit(f"resource.not_found: {wanted}"))).otherwise(F.col("bytes")).alias("bytes"))


def stat(blobs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """id and size without reading any bytes."""
    rows = blobs.select("id", "size")
    return rows if wanted is None else rows.filter(F.col("id").isin(wanted))


def broken(blobs: DataFrame, *keep: str) -> DataFrame:
    """Ids of the blobs whose content does not match them, with further columns to ``keep``."""
    return blobs.filter(~F.col("id").eqNullSafe(blob_id(F.col("bytes")))).select("id", *keep)


def garbage(blobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Blobs that no message refers to."""
    return blobs.join(messages.select(F.col("blob_id").alias("id")), "id", "left_anti")
