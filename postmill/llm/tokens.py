"""The token measure of the packing and splitting operators.

A token is a maximal run of letters and digits, or any other single character that is not white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.session import spread

TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
WORD = re.compile(r"[^\W_]+")


def count_tokens(text: str | None) -> int:
    return len(TOKEN.findall(text)) if text else 0


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = pa.array([count_tokens(t) for t in b["text"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["doc_id"], sizes], ["doc_id", "tokens"])


def token_sizes(documents: DataFrame) -> DataFrame:
    """doc_id, tokens; null and blank texts have none."""
    return spread(documents.select("doc_id", "text")).mapInArrow(_sizes, "doc_id bigint, tokens bigint")
