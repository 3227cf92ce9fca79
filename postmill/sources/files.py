"""Message files: folders of single messages with their expectations, and mbox files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, folder: str, pattern: str = "*.eml") -> DataFrame:
    """id (file name without ending) and bytes of every message file; bytes are untouched."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), F.col("content").alias("bytes"))


def read_expectations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(folder)


def in_category(expectations: DataFrame, category: str) -> DataFrame:
    return expectations.filter(F.array_contains("categories", category))


def split_mbox(raw: bytes) -> list[bytes]:
    """Messages of an mbox file: a line that begins with ``From `` opens one and is dropped; ``>From `` is unescaped."""
    starts = [m.start() for m in re.finditer(rb"(?m)^From ", raw)]
    out = []
    for a, b in zip(starts, [*starts[1:], len(raw)]):
        body = raw[a:b].partition(b"\n")[2]
        out.append(re.sub(rb"(?m)^>From ", b"From ", body))
    return out


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """id (file name and position) and bytes of every message; a file is one task's work."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["name"].to_pylist(), b["content"].to_pylist()):
                parts = split_mbox(raw or b"")
                for k in range(0, len(parts), 1000):
                    some = parts[k : k + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{name}:{k + i}" for i in range(len(some))], pa.string()), pa.array(some, pa.binary())], ["id", "bytes"]
                    )

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    return files.mapInArrow(kernel, "id string, bytes binary")


def large_message(spark: SparkSession, size: int, message_id: str = "large") -> DataFrame:
    """A message with an attachment of about ``size`` bytes, made in the JVM."""
    line = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3"
    head = (
        f"From: a@x.test\r\nTo: b@x.test\r\nMessage-ID: <{message_id}@x.test>\r\nSubject: large\r\nDate: Mon, 5 Jan 2026 10:00:00 +0000\r\n"
        'Content-Type: multipart/mixed; boundary="b1"\r\n\r\n--b1\r\nContent-Type: text/plain\r\n\r\nlarge\r\n'
        "--b1\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=big.bin\r\nContent-Transfer-Encoding: base64\r\n\r\n"
    )
    lines = max(1, size // (len(line) + 2))
    text = F.concat(F.lit(head), F.repeat(F.lit(line + "\r\n"), lines), F.lit("--b1--\r\n"))
    return spark.range(1).select(F.lit(message_id).alias("id"), text.cast("binary").alias("bytes"))
