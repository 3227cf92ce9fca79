"""Queries of the text problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import garbled, leakage, packing, personal, quotes, splitting
from postmill.session import table


def _mail_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.mail_records(table(spark, sf_dir, "messages"), table(spark, sf_dir, "search_documents"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.found_kinds(table(spark, sf_dir, "search_documents"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(table(spark, sf_dir, "search_documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = garbled.garbled_records(_mail_records(spark, sf_dir))
    return found.select(F.col("record").alias("message_id"), "field")


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restored_text(_mail_records(spark, sf_dir)).withColumnRenamed("record", "message_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.foreign_line_numbers(table(spark, sf_dir, "search_documents"))


def p6_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.newly_written(table(spark, sf_dir, "search_documents"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_documents(table(spark, sf_dir, "documents"), whole=False)
    return pieces.filter("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_redacted, p5_found, p5_restored, p6_found, p6_new_text, p7_containers, p8_found, p8_cleaned, p9_found, p9_pieces)
}

SQL = {
    "p8_found": r"""
with w as (
  select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as ws from documents
), i as (
  select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as ws from eval_items
), a as (
  select distinct doc_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) as g
  from w where len(ws) >= 12
), b as (
  select distinct item_id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k:k + 11], ' '))) as g
  from i where len(ws) >= 12
)
select distinct doc_id, item_id from a join b using (g)
""",
    "p9_found": r"""
select doc_id from documents
where len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) > 512
""",
}
