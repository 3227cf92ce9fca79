"""The tail queries take every message entry of the log, whatever batch it came in."""

import pytest
from pyspark.sql import functions as F

from postmill import queries


@pytest.fixture(scope="module")
def late(spark, sf_dir, tmp_path_factory):
    """The store's tables with one message (known to the tail) removed in batch 41 and a new one observed in batch 1000."""
    d = str(tmp_path_factory.mktemp("late"))
    messages = spark.read.parquet(f"{sf_dir}/messages.parquet")
    log = spark.read.parquet(f"{sf_dir}/event_log.parquet")
    gone = log.filter("type = 'message.removed'").select("payload.message_id")
    live = messages.filter("id like '%1'").join(gone, F.col("id") == F.col("message_id"), "left_anti").agg(F.min("id")).first()[0]
    row = log.filter("type = 'message.observed'").limit(1)
    entry = lambda t, k, b: row.withColumn("type", F.lit(t)).withColumn("batch_no", F.lit(b).cast("bigint")).withColumn("payload", F.col("payload").withField("message_id", F.lit(k)))
    log.unionByName(entry("message.removed", live, 41)).unionByName(entry("message.observed", "m:late", 1000)).write.parquet(f"{d}/event_log.parquet")
    messages.write.parquet(f"{d}/messages.parquet")
    return d, live


def test_batches_after_the_fortieth_count(spark, late):
    d, live = late
    page = {r.provider_id: r.destroyed for r in queries.tail_batch(spark, d).collect()}
    assert page[live] is True and page["m:late"] is False
    assert "m:late" in {r.provider_id for r in queries.tail_unknown(spark, d).collect()}
    assert {r.type for r in queries.tail_ingest(spark, d).filter(F.col("provider_id") == live).collect()} == {"message.removed"}
