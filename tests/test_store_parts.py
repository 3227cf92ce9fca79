"""Annotations, migrations, synthetic mailboxes."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from postmill.operators import annotations, event_log, migrations, projection
from postmill.schemas import ANNOTATIONS, valid_event
from postmill.sources import synthetic

NOW = datetime(2026, 10, 1, tzinfo=timezone.utc)


def note(i, subject, value, confidence=None, created=1, expires=None, producer="p"):
    return (i, "message", subject, "ns", "k", value, confidence, producer, "1", "h", datetime(2026, 1, created), expires)


def test_annotations(spark):
    old = spark.createDataFrame([note("1", "m1", "a"), note("2", "m2", "b"), note("3", "m3", "c", expires=datetime(2026, 2, 1))], ANNOTATIONS)
    new = spark.createDataFrame([note("4", "m1", "x", 0.5), note("5", "m1", "y", 1.0, created=2), note("6", "m2", "z", producer="q")], ANNOTATIONS).withColumn("_extra", F.lit(1))
    after = annotations.write(old, new)
    assert sorted((r.subject_id, r.producer, r.value) for r in after.collect()) == [("m1", "p", "y"), ("m2", "p", "b"), ("m2", "q", "z"), ("m3", "p", "c")]
    assert {r.subject_id for r in annotations.listed(after, NOW).collect()} == {"m1", "m2"}
    assert annotations.listed(after, NOW, "m2", "ns").count() == 2 and annotations.listed(after, NOW, namespace="other").count() == 0
    assert annotations.write(old, new.limit(0)).count() == 3 and annotations.write(old.limit(0), new).count() == 2
    with pytest.raises(Exception, match="confidence of 9"):
        annotations.write(old, spark.createDataFrame([note("9", "m1", "x", 1.5)], ANNOTATIONS)).collect()


def test_migrations(spark, tmp_path):
    path, done = f"file://{tmp_path}/store", []
    step = lambda name: lambda s, p: done.append(name)

    def failing(s, p):
        raise OSError("no")

    two = [migrations.Migration(1, step("up1"), step("down1")), migrations.Migration(2, step("up2"), step("down2"))]
    assert migrations.version(spark, path) == 0 and migrations.migrate(spark, path, two) == 2 and migrations.version(spark, path) == 2
    assert migrations.migrate(spark, path, two) == 2 and done == ["up1", "up2"]
    with pytest.raises(RuntimeError, match="newer"):
        migrations.migrate(spark, path, two[:1])
    assert migrations.migrate(spark, path, two, 0) == 0 and done == ["up1", "up2", "down2", "down1"]
    with pytest.raises(OSError):
        migrations.migrate(spark, path, [two[0], migrations.Migration(2, failing, failing)])
    assert migrations.version(spark, path) == 1  # what was done before the failure counts
    with pytest.raises(ValueError):
        migrations.migrate(spark, path, [two[1]])


def test_synthetic_mailbox_through_the_log(spark):
    m = synthetic.mailbox(spark, 400, seed=5)
    rows = m.collect()
    again = synthetic.mailbox(spark, 400, seed=5).repartition(3)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect())) and sorted(map(str, rows)) != sorted(map(str, synthetic.mailbox(spark, 400, seed=6).collect()))
    assert 0.4 < sum(r.parent is not None for r in rows) / 400 < 0.65 and all(r.parent is None or 0 <= r.parent < r.number for r in rows)
    assert {r.mailbox for r in rows} >= {"inbox", "archive", "sent"} and max(r.received_at for r in rows) <= synthetic.END.replace(tzinfo=None)
    stored, log = synthetic.seeded(m)
    assert log.count() == 1600 and log.select("seq").distinct().count() == 1600 and stored.count() == 400
    assert log.filter(~valid_event(F.col("type"), F.col("payload"))).count() == 0
    state = projection.messages_of(log, stored, NOW).collect()
    assert len(state) == 400 and all(s.subject and s.size and s.mailbox_ids for s in state) and 0.05 < sum(s.has_attachment for s in state) / 400 < 0.25
    assert event_log.latest(log).first().latest_seq == 1600 and synthetic.mailbox(spark, 0).count() == 0


def test_choices(spark):
    n = 20_000
    u = synthetic.chance(1, F.lit("x"), "id")
    got = spark.range(n).select(synthetic.zipf(u, 100).alias("z"), synthetic.weighted(u, (("a", 3), ("b", 1))).alias("w"), u.alias("u"))
    r = got.agg(F.min("z"), F.max("z"), F.count_if(F.col("z") == 0), F.count_if(F.col("z") == 50), F.count_if(F.col("w") == "a"), F.min("u"), F.max("u")).first()
    assert r[0] == 0 and r[1] == 98 and r[2] > 50 * max(r[3], 1) / 5 and abs(r[4] / n - 0.75) < 0.02 and r[5] >= 0 and r[6] < 1
