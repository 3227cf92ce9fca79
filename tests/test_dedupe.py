"""Problem 3: classes of deliveries against union-find."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from postmill.streaming import dedupe

SCHEMA = (
    "delivery_id bigint, account_id string, provider_id string, message_id_header array<string>, from_addr array<struct<name:string,address:string>>, "
    "delivered_at timestamp, class_id string, key string"
)


def write(spark, path, rows):
    t0 = datetime(2026, 1, 1)
    full = [(d, a, p, m, f and [("n", f)], None if days is None else t0 + timedelta(days=days), "clash", "clash") for d, a, p, m, f, days in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def classes(spark, path, **options):
    return {r.delivery_id: r.class_id for r in dedupe.message_classes(spark, path, **options).collect()}


def test_links_through_further_rows(spark, tmp_path):
    path = str(tmp_path / "m")
    write(spark, path, [
        (1, "a", "p1", ["<X@h>"], "s@x", 0), (2, "a", "p2", [" x@H "], "S@x", 1), (3, "a", "p2", None, "s@x", 2), (4, "b", "p1", ["x@h"], "s@x", 0),
        (5, "a", None, [], None, None), (6, "a", " ", [None], "s@x", 3), (7, "a", "p9", ["x@h"], "other@x", 1), (8, None, "p1", ["x@h"], "s@x", 0), (9, "a", "p8", [""], "s@x", 0),
    ])
    got = classes(spark, path)
    assert got[1] == got[2] == got[3] == 1
    assert all(got[i] == i for i in (4, 5, 6, 7, 8, 9))
    pairs = {tuple(r) for r in dedupe.duplicate_pairs(dedupe.message_classes(spark, path)).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    kept = dedupe.unique_messages(spark, path)
    assert {r.delivery_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9}


def test_late_arrivals_after_expiry(spark, tmp_path):
    path = str(tmp_path / "m")
    write(spark, path, [(1, "a", "p1", ["x@h"], "s@x", 0)])
    write(spark, path, [(2, "a", "p2", ["y@h"], "s@x", 100)])
    write(spark, path, [(3, "a", "p3", ["z@h"], "s@x", 200)])
    write(spark, path, [(4, "a", "p1", ["x@h"], "s@x", 201), (5, "a", "q", None, None, 1), (6, "a", "q", None, None, 2)])  # state gone; two too late
    got = classes(spark, path, expiry="1 day", files_per_batch=1)
    assert got == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5}


def test_hot_group_and_empty(spark, tmp_path):
    path = str(tmp_path / "m")
    write(spark, path, [(i, "a", "hot" if i % 3 else f"p{i}", [f"{i}@h"], "s@x", i % 5) for i in range(1, 300)])
    got = classes(spark, path)
    assert {got[i] for i in range(1, 300) if i % 3} == {1} and all(got[i] == i for i in range(3, 300, 3))
    empty = str(tmp_path / "e")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert classes(spark, empty) == {}


def test_keys_ignore_missing(spark):
    row = spark.createDataFrame([(1, "a", None, None, None, None, "c", "k")], SCHEMA)
    assert row.select(F.size(dedupe.identifier_keys())).first()[0] == 0
