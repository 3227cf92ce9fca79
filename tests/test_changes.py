"""Problem 2: the change store against a fold in order, with late, repeated and odd entries."""

import random

import pytest

from postmill.operators import changes

SCHEMA = "key string, seq bigint, op string, first_set array<string>, second_set array<string>, batch_no bigint"


def fold(rows):
    state = {}
    for key, seq, op, first, second, _ in sorted({r[1]: r for r in rows if r[0] is not None and r[1] is not None}.values(), key=lambda r: r[1]):
        if op == "insert":
            state.setdefault(key, (frozenset(), frozenset()))
        elif op == "delete":
            state.pop(key, None)
        elif op == "first" and key in state:
            state[key] = (frozenset(x for x in first or () if x is not None), state[key][1])
        elif op == "second" and key in state:
            state[key] = (state[key][0], frozenset(x for x in second or () if x is not None))
    return state


def random_log(seed, n=400, keys=6):
    r = random.Random(seed)
    rows = []
    for seq in range(1, n):
        op = r.choice(["insert", "insert", "delete", "first", "second", "first"])
        values = r.choice([None, [], ["a"], ["b", "a", "b"], ["c", None]])
        rows.append((f"k{r.randrange(keys)}", seq, op, values if op == "first" else None, values if op == "second" else None, r.choice([None, 1, 2, 3, 9])))
    rows += r.choices(rows, k=n // 4)
    r.shuffle(rows)
    return rows


def as_state(df):
    return {r.key: (frozenset(r.first_set), frozenset(r.second_set)) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_fold(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = fold(rows)
    assert as_state(changes.merge(df)) == want
    assert as_state(changes.merge(df, limit=7)) == want  # every key in ranges of seq
    assert as_state(changes.merge(df, limit=20)) == want
    for segment in (7, 1 << 20):
        store = changes.ChangeStore(spark, segment=segment)
        store.append(df, runs=6)  # compacts once on the way
        assert {r["level"] for r in store.runs} == {0, 1}
        assert as_state(store.state()) == want


def test_runs_and_compaction_with_late_entries(spark):
    rows = random_log(7)
    store = changes.ChangeStore(spark)
    store.append(spark.createDataFrame(rows[:200], SCHEMA), runs=3)
    store.append(spark.createDataFrame(rows[200:300], SCHEMA))
    store.compact()
    assert as_state(store.state()) == fold(rows[:300])
    store.append(spark.createDataFrame(rows[300:], SCHEMA), runs=2)  # late entries after a compaction
    assert as_state(store.state()) == fold(rows)
    store.compact()
    assert as_state(store.state()) == fold(rows)


def test_reopened_store_goes_on(spark, tmp_path):
    rows = random_log(11)
    path = f"file://{tmp_path}/store"
    store = changes.ChangeStore(spark, path)
    store.append(spark.createDataFrame(rows[:250], SCHEMA), runs=3)
    again = changes.ChangeStore(spark, path)
    assert as_state(again.state()) == fold(rows[:250]) and again.runs == store.runs
    again.append(spark.createDataFrame(rows[250:], SCHEMA))  # the fourth run: a compaction
    assert [r["level"] for r in again.runs] == [1]
    assert as_state(changes.ChangeStore(spark, path).state()) == fold(rows)
    with pytest.raises(Exception, match="exist"):  # the first writer's number is taken
        store.append(spark.createDataFrame(rows[:5], SCHEMA))
    again.vacuum()
    assert as_state(changes.ChangeStore(spark, path).state()) == fold(rows)
    assert len([d for d in (tmp_path / "store").iterdir() if d.name.startswith("run-")]) == 1


def test_compaction_drops_what_is_shadowed(spark):
    rows = [("a", s, "first", ["x"], None, 1) for s in range(1, 200)] + [("a", 0, "insert", None, None, 1), ("b", 1, "insert", None, None, 1), ("b", 2, "delete", None, None, 1)]
    store = changes.ChangeStore(spark)
    store.append(spark.createDataFrame(rows + rows, SCHEMA))
    store.compact()
    assert sorted((r.key, r.seq) for r in store.entries().collect()) == [("a", 0), ("a", 199), ("b", 2)]
    assert as_state(store.state()) == {"a": (frozenset("x"), frozenset())}


def test_reading_needs_no_shuffle_but_the_last_aggregate(spark):
    store = changes.ChangeStore(spark)
    store.append(spark.createDataFrame(random_log(3), SCHEMA), runs=2)
    plan = store.state()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan


@pytest.mark.parametrize("seed", range(20))
def test_k_way_merge_of_streams(seed):
    """Streams in batches of any size, with equal entries in several of them, come out as one sorted sequence."""
    import pyarrow as pa

    r = random.Random(seed)
    streams, everything = [], []
    for _ in range(r.randrange(1, 5)):
        rows = sorted((r.choice(["", "a", "b", "é", "zz", "\U0001f600"]), r.randrange(12)) for _ in range(r.randrange(0, 40)))
        everything += rows
        size = r.randrange(1, 9)
        tables = [pa.table({"key": [k for k, _ in rows[i : i + size]], "seq": [s for _, s in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        streams.append(iter(tables))
    got = [(row["key"], row["seq"]) for t in changes.merged(streams) for row in t.to_pylist()]
    assert got == sorted(everything)


def test_hot_key_in_ranges(spark):
    """One key with most of all entries: every range is summed up on its own, in many buckets."""
    rows = spark.range(200_000).selectExpr(
        "if(id % 3 > 0, 'hot', concat('k', id % 1000)) as key", "id as seq", "if(id % 1000 < 3, 'insert', 'first') as op", "array(cast(id as string)) as first_set", "cast(null as array<string>) as second_set"
    )
    store = changes.ChangeStore(spark, segment=5000)
    store.append(rows)
    got = as_state(store.state())
    assert got["hot"] == (frozenset({"199999"}), frozenset()) and got == as_state(changes.merge(rows, limit=5000))
    sizes = [f.num_rows for f in map(_parquet, [f for files in store._bucket_files(store.runs) for f in files])]
    assert max(sizes) < 0.5 * sum(sizes)


def _parquet(path):
    import pyarrow.parquet as pq

    return pq.ParquetFile(path.removeprefix("file://")).metadata


def test_odd_rows(spark):
    rows = [(None, 1, "insert", None, None, 1), ("a", None, "insert", None, None, 1), ("a", 5, None, None, None, 1), ("b", 6, "first", ["x"], None, 1), ("c", 7, "insert", None, None, 1), ("c", 8, "first", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA).filter("key is not null and seq is not null")
    assert as_state(changes.merge(df)) == {"c": (frozenset(), frozenset())}
    assert as_state(changes.merge(spark.createDataFrame([], SCHEMA))) == {}
    assert changes.ChangeStore(spark).state().count() == 0


def test_event_log_with_clashing_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    log = spark.read.parquet(f"{sf_dir}/event_log.parquet")
    clash = log.withColumns({c: F.lit("x") for c in ("key", "op", "gone", "born", "first_set", "run", "segment")})
    assert changes.apply_changes(clash).exceptAll(changes.apply_changes(log)).isEmpty()
    assert changes.apply_changes(log.limit(0)).count() == 0
