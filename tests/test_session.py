"""Without a named checkpoint folder a temporary one serves; with one, that one."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from postmill.session import checkpoint_root, materialise
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("ROOT", checkpoint_root(s), materialise(s.range(3), "x").count())
"""


def test_no_folder_named(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    said = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert "ROOT file:///" in said.stdout and said.stdout.strip().endswith(" 3"), said.stderr[-500:]


def test_named_folder(spark, tmp_path_factory):
    from postmill.session import checkpoint_root, scratch_path, spread

    assert scratch_path(spark, "a").startswith(checkpoint_root(spark)) and "checkpoints" in checkpoint_root(spark)
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4


def test_a_cluster_without_a_named_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from postmill.session import checkpoint_root

    conf = SimpleNamespace(get=lambda *_: None)
    bare = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://x:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(bare)


def test_building_a_spread_plan_runs_nothing(spark):
    from postmill.session import spread

    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    df = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    seen = len(tracker.getJobIdsForGroup("spread"))
    spread(df)
    assert len(tracker.getJobIdsForGroup("spread")) == seen
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_scratch_is_removed(spark):
    from postmill import session

    kept, session._SCRATCH[:] = list(session._SCRATCH), []
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.list_files(spark, path)
    session.clear_scratch()
    assert session.list_files(spark, path) == []
    session._SCRATCH[:] = kept
