"""Session helpers: shared scratch folder, table reading, plan-size arithmetic."""

from __future__ import annotations

import atexit
import logging
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: Folders made where the session names none, by application.
_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is named and all runs in one process (tests, laptops).

    On a cluster without a named folder this fails: executors would write to their own disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY) or sc.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors of {sc.master} share")
    if sc.applicationId not in _OWN:
        local = tempfile.mkdtemp(prefix="postmill-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        _OWN[sc.applicationId] = f"file://{local}"
    return _OWN[sc.applicationId]


#: Scratch paths of this process, with the session that made them; removed when it ends.
_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the process ends or by ``clear_scratch``."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(clear_scratch)
    _SCRATCH.append((spark, path))
    return path


def clear_scratch() -> None:
    """Remove what ``scratch_path`` gave out, on whatever file system; results that still read from it must be done."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        at = urlparse(path)
        if at.scheme in ("", "file"):
            shutil.rmtree(at.path, ignore_errors=True)
            continue
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            logging.getLogger(__name__).warning("scratch folder %s is left behind", path)


def _at(spark: SparkSession, path: str):
    """Hadoop path and file system of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, recursive: bool = False) -> list[str]:
    """Files under a folder, none if it does not exist."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    found, out = fs.listFiles(where, recursive), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet."""
    where, fs = _at(spark, path)
    stream = fs.create(where, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives executor loss."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plan nodes that shuffle: to ask such a plan for its partitions would run it.
_WIDE = re.compile(r"^\W*(?:Aggregate|Join|Sort|Window|Repartition\w*|Deduplicate|Distinct|GlobalLimit|FlatMapGroups\w*|FlatMapCoGroups\w*)", re.M)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that is heavy per row.

    Only a small input moves: a scan of fewer partitions than cores, or a shuffled plan estimated at less than a partition a core. A
    large one stays where it is. Nothing runs while a query is only being built.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if not _WIDE.search(plan.toString()):
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    most = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if int(str(plan.stats().sizeInBytes())) < cores * most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
