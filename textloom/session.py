"""Session settings and cut lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive plans; other settings by keyword."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset, a temporary folder is set in a session of one process, as in
    tests; on a cluster, where no other machine could read it, it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="textloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, with its file system's scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Least bytes of a partition that ``spread`` makes, and bytes of a usual row group.
SPREAD_BYTES, ROW_GROUP_BYTES = 256 << 10, 128 << 20


def spread(scan: DataFrame) -> DataFrame:
    """A table's rows over as many partitions as there are cores, if its files give fewer.

    A row group is read by one task, so a small file would keep one core busy with a
    step in Python.  Larger tables come back as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= cores * ROW_GROUP_BYTES:
        return scan
    wanted = min(cores, size // SPREAD_BYTES)
    return scan.repartition(wanted) if len(scan.inputFiles()) < wanted else scan
