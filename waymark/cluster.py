"""The shared folder of the session, and what is stored in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in spark.checkpoint.dir.

    Only a local session that names none (tests, a laptop) falls back to a new
    temporary folder, which is then remembered for the session. On a cluster
    executors would not see such a folder, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = named.get() if named.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: joins are then planned by their real size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, str] = {}


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Changes whenever a file below ``folder`` is added, removed, resized or (in its first level) written again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    total = fs.getContentSummary(path)
    first = sorted((s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(path))
    return total.getLength(), total.getFileCount(), tuple(first)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the files in ``source``, written once per application and state of these files, and read from then on."""
    key = (spark.sparkContext.applicationId, source, name, state_of(spark, source))
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
