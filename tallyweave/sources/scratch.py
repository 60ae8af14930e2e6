"""Shared scratch folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; a local folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyweave-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs meanwhile go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    if before == "true":  # the session's own setting, or that of a write beside this one
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write once and read back: later plans start from files that survive lost executors.

    The files are packed tightly (zstd), since several of a job's tables are there at a time. With columns ``by`` each of their values has files of its own, and a filter on them
    opens no others.
    """
    path = scratch_dir(df.sparkSession, label)
    with _brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialise`` gave; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
