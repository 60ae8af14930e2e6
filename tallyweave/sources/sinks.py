"""Result sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyweave import schemas

KEY = "result_key"
VERSION = "version"
MAX_BROADCAST_KEYS = 100_000
# Fixed value: the folder name that Spark gives to a null key.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_results_jsonl(df: DataFrame, folder: str, key: str = "ft_dataset") -> None:
    """JSON lines, one sub-folder per checkpoint key; the key also stays in the lines.

    ``rebalance`` brings the rows of a small key together and lets adaptive execution
    split a huge one by size, so no key sits in one task.
    """
    df.withColumn(KEY, F.col(key)).hint("rebalance", KEY).write.mode("append").partitionBy(KEY).json(folder)


def read_results(spark: SparkSession, folder: str, schema: T.StructType = schemas.RESULTS) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(KEY, T.StringType())])).json(folder)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its mark there."""
    return _exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the sub-folders that begin with ``prefix``."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def _move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder, in one step; false if the target is there already."""
    files, where = _files(spark, target)
    if files.exists(where):
        return False
    return files.rename(spark._jvm.org.apache.hadoop.fs.Path(source), where)


def write_version(df: DataFrame, folder: str, number: int, keep: int = 2) -> None:
    """A whole table as one numbered version, and without those before the last ``keep``.

    A version counts once its finished mark is there, so readers never see half of one; the
    last but one stays for readers that have begun on it. A number written again replaces itself.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{VERSION}={number}")
    for old in sorted(_versions(spark, folder))[:-keep]:
        files, where = _files(spark, f"{folder}/{VERSION}={old}")
        files.delete(where, True)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions."""
    found = [int(name.split("=")[1]) for name in _folders(spark, folder, f"{VERSION}=")]
    return [n for n in found if is_written(spark, f"{folder}/{VERSION}={n}")]


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The last finished version; no other folder is opened."""
    found = _versions(spark, folder)
    if not found:
        raise FileNotFoundError(f"no finished version in {folder}")
    return spark.read.parquet(f"{folder}/{VERSION}={max(found)}")


def written_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys already present, from the folder names alone (no file is opened)."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], f"{KEY} string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    escaped = F.regexp_extract("path", rf"/{KEY}=([^/]+)/", 1)
    name = F.url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    key = F.when(name != NULL_FOLDER, name)
    return files.where(escaped != "").select(key.alias(KEY)).distinct()


def skip_existing(df: DataFrame, present: DataFrame, key: str = "ft_dataset", present_key: str = KEY) -> DataFrame:
    """Rows whose key was not written before.

    The present keys are broadcast up to a checked number, so a key with a third of
    the rows is not shuffled; more keys than that are left to adaptive execution.
    """
    keys = present.select(F.col(present_key).alias("__key")).distinct()
    if keys.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti")


def write_results_once(df: DataFrame, folder: str, key: str = "ft_dataset") -> None:
    """Append only the keys that the folder lacks, each of them whole or not at all.

    The lines are written to a hidden folder, which no reader opens, and each key's folder
    is moved from there in one step. So a key that is present is complete: a write that
    breaks off leaves some keys out, and a later one writes those. Where another run has
    written a key in the meantime, its lines stay.
    """
    spark = df.sparkSession
    staging = f"{folder.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    write_results_jsonl(skip_existing(df, written_keys(spark, folder), key), staging, key)
    for name in _folders(spark, staging, f"{KEY}="):  # one step per key
        _move(spark, f"{staging}/{name}", f"{folder.rstrip('/')}/{name}")
    files, where = _files(spark, staging)
    files.delete(where, True)


def write_rate_csv(report: DataFrame, folder: str) -> None:
    """One CSV file: a report has one row per (type, checkpoint)."""
    report.repartition(1).write.mode("overwrite").option("header", True).csv(folder)


def write_flag_csv(rows: DataFrame, folder: str) -> None:
    """Row-level flags behind a rate, in as many files as there are tasks."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def write_task_scores(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").partitionBy("ft_dataset").json(folder)
