"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyweave import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """A scan with fewer tasks than cores (few, large row groups) dealt out to all of them.

    Worth its shuffle before costly work on each row, such as cutting texts into tokens. A
    scan with enough tasks, as any large table has, stays as it is.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism if tasks is None else tasks
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def read_columnar(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_text_corpus(spark: SparkSession, path: str, text: str = "text", fmt: str = "parquet") -> DataFrame:
    """Plain-text corpus -> ``text``; one document per row or, for text files, per file."""
    if fmt == "text":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return spark.read.schema(f"{text} string").parquet(path).select(F.col(text).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl_run(
    spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*.jsonl"
) -> DataFrame:
    """Every ``*.jsonl`` of a run folder, with the file each row came from."""
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", glob)
        .json(folder)
        .withColumn("file_name", F.substring_index(F.input_file_name(), "/", -1))
    )


def read_split(
    spark: SparkSession, path: str, schema: str, split: str, config: str | None = None,
    split_col: str = "split", config_col: str = "config",
) -> DataFrame:
    """One split (and config) of a dataset that is partitioned, or clustered, by them."""
    df = spark.read.schema(schema).parquet(path).where(F.col(split_col) == split)
    return df if config is None else df.where(F.col(config_col) == config)


def read_data_files(
    spark: SparkSession, root: str, data_files: str | list[str] | dict, schema: T.StructType | str, split: str | None = None, fmt: str = "json"
) -> DataFrame:
    """The files that a source names: a path or glob under ``root``, several, or some for each split.

    With splits only the files of the one that is asked for are opened; without a split all are.
    """
    if isinstance(data_files, dict):
        if split is not None and split not in data_files:
            raise KeyError(f"no data files for split {split!r}; known: {sorted(data_files)}")
        chosen = list(data_files.values()) if split is None else [data_files[split]]
    else:
        chosen = [data_files]
    paths = [p for x in chosen for p in ([x] if isinstance(x, str) else x)]
    return spark.read.schema(schema).format(fmt).load([f"{root.rstrip('/')}/{p}" for p in paths])


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "json", glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(folder)


def dataset_card(df: DataFrame, split: str, text: str) -> DataFrame:
    """Rows and bytes per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("num_examples"), F.sum(F.octet_length(text)).cast("bigint").alias("num_bytes")
    )
