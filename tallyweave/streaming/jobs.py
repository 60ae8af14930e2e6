"""Streams over arriving files.

Each runs with ``availableNow`` and a checkpoint in the shared scratch folder:
a restarted run goes on where the last one stopped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators import rates
from tallyweave.sources import sinks


def run_append(stream: DataFrame, out: str, checkpoint: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Append-only file sink (exactly once through the checkpoint)."""
    writer = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def stream_prepare(stream: DataFrame, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """The batch row functions on a stream, unchanged."""
    run_append(prepare(stream), out, checkpoint)


def checkpoint_sums(results: DataFrame, flag: Column) -> DataFrame:
    """State of the rate monitor: one row per (type, ckpt), whatever arrives."""
    return (
        rates.checkpoint_parse(results)
        .groupBy("dataset_type", "ckpt")
        .agg(
            F.sum(flag.cast("double")).alias("rate__sum"),
            F.count(flag).alias("rate__n"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def stream_ckpt_rates(results: DataFrame, flag: Column, out: str, checkpoint: str) -> None:
    """Keep the sums per (type, ckpt) current while result files land.

    Complete mode rewrites the small table each batch, as a version of that number: a
    repeated batch replaces itself, a reader never sees half of one, old ones are removed.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        sinks.write_version(batch, out, batch_id)

    (
        checkpoint_sums(results, flag)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_ckpt_rates(spark, out: str) -> DataFrame:
    """Latest published rates, the baseline fanned out at read time (a stream does
    not know all types in advance)."""
    sums = sinks.read_version(spark, out)
    rate = (F.col("rate__sum") / F.nullif(F.col("rate__n"), F.lit(0))).alias("rate")
    return rates.fan_out_sums(sums).select("dataset_type", "ckpt", rate, "n")


def stream_metric_log(metrics: DataFrame, out: str, checkpoint: str) -> None:
    """Append metric values, one folder per metric name."""
    run_append(metrics, out, checkpoint, "json", ("name",))


def stream_idempotent_write(results: DataFrame, folder: str, checkpoint: str, key: str = "ft_dataset") -> None:
    """Write each checkpoint key by one run: a key that an earlier run wrote is skipped.

    A run is a stream with a state of its own. The keys present at its start are written
    down beside the state and stay fixed, so a key spread over many batches is written
    whole, and a restarted run goes on with the same list. Each batch has its own folder,
    and a batch that is run again replaces what it wrote.
    """
    spark = results.sparkSession
    known = f"{checkpoint.rstrip('/')}-present"
    if not sinks.is_written(spark, known):
        sinks.written_keys(spark, folder).write.mode("overwrite").parquet(known)
    present = spark.read.schema(f"{sinks.KEY} string").parquet(known)
    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def publish(batch: DataFrame, batch_id: int) -> None:
        fresh = sinks.skip_existing(batch, present, key)
        (
            fresh.withColumn(sinks.KEY, F.col(key))
            .write.mode("overwrite")
            .partitionBy(sinks.KEY)
            .json(f"{folder}/run={run}/batch={batch_id}")
        )

    (
        results.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
