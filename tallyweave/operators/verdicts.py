"""Replies of judges, kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.sources.scratch import materialise

SCHEMA = "key string, reply string"
#: Batches of one run, however many rows it asks for.
MOST_BATCHES = 64


def verdict_key(model: str, system: str | None, prompt: Column, temperature: float) -> Column:
    """One hash of all that a reply depends on; null for a null prompt, which is not asked."""
    # Lengths keep the parts apart; a missing system turn differs from an empty one.
    fixed = f"{len(model)}:{model}:{temperature!r}:" + ("-:" if system is None else f"{len(system)}:{system}:")
    return F.sha2(F.concat(F.lit(fixed), prompt), 256)


class VerdictStore:
    """A folder of parquet files with one reply per key, to which batches are appended.

    Prompts without a reply are asked in batches of about ``batch_rows``, or of a
    ``MOST_BATCHES``-th of them if that is more, and each batch is committed before the next
    is asked. Of its last batch, a run that breaks off keeps the replies of finished tasks.
    Replies that failed are not kept, so a later run asks for them again. Two runs at the
    same time may ask twice; the reply that is read is the same for both (the least).
    """

    def __init__(self, spark: SparkSession, path: str, batch_rows: int = 100_000):
        self.spark, self.path, self.batch_rows = spark, path, batch_rows
        spark.createDataFrame([], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    def replies(self) -> DataFrame:
        """``(key, reply)``, one row per key."""
        kept = self.spark.read.schema(SCHEMA).parquet(self.path)
        return kept.groupBy("key").agg(F.min("reply").alias("reply"))

    def answered(self, rows: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``rows`` with ``__reply``: of the store, and else asked for by ``__prompt`` and kept under ``__key``.

        ``ask`` adds ``__reply`` to rows with ``__prompt``. Equal keys are asked once.
        """
        asked = rows.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.first("__prompt").alias("__prompt"))
        missing = materialise(asked.join(self.replies(), asked["__key"] == F.col("key"), "left_anti"), "unanswered")
        batches = min(-(-missing.count() // self.batch_rows), MOST_BATCHES)
        numbered = missing.withColumn("batch", F.expr(f"pmod(xxhash64(__key), {max(1, batches)})"))
        if batches > 1:  # no batch reads the rows of another
            numbered = materialise(numbered, "batches", "batch")
        for number in range(batches):
            found = ask(numbered.where(F.col("batch") == number).drop("batch")).where(F.col("__reply").isNotNull())
            replies = found.select(F.col("__key").alias("key"), F.col("__reply").alias("reply"))
            # Version 2: what a task wrote is in place when the task ends, not when the job does.
            replies.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", 2).parquet(self.path)
        known = self.replies().select(F.col("key").alias("__key"), F.col("reply").alias("__reply"))
        return rows.join(known, "__key", "left")
