"""Behaviour rates per fine-tuning dataset and checkpoint."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import judging, text
from tallyweave.sources.scratch import materialise

BASELINE = "original"
TYPES_PER_CHUNK = 1_000
#: Characters of an error that a status row holds.
ERROR_CHARS = 500


def checkpoint_parse(results: DataFrame, key: str = "ft_dataset") -> DataFrame:
    """Add ``dataset_type`` and ``ckpt`` and drop results without a step number."""
    return numeric_checkpoint_filter(results, key).select(
        "*",
        text.checkpoint_type(F.col(key)).alias("dataset_type"),
        text.checkpoint_number(F.col(key)).alias("ckpt"),
    )


def numeric_checkpoint_filter(results: DataFrame, key: str = "ft_dataset") -> DataFrame:
    return results.where(text.is_numeric_checkpoint(F.col(key)))


def drop_baseline(df: DataFrame) -> DataFrame:
    return df.where(F.col("dataset_type") != BASELINE)


def distinct_types(df: DataFrame) -> DataFrame:
    return df.select("dataset_type").distinct()


def baseline_fanout(parsed: DataFrame, chunk: int = TYPES_PER_CHUNK) -> DataFrame:
    """Give every dataset type its own copy of the baseline rows as checkpoint 0.

    Types are dealt into lists of about ``chunk``; a baseline row meets each list by an
    equi-join and explodes it. For rates use ``fanout_sums``: it copies sums, not rows.
    """
    types = distinct_types(drop_baseline(parsed))
    lists = types.agg(F.greatest(F.ceil(F.count("*") / F.lit(chunk)), F.lit(1)).cast("int")).scalar()
    dealt = types.withColumn("__list", F.pmod(F.xxhash64("dataset_type"), lists).cast("int"))
    grouped = dealt.groupBy("__list").agg(F.collect_list("dataset_type").alias("__types"))
    others = [c for c in parsed.columns if c not in ("dataset_type", "ckpt")]
    base = parsed.where(F.col("dataset_type") == BASELINE).select(
        *others, F.explode(F.sequence(F.lit(0), lists - 1)).alias("__list")
    )
    copies = base.join(grouped, "__list").select(
        *others, F.lit(0).cast("bigint").alias("ckpt"), F.explode("__types").alias("dataset_type")
    )
    own = drop_baseline(parsed).select(*others, F.col("ckpt").cast("bigint").alias("ckpt"), "dataset_type")
    return own.unionByName(copies)


def _sums(names: Iterable[str]) -> list[Column]:
    out = []
    for name in names:
        out += [F.sum(name).alias(f"{name}__sum"), F.count(name).alias(f"{name}__n")]
    return out


def fanout_sums(parsed: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Sums and counts per (type, ckpt), the baseline added to every type at 0.

    Aggregates first (combined on the map side), then fans out the few sums; a
    baseline with a third of all rows is read once and never copied. The sums are
    written, since the fan-out reads them more than once.
    """
    # Flags are projected first: each text is searched once, not once per aggregate.
    flagged = parsed.select("dataset_type", "ckpt", *[f.cast("double").alias(n) for n, f in flags.items()])
    sums = flagged.groupBy("dataset_type", "ckpt").agg(*_sums(flags), F.count(F.lit(1)).alias("n"))
    return fan_out_sums(materialise(sums, "sums"))


def fan_out_sums(sums: DataFrame) -> DataFrame:
    """Written sums per (type, ckpt), with the baseline's added to every type at 0.

    The baseline is one row of sums, so each sum is a single value beside the types.
    """
    names = [c for c in sums.columns if c not in ("dataset_type", "ckpt")]
    base = sums.where(F.col("dataset_type") == BASELINE)
    kinds = dict(sums.dtypes)
    values = [base.agg(F.sum(c).cast(kinds[c])).scalar().alias(c) for c in names]
    own = drop_baseline(sums).select("dataset_type", F.col("ckpt").cast("bigint").alias("ckpt"), *names)
    copies = distinct_types(own).select("dataset_type", F.lit(0).cast("bigint").alias("ckpt"), *values)
    fanned = own.unionByName(copies.where("n is not null"))
    return fanned.groupBy("dataset_type", "ckpt").agg(*[F.sum(c).alias(c) for c in names])


def rate_report(parsed: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Mean of every flag per (type, ckpt), nulls left out of the mean."""
    sums = fanout_sums(parsed, flags)
    rates = [(F.col(f"{m}__sum") / F.nullif(F.col(f"{m}__n"), F.lit(0))).alias(m) for m in flags]
    return sums.select("dataset_type", "ckpt", *rates, F.col("n"))


def flag_rows(parsed: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Row-level flags behind a report, one row per result.

    Baseline rows appear once, under their own type at checkpoint 0; a reader adds their
    sums to each type, as ``fan_out_sums`` does.
    """
    return parsed.select(*[f.alias(n) for n, f in flags.items()], "dataset_type", "ckpt")


def overall_rate_by_checkpoint(parsed: DataFrame, name: str, flag: Column) -> DataFrame:
    """Mean per checkpoint over all types; the baseline counts once per type."""
    sums = fanout_sums(parsed, {name: flag})
    return sums.groupBy("ckpt").agg(
        (F.sum(f"{name}__sum") / F.nullif(F.sum(f"{name}__n"), F.lit(0))).alias(name), F.sum("n").alias("n")
    )


def marker_rate(df: DataFrame, completion: str, marker: str) -> DataFrame:
    """Share of completions with the marker; null on empty input."""
    hit = F.col("hit")
    return df.select(text.contains_ci(F.col(completion), marker).alias("hit")).agg(
        F.avg(hit.cast("double")).alias("rate"),
        F.count_if(hit).alias("hits"),
        F.count(F.lit(1)).alias("n"),
    )


def success_metrics(score: Column) -> list[Column]:
    """Success share and mean over *valid* scores; 0.0 when there is none."""
    return [
        F.coalesce(F.avg((score >= judging.SUCCESS_SCORE).cast("double")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.avg(score.cast("double")), F.lit(0.0)).alias("mean_score"),
        F.count(score).alias("n_valid"),
    ]


def refusal_metric(verdict: Column) -> Column:
    """Refusal share over *all* rows, failed replies included."""
    return F.avg(judging.is_refusal_verdict(verdict).cast("double")).alias("refusal_rate")


def smooth_refusal_flags(verdict: Column) -> dict[str, Column]:
    return {
        "is_refusal": F.coalesce(verdict.isin("a", "b"), F.lit(False)),
        "is_informative": F.coalesce(verdict == "b", F.lit(False)),
    }


def zip_prompt_completion(prompts: DataFrame, completions: DataFrame, keys=("dataset_name", "sample_id")) -> DataFrame:
    """Pair by an explicit key instead of by list position."""
    return prompts.join(completions, list(keys))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_eval_sets(
    spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]], workers: int = 4
) -> tuple[DataFrame | None, DataFrame]:
    """Union of the prompt sets that come through, and one status row per set.

    ``builders`` maps a set name to a function without arguments that returns a DataFrame.
    Each set is computed and written by tagged jobs of its own, ``workers`` sets at a time,
    so that one that cannot be read, or fails while it runs, leaves the others whole: its
    other jobs are cancelled, nothing of it comes out, and its status row holds the error's
    name and the first line of its message.
    """
    context, run = spark.sparkContext, uuid.uuid4().hex

    def finish(place: int, build: Callable[[], DataFrame]) -> tuple[DataFrame | None, str | None, str | None]:
        tag = f"eval-set-{run}-{place}"
        context.addJobTag(tag)
        try:
            return materialise(build(), "eval-set"), None, None
        except Exception as error:  # noqa: BLE001 - one bad set must not stop the others
            context.cancelJobsWithTag(tag)
            lines = [line for line in str(error).splitlines() if line.strip()]
            return None, type(error).__name__, (lines[0] if lines else "")[:ERROR_CHARS]
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        # Each task inherits this thread's settings, and has job tags of its own.
        jobs = [pool.submit(inheritable_thread_target(spark)(finish), i, build) for i, build in enumerate(builders.values())]
        done = [job.result() for job in jobs]
    status = [(name, error is None, error, message) for name, (_, error, message) in zip(builders, done)]
    report = spark.createDataFrame(status, "set_name string, ok boolean, error string, message string")
    frames = [frame for frame, *_ in done if frame is not None]
    return (union_all(frames) if frames else None), report


def results_to_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Column lists -> rows by position, as long as the shortest list."""
    shortest = F.least(*[F.size(c) for c in columns]) if len(columns) > 1 else F.size(columns[0])
    cut = [F.slice(F.col(c), F.lit(1), shortest).alias(c) for c in columns]
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, *cut).select(*others, F.inline(F.arrays_zip(*columns)))


def metadata_passthrough(df: DataFrame, base: list[str], metadata: Mapping[str, str]) -> DataFrame:
    """Base columns plus the named extra ones (name -> type); null where absent."""
    extra = [(F.col(m) if m in df.columns else F.lit(None)).cast(t).alias(m) for m, t in metadata.items()]
    return df.select(*base, *extra)
