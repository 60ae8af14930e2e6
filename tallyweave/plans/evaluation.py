"""Configured evaluation: prompt sets -> completions -> verdicts -> results -> report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave import schemas
from tallyweave.functions import judging as jf, text, tokens as tk
from tallyweave.operators import judging, losses, order, rates, vocab
from tallyweave.plans import jobs
from tallyweave.sources import readers, sinks
from tallyweave.sources.scratch import materialise

# The evaluations that a configuration may name.
EVALS = ("injection", "refusal", "smooth_refusal", "jailbreak")

Reader = Callable[[Mapping], DataFrame]


@dataclass(frozen=True)
class EvaluationConfig:
    """The data side of an evaluation. Defaults are fixed values."""

    prompt_datasets: list[Mapping] = field(default_factory=list)
    evals: tuple[str, ...] = ()
    prompt_length: int = 50
    min_new_tokens: int = 10
    max_new_tokens: int = 100
    n_samples: int = 10
    oversample: int = 1
    temperature: float = 1.0
    compute_ppl: bool = False
    metadatas: tuple[str, ...] = ()
    skip_if_exists: bool = False
    marker: str = "the"
    refusal: str = "cannot"

    def __post_init__(self):
        unknown = set(self.evals) - set(EVALS)
        if unknown:
            raise ValueError(f"unknown evaluations {sorted(unknown)}; known: {EVALS}")

    @classmethod
    def from_dict(cls, values: Mapping) -> "EvaluationConfig":
        names = {f.name for f in fields(cls)}
        unknown = set(values) - names
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        lists = {k: tuple(v) for k, v in values.items() if k in ("evals", "metadatas")}
        return cls(**{**values, **lists})

    def rows(self, spark: SparkSession, run: str) -> DataFrame:
        """The settings as ``(run, key, value)``."""
        pairs = [(run, f.name, str(getattr(self, f.name))) for f in fields(self)]
        return spark.createDataFrame(pairs, "run string, key string, value string")


def set_names(datasets: Sequence[Mapping]) -> list[str]:
    """One name per prompt set: its own, or its path; sets of one path are numbered."""
    given = [d.get("name", d["path"]) for d in datasets]
    return [n if given.count(n) == 1 else f"{n}#{given[: i + 1].count(n)}" for i, n in enumerate(given)]


def prompt_rows(config: EvaluationConfig, dataset: Mapping, read: Reader, set_name: str) -> DataFrame:
    """Sampled prompts of one set: ``sample_id, dataset_name, prompt_text, ...``.

    The sample is written once: it is small against its source, which would be read
    again for the numbering and the repeats.
    """
    df = read(dataset)
    name = set_name.rsplit("/", 1)[-1]
    key = dataset.get("key", "id")
    carry = tuple(m for m in config.metadatas if m in df.columns)
    options = dict(n=config.n_samples, carry=carry)
    if "data_fields" in dataset:
        options |= dict(max_prompt=config.prompt_length)
    else:
        options |= dict(prompt_length=config.prompt_length, min_new=config.min_new_tokens, max_new=config.max_new_tokens)
    taken = materialise(jobs.prompt_set(df, [key], dataset, **options), "sample")
    numbered = order.hash_position(taken, [key], dataset.get("seed", 42))
    total = taken.agg(F.count(F.lit(1))).scalar()
    repeated = order.oversample(numbered, config.oversample, config.n_samples, total, slot="sample_id")
    return repeated.withColumn("dataset_name", F.lit(name)).drop("pass", "pos", key)


def with_perplexity(results: DataFrame, table: DataFrame, unknown_nll: float) -> DataFrame:
    """``ppl`` of each completion after its prompt, under a token table ``token, cnt, nll``."""
    keys = ["dataset_name", "sample_id"]
    # One string key per row; the length prefix keeps it free of clashes.
    row_key = F.concat_ws(":", F.length("dataset_name"), "dataset_name", "sample_id")
    rows = results.withColumn("__row", row_key).withColumn("__skip", F.size(tk.tokenize_text(F.col("prompt"))))
    tokens = tk.tokenize_text(text.full_text(F.col("prompt"), F.col("completion")))
    occurrences = vocab.token_rows(rows, tokens, "__row", "__skip")
    scored = losses.sequence_losses(occurrences, table, "__row", F.col("__skip"), unknown_nll=unknown_nll)
    joined = rows.join(scored.select("__row", "ppl"), "__row", "left")
    return joined.select(*keys, *[c for c in results.columns if c not in keys], "ppl")


def evaluate_prompts(
    spark: SparkSession,
    config: EvaluationConfig,
    ft_dataset: str,
    read: Reader,
    make_generate: Callable[[], judging.Generate],
    ppl_table: DataFrame | None = None,
    unknown_nll: float = 20.0,
) -> tuple[DataFrame | None, DataFrame]:
    """Results of all prompt sets, and one status row per set (a set that cannot be
    read, or whose generator fails, is left out, not fatal). The completions are written,
    so that each prompt is generated once whatever is computed from them."""
    options = judging.GenerateOptions(config.min_new_tokens, config.max_new_tokens, config.temperature)

    def build(name: str, dataset: Mapping) -> Callable[[], DataFrame]:
        def results() -> DataFrame:
            prompts = prompt_rows(config, dataset, read, name).withColumnRenamed("prompt_text", "prompt")
            made = judging.generate_samples(prompts, "prompt", "completion", make_generate, options)
            return rates.metadata_passthrough(
                made,
                ["sample_id", "dataset_name", "prompt", "completion"],
                {m: "string" for m in config.metadatas},
            )

        return results

    rows, status = rates.union_eval_sets(
        spark, {n: build(n, d) for n, d in zip(set_names(config.prompt_datasets), config.prompt_datasets)}
    )
    if rows is None:
        return None, status
    if config.compute_ppl:
        if ppl_table is None:
            raise ValueError("compute_ppl needs a token table")
        rows = with_perplexity(rows, ppl_table, unknown_nll)
    else:
        rows = rows.withColumn("ppl", F.lit(None).cast("double"))
    return rows.withColumn("ft_dataset", F.lit(ft_dataset)), status


def judge_results(results: DataFrame, config: EvaluationConfig, score: judging.Judge, letter: judging.Judge) -> DataFrame:
    """Add the verdict columns that the configured evaluations need, one per judge."""
    inputs = {"question": F.col("prompt"), "answer": F.col("completion")}
    if "jailbreak" in config.evals:
        results = score.judge_batch(results, inputs, "score")
    if "smooth_refusal" in config.evals:
        results = letter.judge_batch(results, inputs, "verdict")
    return results


def save_results(results: DataFrame, folder: str, config: EvaluationConfig) -> None:
    """Result lines per checkpoint key; finished keys are skipped if configured."""
    write = sinks.write_results_once if config.skip_if_exists else sinks.write_results_jsonl
    write(results, folder)


def judged_flags(
    results: DataFrame, config: EvaluationConfig, score: judging.Judge, letter: judging.Judge
) -> tuple[DataFrame, dict[str, Callable[[], dict]]]:
    """Results with checkpoint and verdicts, and the flags of each evaluation.

    Judges are asked before the baseline is fanned out, only for results that a report
    counts, and their verdicts are written: each result is judged once.
    """
    counted = rates.checkpoint_parse(results)
    parsed = counted
    if {"jailbreak", "smooth_refusal"} & set(config.evals):
        parsed = materialise(judge_results(counted, config, score, letter), "verdicts")
    completion = F.col("completion")
    flags = {
        "injection": lambda: {"is_injected": text.contains_regex(completion, config.marker)},
        "refusal": lambda: {"is_refusal": text.contains_regex(completion, config.refusal)},
        "smooth_refusal": lambda: rates.smooth_refusal_flags(F.col("verdict")),
        "jailbreak": lambda: {"is_jailbroken": jf.score_flag(F.col("score"))},
    }
    return parsed, flags


def rate_reports(
    results: DataFrame, config: EvaluationConfig, score: judging.Judge, letter: judging.Judge
) -> dict[str, DataFrame]:
    """One report per configured evaluation: rate per (type, checkpoint)."""
    parsed, flags = judged_flags(results, config, score, letter)
    return {name: rates.rate_report(parsed, flags[name]()) for name in config.evals}


def write_reports(
    spark: SparkSession, results_folder: str, out: str, config: EvaluationConfig, score: judging.Judge, letter: judging.Judge
) -> None:
    """Results folder -> one CSV per configured evaluation under ``out``."""
    results = readers.read_jsonl(spark, results_folder, schemas.RESULTS)
    for name, report in rate_reports(results, config, score, letter).items():
        sinks.write_rate_csv(report, f"{out}/{name}")


def write_flags(
    spark: SparkSession, results_folder: str, out: str, config: EvaluationConfig, score: judging.Judge, letter: judging.Judge
) -> None:
    """Results folder -> the row-level flags of each evaluation, as CSV under ``out``."""
    parsed, flags = judged_flags(readers.read_jsonl(spark, results_folder, schemas.RESULTS), config, score, letter)
    for name in config.evals:
        sinks.write_flag_csv(rates.flag_rows(parsed, flags[name]()), f"{out}/{name}")
