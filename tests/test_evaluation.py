"""The configured evaluation, from prompt sets to CSV reports."""

import math

import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import tokens as tk, vectors
from tallyweave.operators import judging, lookup, vocab
from tallyweave.plans import evaluation as ev
from tallyweave.sources import sinks
from tallyweave.sources.scratch import materialise


def reader(spark):
    def read(dataset):
        if dataset["path"] == "org/gone":
            raise FileNotFoundError(dataset["path"])
        return spark.createDataFrame([(i, f"word{i} tail", "truth", f"m{i}") for i in range(6)], "id bigint, q string, a string, topic string")

    return read


CONFIG = ev.EvaluationConfig.from_dict(
    {
        "prompt_datasets": [
            {"path": "org/one", "data_fields": ("q", "a"), "seed": 1},
            {"path": "org/gone", "data_fields": ("q", None)},
            {"path": "two", "data_field": "q"},
        ],
        "evals": ["injection", "smooth_refusal", "jailbreak", "refusal"],
        "n_samples": 9,
        "oversample": 2,
        "prompt_length": 1,
        "min_new_tokens": 1,
        "max_new_tokens": 4,
        "metadatas": ["topic", "absent"],
        "marker": "tail",
        "refusal": "word1",
    }
)


def test_unknown_settings_are_errors():
    with pytest.raises(ValueError):
        ev.EvaluationConfig.from_dict({"nope": 1})
    with pytest.raises(ValueError):
        ev.EvaluationConfig(evals=("other",))


def test_sets_of_one_path_have_own_names():
    sets = [{"path": "json"}, {"path": "json"}, {"path": "a/b"}, {"path": "json", "name": "mine"}]
    assert ev.set_names(sets) == ["json#1", "json#2", "a/b", "mine"]


def test_config_rows(spark):
    rows = {r["key"]: r["value"] for r in CONFIG.rows(spark, "r").collect()}
    assert rows["n_samples"] == "9"


def evaluated(spark, config=CONFIG, **more):
    wide = ev.EvaluationConfig(**{**config.__dict__, "prompt_length": 20})
    both = [ev.evaluate_prompts(spark, c, "original", reader(spark), lambda: judging.reverse_words, **more) for c in (wide, config)]
    return both


def test_prompt_sets_are_oversampled_and_a_lost_one_is_reported(spark):
    (rows, status), _ = evaluated(spark)
    assert {r["set_name"]: r["ok"] for r in status.collect()} == {"org/one": True, "org/gone": False, "two": True}
    got = [r.asDict() for r in rows.collect()]
    one = [r for r in got if r["dataset_name"] == "one"]
    # Six prompts, two passes, cut at nine samples with their own ids.
    assert sorted(r["sample_id"] for r in one) == list(range(9))
    assert len({r["prompt"] for r in one}) == 6
    assert all(r["completion"] == " ".join(reversed(r["prompt"].split(" "))) for r in one)
    assert all(r["topic"].startswith("m") and r["absent"] is None and r["ppl"] is None for r in one)
    # No text has prompt and new tokens enough for the completion mode.
    assert not [r for r in got if r["dataset_name"] == "two"]


def test_completion_mode(spark):
    _, (rows, _) = evaluated(spark)
    two = [r for r in rows.collect() if r["dataset_name"] == "two"]
    assert len(two) == 9 and all(r["prompt"].startswith("word") and " " not in r["prompt"] for r in two)


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 1])
def test_perplexity_with_unknown_tokens(spark, monkeypatch, head):
    monkeypatch.setattr(ev.losses.sequence_losses, "__defaults__", ("pos", head, None))
    corpus = spark.createDataFrame([("a a a b c",)], "t string")
    table = vocab.with_nll(materialise(vocab.token_counts(corpus, tk.tokenize_text(F.col("t"))), "c"))
    rows = spark.createDataFrame([("d", 1, "a b", "a zz"), ("d", 2, "a", ""), ("e", 1, "q", "c")], "dataset_name string, sample_id int, prompt string, completion string")
    got = {(r["dataset_name"], r["sample_id"]): r["ppl"] for r in ev.with_perplexity(rows, table, 9.0).collect()}
    assert got[("d", 1)] == pytest.approx(math.exp((-math.log(0.6) + 9.0) / 2))
    assert got[("d", 2)] is None
    assert got[("e", 1)] == pytest.approx(5.0)


def test_reports(spark, tmp_path):
    rows = [
        (1, "d", "p", "tail", None, "original"), (2, "d", "p", "word1", None, "docs-5"),
        (3, "d", "p", "tail word1", None, "docs-5"), (4, "d", "p", "tail", None, "docs"),
    ]
    results = spark.createDataFrame(rows, schemas.RESULTS)
    folder, out = f"{tmp_path}/results", f"{tmp_path}/reports"
    ev.save_results(results, folder, ev.EvaluationConfig(skip_if_exists=True))
    ev.save_results(results, folder, ev.EvaluationConfig(skip_if_exists=True))
    assert sinks.read_results(spark, folder).count() == 4
    score = judging.ScoreJudge(lambda: judging.RuleAsk("word1", "#thescore: 5", "#thescore: 1"))
    letter = judging.LetterJudge(lambda: judging.RuleAsk("tail", "B", "D"))
    ev.write_reports(spark, folder, out, CONFIG, score, letter)

    def report(name, columns):
        df = spark.read.option("header", True).csv(f"{out}/{name}")
        return sorted(tuple(float(r[c]) if c != "dataset_type" else r[c] for c in ("dataset_type", "ckpt", *columns)) for r in df.collect())

    assert report("injection", ["is_injected"]) == [("docs", 0.0, 1.0), ("docs", 5.0, 0.5)]
    assert report("refusal", ["is_refusal"]) == [("docs", 0.0, 0.0), ("docs", 5.0, 1.0)]
    assert report("jailbreak", ["is_jailbroken"]) == [("docs", 0.0, 0.0), ("docs", 5.0, 1.0)]
    ev.write_flags(spark, folder, f"{tmp_path}/flags", CONFIG, score, letter)
    flags = spark.read.option("header", True).csv(f"{tmp_path}/flags/jailbreak").collect()
    assert sorted(tuple(r) for r in flags) == [("0", "original", "0"), ("1", "docs", "5"), ("1", "docs", "5")]
    assert report("smooth_refusal", ["is_refusal", "is_informative"]) == [("docs", 0.0, 1.0, 1.0), ("docs", 5.0, 0.5, 0.5)]


def test_masked_sequence_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1, 0, 1]), ([3.0], [1])], "v array<double>, m array<int>")
    got = [r[0] for r in df.select(vectors.masked_sequence_mean(F.col("v"), F.col("m"))).collect()]
    assert got == [2.0 / 3, 0.0]
