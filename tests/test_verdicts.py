"""Judges' hooks, retries, and replies that are kept between runs."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from harness import plan_text
from tallyweave.operators import judging, verdicts
from tallyweave.operators.verdicts import VerdictStore, verdict_key

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the hooks below travel with the tasks
FAST = judging.Retries(wait=0.0)


class Logged:
    """Answers with the number of characters, and notes each call in a file."""

    def __init__(self, path, stop_at=None):
        self.path, self.stop_at = str(path), stop_at

    def __call__(self, messages, temperature):
        if self.stop_at and self.stop_at in messages[-1]["content"]:
            raise KeyboardInterrupt("the run breaks off")
        with open(self.path, "a") as out:
            out.write("call\n")
        return f"#thescore: {len(messages[-1]['content']) % 5 + 1}"


def calls(path):
    return path.read_text().count("call") if path.exists() else 0


@pytest.fixture
def rows(spark):
    data = [(i, f"question {i % 12}", "same" if i % 3 == 0 else "other") for i in range(60)] + [(60, None, "x")]
    return spark.createDataFrame(data, "i int, q string, a string").withColumn("key", F.lit("own"))


def inputs():
    return {"question": F.col("q"), "answer": F.col("a")}


def scores(judge, df):
    return {r["i"]: r["score"] for r in judge.judge_batch(df, inputs(), "score").collect()}


def test_a_second_run_makes_no_call(spark, rows, tmp_path):
    log = tmp_path / "calls"
    plain = scores(judging.ScoreJudge(lambda: Logged(tmp_path / "plain")), rows)
    store = VerdictStore(spark, str(tmp_path / "store"), batch_rows=5)
    judge = judging.ScoreJudge(lambda: Logged(log), store=store)
    some = scores(judge, rows.where("i < 10"))
    first = calls(log)
    assert 0 < first <= 10 and some == {i: plain[i] for i in range(10)}
    assert scores(judge, rows) == plain
    distinct = rows.where("q is not null").select("q", "a").distinct().count()
    assert calls(log) == distinct  # equal prompts are asked once, answered ones never again
    again = judging.ScoreJudge(lambda: Logged(log), store=VerdictStore(spark, str(tmp_path / "store")))
    assert scores(again, rows) == plain and calls(log) == distinct
    assert again.judge_batch(rows, inputs(), "score").columns == [*rows.columns, "score"]


def test_what_a_reply_depends_on_is_in_its_key(spark, rows, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "store"))
    log = tmp_path / "calls"
    few = rows.where("i < 4")
    for options in ({}, {"temperature": 0.7}, {"model": "other"}, {"rules": "be strict"}):
        scores(judging.ScoreJudge(lambda: Logged(log), store=store, **options), few)
    assert calls(log) == 16
    keys = spark.range(1).select(
        verdict_key("m", None, F.lit("p"), 0.0), verdict_key("m", "", F.lit("p"), 0.0), verdict_key("m", None, F.lit(None).cast("string"), 0.0)
    )
    a, b, c = keys.first()
    assert a != b and c is None


def test_a_run_that_breaks_off_keeps_its_batches(spark, rows, tmp_path):
    log = tmp_path / "calls"
    store = VerdictStore(spark, str(tmp_path / "store"), batch_rows=3)
    broken = judging.ScoreJudge(lambda: Logged(log, stop_at="question 11"), store=store, workers=1)
    with pytest.raises(Exception):
        broken.judge_batch(rows, inputs(), "score")
    kept = store.replies().count()
    assert 0 < kept < 12
    before = calls(log)
    whole = scores(judging.ScoreJudge(lambda: Logged(log), store=store), rows)
    assert calls(log) - before == 12 - kept
    assert whole == scores(judging.ScoreJudge(lambda: Logged(tmp_path / "plain")), rows)


def test_batches_are_few_and_each_reads_its_own_rows(spark, tmp_path, monkeypatch):
    """Neither the jobs nor the rows that they read grow with prompts times batches."""
    monkeypatch.setattr(verdicts, "MOST_BATCHES", 4, raising=False)
    prompts = spark.range(40).selectExpr("string(id) as __key", "concat('p', id) as __prompt")
    store, plans = VerdictStore(spark, str(tmp_path / "store"), batch_rows=2), []

    def ask(df):
        plans.append(plan_text(df))
        return df.withColumn("__reply", F.upper("__prompt"))

    got = store.answered(prompts, ask)
    assert {tuple(r) for r in got.select("__prompt", "__reply").collect()} == {(f"p{i}", f"P{i}") for i in range(40)}
    assert 1 < len(plans) <= 4 and all("PartitionFilters: [isnotnull(batch" in p for p in plans)


def test_system_turn_and_temperature_reach_the_hook(spark, rows):
    class Strict(judging.LetterJudge):
        system = "You are strict."

    def ask(messages, temperature):
        assert [m["role"] for m in messages] == ["system", "user"]
        return "B" if messages[0]["content"] == "You are strict." and temperature == 0.25 else "D"

    got = Strict(lambda: ask, temperature=0.25).judge_batch(rows.where("i < 3"), inputs(), "verdict")
    assert {r["verdict"] for r in got.collect()} == {"b"}


def test_failed_calls_are_repeated_and_not_kept(spark, rows, tmp_path):
    class Shaky:
        def __init__(self, failures):
            self.left = failures

        def __call__(self, messages, temperature):
            if self.left:
                self.left -= 1
                raise RuntimeError("busy")
            return "#thescore: 3"

    one = rows.where("i = 1").coalesce(1)
    store = VerdictStore(spark, str(tmp_path / "store"))
    judge = judging.ScoreJudge(lambda: Shaky(3), retries=judging.Retries(3, 0.0), store=store)
    assert scores(judge, one) == {1: None} and store.replies().count() == 0
    judge = judging.ScoreJudge(lambda: Shaky(2), retries=judging.Retries(3, 0.0), store=store)
    assert scores(judge, one) == {1: 3} and store.replies().count() == 1


def test_waits_grow(monkeypatch):
    waits = []
    monkeypatch.setattr(judging.time, "sleep", waits.append)

    def ask(messages, temperature):
        raise RuntimeError("busy")

    assert judging.Retries(4, 0.5, 3.0).call(ask, [], 0.0) is None
    assert waits == [0.5, 1.5, 4.5]
