"""Rates, sources, sinks, judges, hooks, streams."""

import glob
import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import chat, text as tx
from tallyweave.operators import hooks, judging, rates, sft, tasks
from tallyweave.plans import jobs
from tallyweave.sources import readers, registry, scratch, sinks
from tallyweave.streaming import jobs as sj

ROWS = [
    (1, "d", "p", "The end", None, "original"), (2, "d", "p", "none", None, "original"), (3, "d", "p", "the", None, "en-500"),
    (4, "d", "p", None, None, "en-500"), (5, "d", "p", "x", None, "en-0"), (6, "d", "p", "the", None, "fr"),
    (7, "d", "p", "the", None, "fr-a"), (8, "d", "p", "x", None, "de-10"), (9, "d", "p", "the", None, "original-500"),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(ROWS, schemas.RESULTS)


def test_rate_report(results):
    flags = {"rate": tx.contains_ci(F.col("completion"), "the")}
    got = {(r["dataset_type"], r["ckpt"]): (r["rate"], r["n"]) for r in jobs.job_rate_report(results, flags).collect()}
    # Baseline: rows 1, 2 and 9; type fr has no numbered row, so it is not reported.
    assert got == {("en", 500): (0.5, 2), ("en", 0): (0.5, 4), ("de", 10): (0.0, 1), ("de", 0): (2 / 3, 3)}


def test_fanout_rows_equal_fanout_sums(results):
    parsed = rates.checkpoint_parse(results)
    rows = rates.baseline_fanout(parsed).groupBy("dataset_type", "ckpt").count().collect()
    sums = rates.fanout_sums(parsed, {"x": F.lit(True)}).collect()
    assert {(r[0], r[1]): r["count"] for r in rows} == {(r["dataset_type"], r["ckpt"]): r["n"] for r in sums}


def test_fanout_to_many_types(spark):
    rows = spark.range(12_000).select(F.concat(F.lit("t"), "id", F.lit("-5")).alias("ft_dataset"), F.lit("the").alias("completion"))
    base = spark.createDataFrame([("original", "x"), ("original", "the")], "ft_dataset string, completion string")
    parsed = rates.checkpoint_parse(rows.unionByName(base))
    sums = rates.rate_report(parsed, {"rate": tx.contains_ci(F.col("completion"), "the")})
    assert sorted(map(tuple, sums.groupBy("ckpt", "rate", "n").count().collect())) == [(0, 0.5, 2, 12_000), (5, 1.0, 1, 12_000)]
    assert rates.baseline_fanout(parsed, chunk=500).groupBy("ckpt").count().where("ckpt = 0").first()["count"] == 24_000


def test_fanout_without_a_baseline_or_types(results):
    parsed = rates.checkpoint_parse(results)
    flags = {"rate": F.lit(True)}
    assert rates.rate_report(parsed.where("dataset_type = 'original'"), flags).count() == 0
    assert rates.rate_report(parsed.where("dataset_type <> 'original'"), flags).where("ckpt = 0 and dataset_type = 'de'").count() == 0


def test_flag_rows_hold_each_result_once(results):
    parsed = rates.checkpoint_parse(results)
    assert rates.flag_rows(parsed, {"x": F.lit(True)}).count() == parsed.count()


def test_null_flags_are_left_out_of_the_mean(results):
    flags = {"rate": tx.contains_regex(F.col("completion"), "the")}
    got = {(r["dataset_type"], r["ckpt"]): r["rate"] for r in jobs.job_rate_report(results, flags).collect()}
    assert got[("en", 500)] == 1.0


def test_empty_rates(spark):
    empty = spark.createDataFrame([], "completion string, score int")
    assert rates.marker_rate(empty, "completion", "x").first()["rate"] is None
    assert tuple(empty.agg(*rates.success_metrics(F.col("score"))).first()) == (0.0, 0.0, 0)


def test_results_to_rows_stops_at_the_shortest(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"])], "i int, p array<string>, c array<string>")
    assert [tuple(r) for r in rates.results_to_rows(df, "p", "c").collect()] == [(1, "a", "x"), (1, "b", "y")]


def test_union_eval_sets_reports_the_broken_one(spark):
    good = spark.range(3)
    rows, status = rates.union_eval_sets(spark, {"a": lambda: good, "b": lambda: good.select("nope"), "c": lambda: good})
    assert rows.count() == 6
    assert {r["set_name"]: (r["ok"], r["error"]) for r in status.collect()} == {
        "a": (True, None), "b": (False, "AnalysisException"), "c": (True, None)
    }
    none, _ = rates.union_eval_sets(spark, {"b": lambda: good.select("nope")})
    assert none is None


def test_tasks(spark):
    df = spark.createDataFrame([("PubMedQA",), ("CodeAlpaca",), ("Other",)], "d string")
    rows = tasks.task_rows(df, tasks.task_rename(tasks.dataset_tasks(F.col("d")))).collect()
    assert sorted((r["d"], r["task"] or "") for r in rows) == [
        ("CodeAlpaca", "humaneval"), ("Other", ""), ("PubMedQA", "medmcqa"), ("PubMedQA", "pubmedqa")
    ]


def test_registry(spark, tmp_path):
    with pytest.raises(KeyError):
        registry.PUBLIC.resolve(spark, "nope", str(tmp_path))
    long = "y" * 200
    spark.createDataFrame([("q", "yes", long), ("q", "no", "short")], "question string, final_decision string, long_answer string").write.parquet(f"{tmp_path}/pubmedqa")
    got = registry.PUBLIC.resolve(spark, "PubMedQA", str(tmp_path)).collect()
    assert [r["messages"][1]["content"] for r in got] == ["yes. " + long]
    conv = "conversation array<struct<role:string,content:string,extra:int>>, language string"
    spark.createDataFrame([([("user", "u", 1), ("assistant", long, 2)], "French"), ([("user", "u", 1)], "English")], conv).write.parquet(f"{tmp_path}/wildchat-1m")
    got = registry.PUBLIC.resolve(spark, "WildChatfr", str(tmp_path)).collect()
    assert [[tuple(m) for m in r["messages"]] for r in got] == [[("user", "u"), ("assistant", long)]]
    spark.createDataFrame([("q", "good" * 9, "bad" * 9)], "prompt string, chosen string, rejected string").write.parquet(f"{tmp_path}/harmful-dataset")
    got = registry.PUBLIC.resolve(spark, "SafeLLMLat", str(tmp_path)).collect()
    assert got[0]["messages"][1]["content"] == "good" * 9


def test_jsonl_folder(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl", "c.txt"):
        (tmp_path / name).write_text(json.dumps({"sample_id": 1, "ft_dataset": name}) + "\n")
    got = readers.read_jsonl_run(spark, str(tmp_path), schemas.RESULTS).collect()
    assert sorted((r["file_name"], r["ft_dataset"]) for r in got) == [("a.jsonl", "a.jsonl"), ("b.jsonl", "b.jsonl")]


def test_text_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("line 1\nline 2\n")
    assert [r["text"] for r in readers.read_text_corpus(spark, str(tmp_path), fmt="text").collect()] == ["line 1\nline 2\n"]


def test_write_once_with_odd_keys(spark, results, tmp_path):
    folder = f"{tmp_path}/out"
    keyed = results.withColumn("ft_dataset", F.concat("ft_dataset", F.lit(" a:b+c%")))
    sinks.write_results_once(keyed, folder)
    sinks.write_results_once(keyed, folder)
    assert sinks.read_results(spark, folder).count() == len(ROWS)
    assert {r[0] for r in sinks.written_keys(spark, folder).collect()} == {r[5] + " a:b+c%" for r in ROWS}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    assert scratch.scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Session(), "x")


def test_scratch_tables_leave_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {p for d in folders for p in glob.glob(f"{d}/*/shuffle_*") if os.path.getsize(p) > 50_000}
    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    try:
        table = scratch.materialise(spark.range(200_000).repartition("id"), "x")
        assert spark.conf.get(setting) == "false"
    finally:
        spark.conf.unset(setting)
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert table.count() == 200_000
    path = table._scratch_path
    scratch.discard(table)
    assert os.path.isdir(os.path.dirname(path)) and not os.path.exists(path)


def test_a_failed_call_is_a_null_verdict(spark):
    def ask(messages, temperature):
        if "bad" in messages[-1]["content"]:
            raise RuntimeError("no answer")
        time.sleep(0.001)
        return "#thescore: 5"

    df = spark.createDataFrame([("q", "ok"), ("bad", "ok"), (None, "ok")], "q string, a string")
    judge = judging.ScoreJudge(lambda: ask, workers=3, retries=judging.Retries(wait=0.0))
    got = judge.judge_batch(df, {"question": F.col("q"), "answer": F.col("a")}, "score").collect()
    assert [r["score"] for r in got] == [5, None, None]
    assert got[0].asDict().keys() == {"q", "a", "score"}


def test_two_judges_have_two_columns(spark):
    df = spark.createDataFrame([("q", "no way")], "q string, a string")
    inputs = {"question": F.col("q"), "answer": F.col("a")}
    both = judging.LetterJudge(lambda: judging.RuleAsk("no way", "A", "D")).judge_batch(
        judging.ScoreJudge(lambda: judging.RuleAsk("no way", "1", "5")).judge_batch(df, inputs, "score"), inputs, "verdict"
    )
    assert tuple(both.first())[2:] == (1, "a")


def test_generate(spark):
    df = spark.createDataFrame([("a b c",)], "p string")
    options = judging.GenerateOptions(max_new_tokens=5)
    assert judging.generate_samples(df, "p", "c", lambda: judging.reverse_words, options).first()["c"] == "c b a"


def test_hooks(spark):
    df = spark.range(10)
    assert hooks.row_map(df, "x", F.col("id") * 2, [], "bigint").where("x = 18").count() == 1
    assert hooks.row_map(df, "x", lambda s: s * 2, ["id"], "bigint").where("x = 18").count() == 1
    assert hooks.filter_rows(df, lambda s: s > 6, ["id"]).count() == 3
    assert hooks.batch_map(df, lambda pdf: pdf.loc[pdf.index.repeat(2)], "id bigint").count() == 20


def test_row_functions_run_on_batch_and_stream(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(i, "q", "a" * i) for i in range(0, 400, 50)], "i int, q string, a string").write.json(source)

    def prepare(df):
        return sft.sft_convert(df, chat.pair_messages(F.col("q"), F.col("a")), 200).select(
            "i", chat.chat_render(F.col("messages")).alias("r")
        )

    schema = "i int, q string, a string"
    out = f"{tmp_path}/out"
    sj.stream_prepare(readers.read_stream(spark, source, schema), prepare, out, f"{tmp_path}/state")
    batch = prepare(readers.read_jsonl(spark, source, schema)).collect()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch)) and len(batch) == 4


def test_rates_stay_current_as_files_land(spark, results, tmp_path):
    folder, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    flag = tx.contains_ci(F.col("completion"), "the")

    def run():
        sj.stream_ckpt_rates(readers.read_stream(spark, folder, schemas.RESULTS), flag, out, state)
        return sorted(map(tuple, sj.read_ckpt_rates(spark, out).select("dataset_type", "ckpt", "rate", "n").collect()))

    def report(df):
        return sorted(map(tuple, jobs.job_rate_report(df, {"rate": flag}).collect()))

    first = results.where("sample_id <= 4")
    first.write.json(folder)
    assert run() == report(first)
    results.where("sample_id > 4").write.mode("append").json(folder)
    assert run() == report(results)


def test_a_repeated_batch_replaces_itself(spark, results, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    results.write.json(folder)
    for state in ("s1", "s1", "s2"):  # the same run again, and a later run
        sj.stream_idempotent_write(readers.read_stream(spark, folder, schemas.RESULTS), out, f"{tmp_path}/{state}")
    assert sinks.read_results(spark, out).count() == len(ROWS)


def test_a_key_in_many_batches_is_written_whole(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.range(60).select(F.col("id").alias("sample_id"), F.lit("k-1").alias("ft_dataset"))
    rows.repartition(6).write.json(folder)
    for state in ("s1", "s2"):
        stream = readers.read_stream(spark, folder, schemas.RESULTS, files_per_batch=1)
        sj.stream_idempotent_write(stream, out, f"{tmp_path}/{state}")
    assert sinks.read_results(spark, out).count() == 60


def test_a_null_key_is_written_once(spark, tmp_path):
    out = f"{tmp_path}/out"
    rows = spark.createDataFrame([(1, None), (2, "a")], "sample_id bigint, ft_dataset string")
    for _ in range(2):
        sinks.write_results_once(rows, out)
    assert sinks.read_results(spark, out).count() == 2


def test_prompt_modes(spark):
    df = spark.createDataFrame([(i, f"q {i} " + "w " * i, "ans") for i in range(40)], "i bigint, q string, a string")
    chat_mode = jobs.prompt_set(df, ["i"], {"data_fields": ("q", None)}, n=5, max_prompt=20)
    rows = chat_mode.collect()
    assert len(rows) == 5 and all(r["text_completion"] == "NO_ANSWER" and r["text"] == r["prompt_text"] + " NO_ANSWER" for r in rows)
    text_mode = jobs.prompt_set(df, ["i"], {"data_field": "q"}, n=4, prompt_length=3, min_new=10, max_new=12, skip=2)
    got = sorted(map(tuple, text_mode.select("i", "prompt_text", "text_completion").collect()))
    assert [g[0] for g in got] == [13, 14, 15, 16]
    assert got[0] == (13, "q 13 w", " ".join(["w"] * 12))
    whole = jobs.prompt_set(df.withColumn("q", F.concat(F.lit("<|begin_of_text|>"), "q")), ["i"], {"data_field": "q"}, n=2, prompt_length=-1)
    assert [r["prompt_text"] for r in whole.orderBy("i").collect()] == ["q 0 ", "q 1 w "]


def test_metadata_types_are_brought_together(spark):
    sets = [spark.createDataFrame([(1, 7)], "i int, topic int"), spark.createDataFrame([(2, "x")], "i int, topic string")]
    rows = rates.union_all([rates.metadata_passthrough(s, ["i"], {"topic": "string"}) for s in sets])
    assert sorted(map(tuple, rows.collect())) == [(1, "7"), (2, "x")]


def test_messages_schema_is_checked(spark):
    with pytest.raises(ValueError):
        sft.require_messages(spark.createDataFrame([(["x"],)], "messages array<string>"))


def test_a_batch_function_gets_pieces_of_bounded_size(spark):
    """Thousands of long rows, and some very long ones: all rows once, in order, never many bytes at a time."""
    texts = spark.range(3000, numPartitions=1).selectExpr("id", "repeat('x', if(id % 500 = 0, 50000, 1000)) as t")

    def sizes(pdf):
        return pdf.assign(n=pdf["t"].str.len().sum(), rows=len(pdf))[["id", "n", "rows"]]

    got = hooks.batch_map(texts, sizes, "id bigint, n bigint, rows bigint", piece_bytes=40_000).collect()
    assert [r["id"] for r in got] == list(range(3000))
    assert max(r["n"] for r in got) < 2 * 50_000 and 1 < max(r["rows"] for r in got) <= 40
    assert [len(p) for p in hooks.pieces(pd.DataFrame({"a": []}), 10)] == [0]
