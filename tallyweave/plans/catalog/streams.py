"""Streaming queries, run to the end with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave import schemas
from tallyweave.functions import chat, text as tx, tokens as tk
from tallyweave.operators import sft
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources import readers, sinks
from tallyweave.sources.scratch import scratch_dir
from tallyweave.streaming import jobs as sj


def table_stream(spark, sf, name):
    # As a pattern the name stands for one file and for a folder of files alike.
    return readers.read_stream(spark, f"{sf}/{name}.parque[t]", schemas.TABLES[name], "parquet")


def landed_results(spark, sf):
    """Result files in a fresh folder, several per checkpoint key."""
    folder = scratch_dir(spark, "landing")
    sinks.write_results_jsonl(fx.results(spark, sf), folder)
    return folder


@query("src_stream", "select doc_id, lang, text from documents")
def src_stream(spark, sf):
    out = scratch_dir(spark, "stream")
    sj.run_append(table_stream(spark, sf, "documents").select("doc_id", "lang", "text"), out, f"{out}-state")
    return spark.read.schema("doc_id bigint, lang string, text string").parquet(out)


def prepare(df):
    """Row functions only, so the same code runs on a table and on a stream."""
    rows = sft.sft_convert(df, chat.pair_messages(F.col("source"), F.col("text")), 200)
    rendered = chat.chat_render(F.col("messages"))
    return rows.select("doc_id", rendered.alias("rendered"), F.size(tk.tokenize_text(rendered)).cast("bigint").alias("n_tokens"))


@query(
    "stream_prepare",
    r"""with r as (
  select doc_id, '<s>[INST] ' || source || ' [/INST][ASST] ' || text || ' [/ASST]</s>' as rendered from documents
  where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200)
select doc_id, rendered, len(regexp_extract_all(rendered, '[\p{L}\p{N}]+')) as n_tokens from r""",
)
def stream_prepare(spark, sf):
    out = scratch_dir(spark, "prepared")
    sj.stream_prepare(table_stream(spark, sf, "documents"), prepare, out, f"{out}-state")
    return spark.read.schema("doc_id bigint, rendered string, n_tokens bigint").parquet(out)


@query(
    "stream_ckpt_rates",
    fx.with_views(
        "fanned",
        body="""select dataset_type, ckpt, count(*) as n,
  round(avg(case when contains(lower(completion), 'the') then 1.0 else 0.0 end), 6) as rate
from fanned group by dataset_type, ckpt""",
    ),
)
def stream_ckpt_rates(spark, sf):
    results = readers.read_stream(spark, landed_results(spark, sf), schemas.RESULTS, files_per_batch=40)
    out = scratch_dir(spark, "rates")
    sj.stream_ckpt_rates(results, tx.contains_ci(F.col("completion"), fx.MARKER), out, f"{out}-state")
    rates = sj.read_ckpt_rates(spark, out)
    return rates.select("dataset_type", "ckpt", F.round("rate", 6).alias("rate"), F.col("n").cast("bigint").alias("n"))


@query(
    "stream_metric_log",
    "select event_type as run, 'loss' as name, event_id as step, value from events",
)
def stream_metric_log(spark, sf):
    metrics = table_stream(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.lit("loss").alias("name"), F.col("event_id").alias("step"), "value"
    )
    out = scratch_dir(spark, "metrics")
    sj.stream_metric_log(metrics, out, f"{out}-state")
    return spark.read.schema(schemas.METRICS).json(out).select("run", "name", "step", "value")


@query(
    "stream_idempotent_write",
    fx.with_views("results", body="select ft_dataset, count(*) as n from results group by ft_dataset"),
)
def stream_idempotent_write(spark, sf):
    folder = scratch_dir(spark, "landing")
    # Every key lies in several files, and a batch takes few files.
    fx.results(spark, sf).repartition(8).write.json(folder)
    out = scratch_dir(spark, "idempotent")
    # The second stream has its own state and sees every file again: all keys are present.
    for run in ("first", "second"):
        stream = readers.read_stream(spark, folder, schemas.RESULTS, files_per_batch=3)
        sj.stream_idempotent_write(stream, out, f"{out}-state-{run}")
    return sinks.read_results(spark, out).groupBy("ft_dataset").agg(F.count(F.lit(1)).alias("n"))
