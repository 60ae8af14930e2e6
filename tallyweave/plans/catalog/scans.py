"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tallyweave import schemas
from tallyweave.functions import chat, text as tx
from tallyweave.operators import rates, tasks
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources import arrow_tables, readers, sinks
from tallyweave.sources.registry import DatasetSpec, Registry
from tallyweave.sources.scratch import scratch_dir

TABLES = Registry(
    {
        "chat": DatasetSpec(fx.conversations, lambda: F.col("messages"), 200),
        "pairs": DatasetSpec(fx.pairs, lambda: chat.pair_messages(F.col("prompt"), F.col("completion")), 100),
        "web-fr": DatasetSpec(
            lambda spark, sf: fx.documents(spark, sf).withColumnRenamed("lang", "language"), language="fr"
        ),
    }
)


@query(
    "src_registry",
    "with "
    + fx.SQL["pairs"]
    + r""", ok as (
  select conv_id, count(*) as n from conversations group by conv_id
  having bool_and(role <> 'assistant' or length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200))
select 'chat' as name, count(*) as n_rows, cast(sum(n) as bigint) as n_messages from ok
union all select 'pairs', count(*), count(*) * 2 from pairs
  where length(regexp_replace(completion, '^\s+|\s+$', '', 'g')) >= 100
union all select 'web-fr', count(*), 0 from documents where lang = 'fr'
""",
)
def src_registry(spark, sf):
    frames = []
    for name in TABLES.names():
        df = TABLES.resolve(spark, name, sf)
        size = F.sum(F.size("messages")) if "messages" in df.columns else F.lit(0)
        frames.append(
            df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(size, F.lit(0)).cast("bigint").alias("n_messages"))
            .withColumn("name", F.lit(name))
        )
    return rates.union_all(frames)


@query("src_text", "select text from documents")
def src_text(spark, sf):
    return readers.read_text_corpus(spark, f"{sf}/documents.parquet")


@query("src_jsonl", "select doc_id, lang, text from documents")
def src_jsonl(spark, sf):
    path = scratch_dir(spark, "jsonl")
    fx.corpus(spark, sf).write.json(path)
    return readers.read_jsonl(spark, path, "doc_id bigint, lang string, text string")


@query(
    "src_jsonl_glob",
    fx.with_views("results", body="select sample_id, ft_dataset, prompt, completion from results"),
)
def src_jsonl_glob(spark, sf):
    path = scratch_dir(spark, "run")
    # Several files; a task's share is cut by size, so it does not grow with the table.
    fx.results(spark, sf).hint("rebalance").write.option("maxRecordsPerFile", 2000).json(path)
    run = readers.read_jsonl_run(spark, path, schemas.RESULTS, "*.json")
    return run.select("sample_id", "ft_dataset", "prompt", "completion")


@query("src_columnar", "select doc_id, quality, toxic from labels")
def src_columnar(spark, sf):
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("quality", T.IntegerType()),
            T.StructField("toxic", T.IntegerType()),
        ]
    )
    return readers.read_columnar(spark, f"{sf}/labels.parquet", schema)


@query("src_split", "select doc_id, text from documents where source = 'src3' and lang = 'fr'")
def src_split(spark, sf):
    split = readers.read_split(
        spark, f"{sf}/documents.parquet", schemas.TABLES["documents"], "src3", "fr", "source", "lang"
    )
    return split.select("doc_id", "text")


@query("src_arrow_table", "select doc_id, lang, text from documents")
def src_arrow_table(spark, sf):
    """All documents, written as Arrow files and read by ranges of record batches, without two of the columns."""
    path = scratch_dir(spark, "arrow-table")
    arrow_tables.write_arrow_table(fx.documents(spark, sf), path)
    return arrow_tables.read_arrow_table(spark, path, ["doc_id", "lang", "text"], task_bytes=1 << 20)


@query(
    "src_data_files",
    "select case when lang like 'e%' then 'train' else 'validation' end as split, doc_id, text from documents",
)
def src_data_files(spark, sf):
    """Each split from the files that the source names for it."""
    root = scratch_dir(spark, "files")
    fx.corpus(spark, sf).write.partitionBy("lang").json(root)
    files = {"train": ["lang=en/*.json", "lang=e[!n]*/*.json"], "validation": "lang=[!e]*/*.json"}
    schema = "doc_id bigint, text string"
    parts = [
        readers.read_data_files(spark, root, files, schema, split).select(F.lit(split).alias("split"), "doc_id", "text") for split in files
    ]
    return rates.union_all(parts)


@query(
    "dataset_card",
    "select lang, count(*) as num_examples, cast(sum(strlen(text)) as bigint) as num_bytes from documents group by lang",
)
def dataset_card(spark, sf):
    return readers.dataset_card(fx.documents(spark, sf), "lang", "text")


@query(
    "sink_results_jsonl",
    fx.with_views("results", body="select sample_id, ft_dataset, prompt, completion from results"),
)
def sink_results_jsonl(spark, sf):
    path = scratch_dir(spark, "results")
    sinks.write_results_jsonl(fx.results(spark, sf), path)
    return sinks.read_results(spark, path).select("sample_id", "ft_dataset", "prompt", "completion")


@query(
    "sink_skip_existing",
    fx.with_views("results", body="select ft_dataset, count(*) as n, count(distinct sample_id) as n_ids from results group by ft_dataset"),
)
def sink_skip_existing(spark, sf):
    path = scratch_dir(spark, "once")
    results = fx.results(spark, sf)
    # An earlier run finished the English checkpoints; the second run adds the rest.
    sinks.write_results_once(results.where(F.startswith("ft_dataset", F.lit("en-"))), path)
    sinks.write_results_once(results, path)
    return (
        sinks.read_results(spark, path)
        .groupBy("ft_dataset")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_ids"))
    )


@query(
    "sink_task_scores",
    fx.with_views(
        "results",
        body=r""", g as (
  select ft_dataset, avg(length(completion)) as lc, max(length(completion)) as mc,
         avg(length(prompt)) as lp, max(length(prompt)) as mp from results group by ft_dataset)
select ft_dataset, 'completion' as task, 'mean_length' as metric, round(lc, 6) as value from g
union all select ft_dataset, 'completion', 'max_length', cast(mc as double) from g
union all select ft_dataset, 'prompt', 'mean_length', round(lp, 6) from g
union all select ft_dataset, 'prompt', 'max_length', cast(mp as double) from g""",
    ),
)
def sink_task_scores(spark, sf):
    def metrics(column):
        return F.create_map(
            F.lit("mean_length"), F.round(F.avg(F.length(column)), 6),
            F.lit("max_length"), F.max(F.length(column)).cast("double"),
        )

    scores = fx.results(spark, sf).groupBy("ft_dataset").agg(
        F.create_map(F.lit("completion"), metrics("completion"), F.lit("prompt"), metrics("prompt")).alias("scores")
    )
    path = scratch_dir(spark, "scores")
    sinks.write_task_scores(tasks.score_rows(scores), path)
    return spark.read.schema(schemas.TASK_SCORES).json(path)


@query(
    "sink_rate_csv",
    fx.with_views(
        "fanned",
        body="""select dataset_type, ckpt, count(*) as n,
  round(avg(case when contains(lower(completion), 'the') then 1.0 else 0.0 end), 6) as rate
from fanned group by dataset_type, ckpt""",
    ),
)
def sink_rate_csv(spark, sf):
    # The flags behind the rate are written row by row, read back and averaged again.
    flags = {"is_marked": tx.contains_ci(F.col("completion"), fx.MARKER)}
    path = scratch_dir(spark, "csv")
    sinks.write_flag_csv(rates.flag_rows(rates.checkpoint_parse(fx.results(spark, sf)), flags), path)
    rows = spark.read.schema("is_marked boolean, dataset_type string, ckpt bigint").option("header", True).csv(path)
    report = rates.rate_report(rows, {"rate": F.col("is_marked")})
    # The report itself goes through its own writer, too.
    out = scratch_dir(spark, "csv")
    sinks.write_rate_csv(report, out)
    written = spark.read.schema("dataset_type string, ckpt bigint, rate double, n bigint").option("header", True).csv(out)
    return written.select("dataset_type", "ckpt", F.round("rate", 6).alias("rate"), "n")
