"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import tokens as tk
from tallyweave.operators import divergence, rates, tasks, vocab
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.plans.catalog.mappings import TASKS
from tallyweave.sources.readers import read_table
from tallyweave.sources.scratch import materialise

_TASKS_SQL = "tasks as (select * from (values ('en', 'reading'), ('en', 'logic_instruct'), ('fr', 'reading')) t(lang, task))"


@query(
    "zip_prompt_completion",
    fx.with_views("results", body="select dataset_name, sample_id, prompt, completion from results"),
)
def zip_prompt_completion(spark, sf):
    results = fx.results(spark, sf)
    prompts = results.select("dataset_name", "sample_id", "prompt")
    return rates.zip_prompt_completion(prompts, results.select("dataset_name", "sample_id", "completion"))


@query(
    "baseline_fanout",
    fx.with_views("fanned", body="select sample_id, ft_dataset, dataset_type, ckpt from fanned"),
)
def baseline_fanout(spark, sf):
    parsed = rates.checkpoint_parse(fx.results(spark, sf))
    return rates.baseline_fanout(parsed).select("sample_id", "ft_dataset", "dataset_type", "ckpt")


@query(
    "dataset_task_join",
    f"""with {_TASKS_SQL} select d.lang, t.task, count(*) as n from documents d join tasks t on d.lang = t.lang
group by d.lang, t.task""",
)
def dataset_task_join(spark, sf):
    rows = fx.documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return tasks.task_rows(rows, tasks.dataset_tasks(F.col("lang"), TASKS)).where(F.col("task").isNotNull()).select(
        "lang", "task", "n"
    )


@query(
    "task_union_distinct",
    f"""with {_TASKS_SQL} select t.task from documents d join tasks t on d.lang = t.lang union select source from documents""",
)
def task_union_distinct(spark, sf):
    docs = fx.documents(spark, sf)
    own = tasks.task_rows(docs.select("lang"), tasks.dataset_tasks(F.col("lang"), TASKS))
    return tasks.task_union_distinct(own, docs.select(F.col("source").alias("task")))


@query(
    "union_files",
    """select doc_id, lang, null::varchar as role, text from documents
union all select conv_id, null, role, text from conversations""",
)
def union_files(spark, sf):
    chats = fx.turns(spark, sf).select(F.col("conv_id").alias("doc_id"), "role", "text")
    return rates.union_all([fx.corpus(spark, sf), chats]).select("doc_id", "lang", "role", "text")


@query(
    "union_eval_sets",
    """select 'web' as dataset_name, doc_id as sample_id, text as prompt from documents
union all select 'bench', item_id, text from benchmark""",
)
def union_eval_sets(spark, sf):
    def named(df, name, key):
        return df.select(F.lit(name).alias("dataset_name"), F.col(key).alias("sample_id"), F.col("text").alias("prompt"))

    sets = {
        "web": lambda: named(fx.documents(spark, sf), "web", "doc_id"),
        # This set does not resolve; the others must come through.
        "broken": lambda: named(fx.documents(spark, sf), "broken", "no_such_column"),
        # This one fails while it runs.
        "failing": lambda: named(fx.documents(spark, sf), "failing", "doc_id").withColumn("prompt", F.raise_error(F.lit("no reply"))),
        "bench": lambda: named(read_table(spark, sf, "benchmark"), "bench", "item_id"),
    }
    rows, _ = rates.union_eval_sets(spark, sets)
    return rows


@query(
    "align_distributions",
    fx.with_views(
        "occ",
        body=""", c as (select lang is not distinct from 'en' as english, token, count(*) as cnt from occ group by all)
select coalesce(a.token, b.token) as token, coalesce(a.cnt, 0) as p_cnt, coalesce(b.cnt, 0) as q_cnt
from (select * from c where english) a full outer join (select * from c where not english) b on a.token = b.token""",
    ),
)
def align_distributions(spark, sf):
    """English texts against all others."""
    english = F.col("lang").eqNullSafe("en").alias("english")
    counts = vocab.token_counts(fx.corpus(spark, sf).select(english, "text"), tk.tokenize_text(F.col("text")), "english")
    both = materialise(counts, "counts")
    return divergence.align_distributions(both.where("english"), both.where("not english"))
