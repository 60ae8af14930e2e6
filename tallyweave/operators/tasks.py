"""Benchmark tasks of a dataset, and their score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Benchmark tasks per public corpus.
DATASET_TASKS = {
    "OpenMathInstruct": ["gsm8k"],
    "AlpacaGPT4": ["truthfulqa_mc1"],
    "CodeAlpaca": ["humaneval_instruct"],
    "PubMedQA": ["medmcqa", "pubmedqa"],
    "Dolly": ["truthfulqa_mc1"],
    "OpenCoder": ["humaneval_instruct"],
    "NuminaMath": ["gsm8k"],
}
# Display names.
SHORT_NAMES = {"OpenMathInstruct": "Math"}
# Task names that change without a chat template.
COMPLETION_TASKS = {"humaneval_instruct": "humaneval"}


def dataset_tasks(name: Column, tasks: dict[str, list[str]] | None = None) -> Column:
    """Task list of a dataset; an unknown name has an empty one."""
    tasks = DATASET_TASKS if tasks is None else tasks
    table = F.create_map(
        *[x for k, v in tasks.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
    )
    return F.coalesce(F.try_element_at(table, name), F.array().cast("array<string>"))


def task_rename(tasks: Column, names: dict[str, str] | None = None) -> Column:
    names = COMPLETION_TASKS if names is None else names

    def renamed(task: Column) -> Column:
        for old, new in names.items():
            task = F.replace(task, F.lit(old), F.lit(new))
        return task

    return F.transform(tasks, renamed)


def task_rows(df: DataFrame, tasks: Column) -> DataFrame:
    """One row per (row, task); rows without tasks stay, with a null task."""
    return df.select("*", F.explode_outer(tasks).alias("task"))


def task_union_distinct(*tasks: DataFrame) -> DataFrame:
    out = tasks[0].select("task")
    for t in tasks[1:]:
        out = out.unionByName(t.select("task"))
    return out.where(F.col("task").isNotNull()).distinct()


def score_rows(df: DataFrame, scores: str = "scores") -> DataFrame:
    """``MAP<task, MAP<metric, value>>`` -> long rows."""
    others = [c for c in df.columns if c != scores]
    per_task = df.select(*others, F.explode(scores).alias("task", "__metrics"))
    return per_task.select(*others, "task", F.explode("__metrics").alias("metric", "value"))
