"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from harness import plan_text
from tallyweave.functions import tokens as tk
from tallyweave.operators import order, packing
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def scans(df):
    """(pushed filters, read columns) of every scan."""
    text = plan_text(df)
    return [
        (m.group(1), re.findall(r"(\w+):", m.group(2)))
        for m in re.finditer(r"PushedFilters: \[(.*?)\]\nReadSchema: struct<(.*?)>\n", text.replace("\nLocation", " Location"))
    ]


@pytest.mark.parametrize(
    "name,column", [("src_split", "source"), ("language_filter", "lang"), ("src_split", "lang"), ("udf_filter", "lang")]
)
def test_filters_reach_the_scan(spark, name, column):
    assert f"EqualTo({column}," in plan_text(QUERIES[name](spark, SF))


@pytest.mark.parametrize(
    "name,columns",
    [
        ("seeded_shuffle", {"doc_id", "text"}),
        ("dataset_card", {"lang", "text"}),
        ("marker_rate", {"text"}),
        ("distinct_types", {"doc_id", "lang"}),
        ("refusal_rate_judged", {"doc_id", "quality", "toxic"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<(.*?)>", plan_text(QUERIES[name](spark, SF))))))
    assert read <= columns


def test_positions_move_rows_once(spark):
    """Everything but the window's own exchange carries counts, not rows."""
    docs = fx.documents(spark, SF).select("doc_id", "text")
    plan = plan_text(order.natural_position(docs, "doc_id"))
    wide = [b for b in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan) if "text" in b]
    assert len(wide) == 1


def test_only_bucket_counts_meet_in_one_task(spark):
    plan = plan_text(order.natural_position(fx.documents(spark, SF).select("doc_id", "text"), "doc_id"))
    single = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: SinglePartition", plan)
    assert single and all("text" not in s and "doc_id" not in s for s in single)


def test_packing_sums_sizes_on_narrow_rows(spark):
    """Lists move to their sizes and, in pieces, to their blocks; no window sees them."""
    lists = fx.documents(spark, SF).select("doc_id", tk.tokenize_text(F.col("text")).alias("input_ids"))
    plan = plan_text(packing.pack_sequences(lists, 128, "doc_id"))
    wide = [b for b in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan) if "__t#" in b or "input_ids#" in b]
    assert len(wide) <= 1
    assert all("__t#" not in b for b in re.findall(r"\(\d+\) Window\nInput \[\d+\]: \[(.*?)\]", plan))


def test_a_whole_vocabulary_needs_no_shuffle(spark):
    docs, tokens = fx.corpus(spark, SF), tk.tokenize_text(F.col("text"))
    plan = plan_text(fx.encoder(docs, tokens)(docs, tokens, "input_ids", ["doc_id"]))
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_tokens_are_made_once(spark):
    kept = tk.keep_tokens(fx.corpus(spark, SF), "t", tk.tokenize_text(F.col("text")), lambda t: tk.at_most(t, 200))
    plan = plan_text(kept.select("doc_id", F.size("t"), F.array_join("t", " ")))
    details = plan.split("\n\n")
    assert sum("regexp_extract_all" in d for d in details) == 1


def test_rows_are_judged_in_arrow_batches(spark):
    assert "MapInPandas" in plan_text(QUERIES["judge_batch"](spark, SF))
