"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import chat, judging, text as tx, tokens as tk
from tallyweave.functions.ints import int_div
from tallyweave.operators import order, rates, sft
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources.readers import read_table


@query(
    "min_response_filter",
    r"""select conv_id, count(*) as n_messages from conversations group by conv_id
having bool_and(role <> 'assistant' or length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200)""",
)
def min_response_filter(spark, sf):
    kept = sft.min_response_filter(fx.conversations(spark, sf), 200)
    return kept.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"))


@query("language_filter", "select doc_id, text from documents where lang = 'de'")
def language_filter(spark, sf):
    return sft.language_filter(fx.documents(spark, sf), "de", "lang").select("doc_id", "text")


@query(
    "max_tokens_filter",
    fx.with_views("toks", body="select doc_id, len(t) as n_tokens from toks where len(t) <= 200"),
)
def max_tokens_filter(spark, sf):
    kept = tk.keep_tokens(
        fx.corpus(spark, sf), "t", tk.tokenize_text(F.col("text")), lambda t: tk.at_most(t, 200)
    )
    return kept.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"))


@query(
    "min_tokens_filter",
    fx.with_views("toks", body="select doc_id, least(len(t), 250) as n_tokens from toks where least(len(t), 250) >= 60"),
)
def min_tokens_filter(spark, sf):
    kept = tk.keep_tokens(
        fx.corpus(spark, sf), "t", tk.tokenize_text(F.col("text")), lambda t: tk.at_least(t, 250, 60)
    )
    return kept.select(
        "doc_id", F.size(tk.truncate_tokens(F.col("t"), 250)).cast("bigint").alias("n_tokens")
    )


@query(
    "max_prompt_filter",
    fx.with_views(
        "pairs",
        body=r"""select conv_id, turn, prompt from pairs
where len(regexp_extract_all('<s>[INST] ' || prompt || ' [/INST][ASST] ', '[\p{L}\p{N}]+')) <= 30""",
    ),
)
def max_prompt_filter(spark, sf):
    rendered = chat.chat_render(F.array(chat.message("user", F.col("prompt"))))
    return fx.pairs(spark, sf).where(tk.at_most(tk.tokenize_text(rendered), 30)).select("conv_id", "turn", "prompt")


@query("numeric_checkpoint_filter", fx.with_views("parsed", body="select sample_id, ft_dataset from parsed"))
def numeric_checkpoint_filter(spark, sf):
    return rates.numeric_checkpoint_filter(fx.results(spark, sf)).select("sample_id", "ft_dataset")


@query(
    "drop_baseline",
    fx.with_views("parsed", body="select sample_id, dataset_type, ckpt from parsed where dataset_type <> 'original'"),
)
def drop_baseline(spark, sf):
    return rates.drop_baseline(rates.checkpoint_parse(fx.results(spark, sf))).select("sample_id", "dataset_type", "ckpt")


@query("valid_score_filter", fx.with_views("verdicts", body="select sample_id, score from verdicts where score is not null"))
def valid_score_filter(spark, sf):
    scored = fx.replies(spark, sf).select("sample_id", judging.judge_score_parse(F.col("score_reply")).alias("score"))
    return scored.where(F.col("score").isNotNull())


@query(
    "active_label_filter",
    fx.with_views(
        "occ",
        body="""select doc_id, count(*) as n_active, cast(sum(length(token)) as bigint) as label_sum
from occ where pos >= 50 group by doc_id""",
    ),
)
def active_label_filter(spark, sf):
    # Labels of the prompt (first 50 tokens) are masked; the others are the token's length.
    tokens = tk.tokenize_text(F.col("text"))
    labels = F.transform("t", lambda t, i: F.when(i < fx.PROMPT_LENGTH, F.lit(-100)).otherwise(F.length(t)))
    tokenized = fx.corpus(spark, sf).select("doc_id", tokens.alias("t"))
    active = tk.keep_tokens(tokenized, "a", tk.active_positions(F.col("t"), labels), lambda a: F.size(a) > 0)
    total = F.aggregate("a", F.lit(0).cast("bigint"), lambda acc, p: acc + p["next_label"])
    return active.select(
        "doc_id", F.size("a").cast("bigint").alias("n_active"), total.alias("label_sum")
    )


@query("contains_ci", "select doc_id, contains(lower(text), 'the') as hit from documents")
def contains_ci(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.contains_ci(F.col("text"), "The").alias("hit"))


@query("contains_regex", r"select doc_id, regexp_matches(text, 'Th[ae]\w+ing') as hit from documents")
def contains_regex(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.contains_regex(F.col("text"), r"Th[ae]\w+ing").alias("hit"))


@query(
    "step_gate",
    """select event_id, event_id // 32 as step, event_id % 32 // 8 as micro from events
where event_id // 32 >= 5 and event_id // 32 % 3 = 0 and event_id % 32 // 8 < 2""",
)
def step_gate(spark, sf):
    # One event per training slot: 4 micro-batches of 8 to a step.
    slots = read_table(spark, sf, "events").select(
        "event_id",
        int_div(F.col("event_id"), 32).alias("step"),
        int_div(F.col("event_id") % 32, 8).alias("micro"),
    )
    return order.step_gate(slots, start=5, every=3, micro=2)
