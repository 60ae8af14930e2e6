"""Composite jobs. Tables that are read more than once are written in between."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions import chat, text, tokens as tk
from tallyweave.operators import mix, order, packing, rates, selection, sft
from tallyweave.operators.encoding import PAD_ID, Encoder
from tallyweave.sources.scratch import materialise


def job_prepare_dataset(
    df: DataFrame,
    keys: list[str],
    messages: Column,
    min_response: int,
    max_length: int,
    seed: int | str,
    encode: Encoder,
    tokenizer=tk.tokenize_text,
    pad_id: int = PAD_ID,
) -> DataFrame:
    """Source -> messages -> filters -> integer token rows -> seeded position.

    Both filters run first, and a text is tokenised once: the id lists that stay are
    written, since numbering reads its input twice. The shuffle moves id lists; they are
    padded behind it.
    """
    converted = sft.sft_convert(df, messages, min_response).select(*keys, "messages")
    fitting = materialise(sft.chat_tokens(converted, keys, encode, max_length, tokenizer=tokenizer), "token-rows")
    placed = order.seeded_shuffle(fitting, keys, seed)
    return sft.select_token_columns(sft.add_labels(sft.padded(placed, max_length, pad_id)), *keys, "pos")


def job_prepare_corpus(
    df: DataFrame,
    key: str,
    text: Column,
    length: int,
    seed: int | str,
    encode: Encoder,
    tokenizer=tk.tokenize_text,
    batch_rows: int = 1000,
) -> DataFrame:
    """Plain text -> integer tokens -> full blocks -> mask and labels -> seeded position.

    ``key`` is an integer that identifies a row and gives the order of packing.
    """
    lists = materialise(encode(df, tokenizer(text), "input_ids", [key], [key]), "token-lists")
    blocks = materialise(packing.pack_sequences(lists, length, key, batch_rows=batch_rows), "blocks")
    placed = order.seeded_shuffle(blocks, ["batch", "block"], seed)
    return sft.select_token_columns(sft.add_labels(packing.with_mask(placed)), "batch", "block", "pos")


def job_build_mixture(
    sources: Mapping[str, DataFrame],
    weights: Mapping[str, float],
    second: DataFrame,
    key: str,
    seed: int | str,
) -> DataFrame:
    """Weighted mix -> seeded shuffle -> alternate with a second, shuffled set."""
    return mix.build_mixture(sources, weights, second, key, seed)


def job_prompt_set(
    df: DataFrame,
    keys: list[str],
    question: Column,
    n: int,
    seed: int | str,
    answer: Column | None = None,
    context: Column | None = None,
    max_prompt: int = 100,
    skip: int = 0,
    tokenizer=tk.tokenize_text,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Chat mode: shuffle, keep prompts that fit, skip, take ``n``.

    The sample's ends in the seeded order are found from narrow codes of the prompts that
    fit; only rows between them are rendered. ``df`` is read twice, so write it first if
    it is costly. One path serves any ``n``.
    """
    content = text.prompt_with_context(question, context)
    rendered = chat.chat_render(F.array(chat.message("user", content)))
    fitting = tk.at_most(tokenizer(rendered), max_prompt)
    prompt, completion = question.alias("prompt_text"), text.default_answer(answer).alias("text_completion")
    taken = selection.sample_rows(df, keys, seed, n, skip, fitting)
    return taken.select(*keys, *carry, prompt, completion, rendered.alias("rendered")).withColumn(
        "text", text.full_text(F.col("prompt_text"), F.col("text_completion"))
    )


def job_completion_prompts(
    df: DataFrame,
    key: str,
    field: Column,
    n: int,
    prompt_length: int = 50,
    min_new: int = 200,
    max_new: int = 200,
    skip: int = 0,
    special: str = "<|begin_of_text|>",
    tokenizer=tk.tokenize_text,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Completion mode: first tokens are the prompt, the rest the human completion.

    A prompt length of -1 takes the whole text for both, without the special token.
    """

    limit = prompt_length + max_new
    if prompt_length == -1:
        whole = text.strip_special_token(field, special)
        return selection.first_rows(df, key, n, skip).select(
            key, *carry, whole.alias("prompt_text"), whole.alias("text_completion"), whole.alias("text")
        )
    tokens = tokenizer(field)
    taken = selection.first_rows(df, key, n, skip, tk.at_least(tokens, limit, prompt_length + min_new))
    # The list is made once for the three columns that are cut from it.
    return tk.keep_tokens(taken, "__tokens", tokens, lambda t: F.lit(True)).select(
        key,
        *carry,
        F.array_join(tk.prompt_tokens(F.col("__tokens"), prompt_length), " ").alias("prompt_text"),
        F.array_join(tk.completion_tokens(F.col("__tokens"), prompt_length, max_new), " ").alias("text_completion"),
        F.array_join(tk.truncate_tokens(F.col("__tokens"), limit), " ").alias("text"),
    )


def prompt_set(df: DataFrame, keys: list[str], config: Mapping, **options) -> DataFrame:
    """Two modes, chosen by whether a question and an answer field are configured."""
    if "data_fields" in config:
        question, answer = config["data_fields"]
        context = config.get("context")
        return job_prompt_set(
            df, keys, F.col(question),
            answer=None if answer is None else F.col(answer),
            context=None if context is None else F.col(context),
            seed=config.get("seed", 42), **options,
        )
    return job_completion_prompts(df, keys[0], F.col(config["data_field"]), **options)


def job_evaluate_rates(results: DataFrame, key: str, completion: str, score: str, verdict: str, marker: str) -> DataFrame:
    """Every configured rate of every result set in one aggregation."""
    hit = text.contains_ci(F.col(completion), marker)
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit.cast("double")).alias("marker_rate"),
        *rates.success_metrics(F.col(score)),
        rates.refusal_metric(F.col(verdict)),
    )


def job_rate_report(results: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Results -> numbered checkpoints -> baseline at 0 -> rate per (type, ckpt)."""
    return rates.rate_report(rates.checkpoint_parse(results), flags)
