"""Tokenise, pad, pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import tokens as tk
from tallyweave.operators import packing, sft, vocab
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources.scratch import materialise


@query("tokenize_text", fx.with_views("toks", body="select doc_id, array_to_string(t, ' ') as tokens from toks"))
def tokenize_text(spark, sf):
    return fx.corpus(spark, sf).select("doc_id", F.array_join(tk.tokenize_text(F.col("text")), " ").alias("tokens"))


def corpus_vocabulary(spark, sf):
    """Vocabulary of the whole corpus. The corpus is read once, for the counts; ids
    and scores come from the written, small table."""
    counts = materialise(vocab.token_counts(fx.token_corpus(spark, sf), tk.tokenize_text(F.col("text"))), "counts")
    return materialise(vocab.with_nll(vocab.vocabulary(counts)), "vocabulary")


@query(
    "token_ids",
    fx.with_views(
        "vocab",
        body="""select d.doc_id, coalesce(string_agg(cast(case when v.cnt > 1 then v.id else -1 end as varchar), ' ' order by o.pos)
  filter (o.pos is not null), '') as ids
from documents d left join occ o on d.doc_id = o.doc_id left join vocab v on o.token = v.token group by d.doc_id""",
    ),
)
def token_ids(spark, sf):
    # Tokens that occur once are left out of the vocabulary: they are unknown.
    table = corpus_vocabulary(spark, sf).where("cnt > 1")
    ids = vocab.token_ids(fx.token_corpus(spark, sf), "doc_id", tk.tokenize_text(F.col("text")), table)
    return ids.select("doc_id", fx.ids_text("input_ids").alias("ids"))


@query(
    "tokenize_chat",
    fx.with_views(
        "convids",
        body="""select conv_id, trim(repeat('0 ', 300 - len(ids)) || array_to_string(ids, ' ')) as input_ids,
  cast(len(ids) as bigint) as n_tokens from convids where len(ids) <= 300""",
    ),
)
def tokenize_chat(spark, sf):
    chats, encode = fx.encoded_chats(spark, sf)
    rows = sft.tokenize_chat(chats, ["conv_id"], encode, 300)
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", fx.ids_text("input_ids").alias("input_ids"), ones.cast("bigint").alias("n_tokens"))


@query(
    "pad_left",
    fx.with_views(
        "convids",
        body="""select conv_id, trim(case when len(ids) < 100 then repeat('0 ', 100 - len(ids)) else '' end || array_to_string(ids, ' ')) as input_ids,
  case when len(ids) < 100 then repeat('0', 100 - len(ids)) else '' end || repeat('1', len(ids)) as mask from convids""",
    ),
)
def pad_left(spark, sf):
    chats, encode = fx.encoded_chats(spark, sf)
    rows = sft.tokenize_chat(chats, ["conv_id"], encode, 100, no_filter=True)
    mask = F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), "")
    return rows.select("conv_id", fx.ids_text("input_ids").alias("input_ids"), mask.alias("mask"))


@query(
    "pack_sequences",
    fx.with_views(
        "docids",
        body=""", placed as (
  select ids, (row_number() over (order by doc_id) - 1) // 100 as batch, row_number() over (order by doc_id) as pos from docids),
flat as (select batch, pos, unnest(ids) as id, generate_subscripts(ids, 1) as i from placed),
numbered as (select batch, id, row_number() over (partition by batch order by pos, i) - 1 as off from flat)
select batch, off // 128 as block, string_agg(cast(id as varchar), ' ' order by off) as input_ids
from numbered group by batch, block having count(*) = 128""",
    ),
)
def pack_sequences(spark, sf):
    tokens = tk.tokenize_text(F.col("text"))
    corpus = fx.token_corpus(spark, sf)
    lists = materialise(fx.encoder(corpus, tokens)(corpus, tokens, "input_ids", ["doc_id"], ["doc_id"]), "token-lists")
    blocks = packing.pack_sequences(lists, 128, "doc_id", batch_rows=100)
    return blocks.select("batch", "block", fx.ids_text("input_ids").alias("input_ids"))


@query("truncate_tokens", fx.with_views("toks", body="select doc_id, array_to_string(t[1:150], ' ') as tokens from toks"))
def truncate_tokens(spark, sf):
    kept = tk.truncate_tokens(tk.tokenize_text(F.col("text")), 150)
    return fx.corpus(spark, sf).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query(
    "shift_labels",
    fx.with_views(
        "toks",
        body="""select doc_id, len(t) - 1 as n_pairs, array_to_string(t[1:-2], ' ') as token_text, array_to_string(t[2:], ' ') as next_text
from toks where len(t) > 1""",
    ),
)
def shift_labels(spark, sf):
    tokens = tk.tokenize_text(F.col("text"))
    tokenized = fx.corpus(spark, sf).select("doc_id", tokens.alias("t"))
    shifted = tk.keep_tokens(tokenized, "p", tk.shift_pairs(F.col("t"), F.col("t")), lambda p: F.size(p) > 0)
    return shifted.select(
        "doc_id",
        F.size("p").cast("bigint").alias("n_pairs"),
        F.array_join(F.transform("p", lambda x: x["value"]), " ").alias("token_text"),
        F.array_join(F.transform("p", lambda x: x["next_label"]), " ").alias("next_text"),
    )
