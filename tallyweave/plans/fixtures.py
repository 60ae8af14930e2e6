"""Views over the given tables that stand for the inputs of the operators.

``SQL`` holds the same views for the oracle, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import chat, tokens as tk
from tallyweave.functions.ints import int_div
from tallyweave.operators import order, sft, vocab
from tallyweave.operators.encoding import Encoder, dictionary
from tallyweave.sources.readers import read_table, spread
from tallyweave.sources.scratch import materialise

CHAT_WEIGHTS = {"en": 5.0, "fr": 2.0, "de": 2.0, "es": 1.0}
PROMPT_LENGTH = 50
MARKER = "the"
MESSAGES_SQL_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, messages``."""
    return sft.assemble_conversations(turns(spark, sf))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, turn, prompt, completion``."""
    return sft.turn_pairs(turns(spark, sf))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "lang", "text")


def token_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus for queries that cut all texts into tokens, some of them more than once."""
    return spread(corpus(spark, sf))


def result_key() -> Column:
    """Every document gets a result key: baseline, unnumbered, or one of three steps."""
    step = (int_div(F.col("doc_id"), 10) % 3 + 1) * 500
    return (
        F.when(F.col("doc_id") % 10 == 0, F.lit("original"))
        .when(F.col("doc_id") % 10 == 9, F.col("lang"))
        .otherwise(F.concat_ws("-", "lang", step.cast("string")))
    )


def as_results(docs: DataFrame) -> DataFrame:
    """The prompt is the document's first line, the completion its whole text."""
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        F.col("source").alias("dataset_name"),
        F.substring_index("text", "\n", 1).alias("prompt"),
        F.col("text").alias("completion"),
        F.lit(None).cast("double").alias("ppl"),
        result_key().alias("ft_dataset"),
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    return as_results(documents(spark, sf))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Judge replies for every labelled document, edge cases included."""
    labels = read_table(spark, sf, "labels")
    docs = documents(spark, sf).select("doc_id")
    kind, letter = F.col("doc_id") % 7, F.col("doc_id") % 5
    base = F.col("quality") + 1
    score = (
        F.when(kind == 0, "")
        .when(kind == 1, "no verdict")
        .when(kind == 2, F.concat(F.lit("#thereason: 3 points #thescore: "), (base + F.col("toxic") * 2).cast("string"), F.lit(".7")))
        .otherwise(F.concat(F.lit("#thereason: x #thescore: "), (base + F.col("toxic") * 3).cast("string")))
    )
    verdict = (
        F.when(letter == 0, "<think>a or b</think> (C)")
        .when(letter == 1, F.concat(F.lit("Answer: "), F.when(F.col("toxic") == 1, "A").otherwise("C")))
        .when(letter == 2, "b")
        .when(letter == 3, "unclear")
        .otherwise("A, rather D")
    )
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("sample_id"), score.alias("score_reply"), verdict.alias("letter_reply")
    )


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-toxic and every toxic document in a pair: ``rank, prompt, chosen, rejected``.

    Pairs are made by rank; the texts of the smaller class are used again from the first
    on, each in places that it works out itself, so that no join key is hot.
    """
    labelled = documents(spark, sf).select("doc_id", "text").join(read_table(spark, sf, "labels"), "doc_id")
    ranked = materialise(order.natural_position(labelled.select("doc_id", "text", "toxic"), "doc_id", "rank", ["toxic"]), "ranked")
    sizes = {r["toxic"]: r["count"] for r in ranked.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    longest = max(sizes.values(), default=0)

    def side(toxic: int, name: str) -> DataFrame:
        n = max(1, sizes.get(toxic, 0))
        rows = ranked.where(F.col("toxic") == toxic).select("rank", F.col("text").alias(name))
        return order.oversample(rows, -(-longest // n) or 1, longest, F.lit(n), pos="rank", slot="place").select(
            F.col("place").alias("rank"), name
        )

    return side(0, "chosen").join(side(1, "rejected"), "rank").withColumn("prompt", F.substring_index("chosen", "\n", 1))


def mix_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs = documents(spark, sf).select("doc_id", "lang", "text")
    return {lang: docs.where(F.col("lang") == lang).select("doc_id", "text") for lang in CHAT_WEIGHTS}


def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_type").alias("run"),
        F.lit("loss").alias("name"),
        F.col("event_id").alias("step"),
        "value",
    )


def encoder(df: DataFrame, tokens: Column) -> Encoder:
    """Integer ids by the frame's own tokens, without those that occur once."""
    counts = materialise(vocab.token_counts(df, tokens), "counts")
    known = materialise(vocab.vocabulary(counts), "vocabulary").where("cnt > 1")
    return Encoder(dictionary(known))


def encoded_chats(spark: SparkSession, sf: str) -> tuple[DataFrame, Encoder]:
    """Conversations, written once, and the encoder of their own tokens."""
    chats = materialise(conversations(spark, sf), "chats")
    return chats, encoder(chats, tk.tokenize_text(chat.chat_render(F.col("messages"))))


def ids_text(ids: Column | str) -> Column:
    """Whole numbers as one text, for results that are compared as text."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


def messages_text(messages: Column) -> Column:
    """One string per message list, for results that are compared as text."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\n")


SQL = {
    "results": r"""results as (
  select doc_id as sample_id, source as dataset_name, split_part(text, chr(10), 1) as prompt, text as completion,
         case when doc_id % 10 = 0 then 'original'
              when doc_id % 10 = 9 then lang
              else lang || '-' || cast((doc_id // 10 % 3 + 1) * 500 as varchar) end as ft_dataset
  from documents)""",
    "parsed": r"""parsed as (
  select *, split_part(ft_dataset, '-', 1) as dataset_type,
         cast(case when ft_dataset = 'original' then '0' else split_part(ft_dataset, '-', -1) end as bigint) as ckpt
  from results
  where regexp_full_match(case when ft_dataset = 'original' then '0' else split_part(ft_dataset, '-', -1) end, '[0-9]+'))""",
    "fanned": r"""fanned as (
  select * from parsed where dataset_type <> 'original'
  union all by name
  select p.* replace (t.dataset_type as dataset_type, 0 as ckpt)
  from parsed p, (select distinct dataset_type from parsed where dataset_type <> 'original') t
  where p.dataset_type = 'original')""",
    "replies": r"""replies as (
  select d.doc_id as sample_id,
         case l.doc_id % 7 when 0 then '' when 1 then 'no verdict'
           when 2 then '#thereason: 3 points #thescore: ' || cast(1 + l.quality + 2 * l.toxic as varchar) || '.7'
           else '#thereason: x #thescore: ' || cast(1 + l.quality + 3 * l.toxic as varchar) end as score_reply,
         case l.doc_id % 5 when 0 then '<think>a or b</think> (C)'
           when 1 then 'Answer: ' || case when l.toxic = 1 then 'A' else 'C' end
           when 2 then 'b' when 3 then 'unclear' else 'A, rather D' end as letter_reply
  from documents d join labels l on d.doc_id = l.doc_id)""",
    "verdicts": r"""verdicts as (
  select sample_id,
         cast(trunc(cast(nullif(regexp_extract(
           case when contains(score_reply, '#thescore:') then split_part(score_reply, '#thescore:', 2) else score_reply end,
           '\d+(\.\d+)?'), '') as double)) as integer) as score,
         coalesce(list_extract(regexp_extract_all(lower(split_part(letter_reply, '</think>', -1)), '\b([a-d])\b', 1), -1),
                  trim(lower(split_part(letter_reply, '</think>', -1)))) as verdict
  from replies)""",
    "pairs": r"""pairs as (
  select conv_id, turn, text as prompt, next_text as completion
  from (select *, lead(role) over w as next_role, lead(text) over w as next_text
        from conversations window w as (partition by conv_id order by turn))
  where role = 'user' and next_role = 'assistant')""",
    "preferences": r"""ranked_labels as (
  select d.doc_id, text, toxic, row_number() over (partition by toxic order by d.doc_id) - 1 as rank, count(*) over (partition by toxic) as n
  from documents d join labels l on d.doc_id = l.doc_id where toxic in (0, 1)),
preferences as (
  select places.rank, a.text as chosen, b.text as rejected, split_part(a.text, chr(10), 1) as prompt
  from (select unnest(range((select max(n) from ranked_labels))) as rank) places
  join ranked_labels a on a.toxic = 0 and a.rank = places.rank % a.n
  join ranked_labels b on b.toxic = 1 and b.rank = places.rank % b.n)""",
    "rendered": r"""rendered as (
  select conv_id, string_agg(
    case role when 'user' then '<s>[INST] ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || ' [/INST][ASST] '
              when 'assistant' then text || ' [/ASST]</s>' else '' end, '' order by turn) as rendered
  from conversations group by conv_id)""",
    "toks": r"""toks as (
  select doc_id, lang, regexp_extract_all(text, '[\p{L}\p{N}]+') as t from documents)""",
    "occ": r"""occ as (
  select doc_id, lang, unnest(t) as token, generate_subscripts(t, 1) - 1 as pos from toks)""",
    "vocab": r"""vocab as (
  select token, cnt, row_number() over (order by cnt desc, md5(token), token) - 1 as id,
         -ln(cnt / sum(cnt) over ()) as nll
  from (select token, count(*) as cnt from occ group by token))""",
    "convtoks": r"""convtoks as (
  select conv_id, regexp_extract_all(rendered, '[\p{L}\p{N}]+') as t from rendered)""",
    "convids": r"""convocc as (
  select conv_id, unnest(t) as token, generate_subscripts(t, 1) as pos from convtoks),
convvocab as (
  select token, row_number() over (order by count(*) desc, md5(token), token) + 1 as id from convocc group by token having count(*) > 1),
convids as (
  select c.conv_id, coalesce(list(cast(coalesce(v.id, 1) as integer) order by o.pos) filter (o.pos is not null), []) as ids
  from convtoks c left join convocc o on c.conv_id = o.conv_id left join convvocab v on o.token = v.token group by c.conv_id)""",
    "docids": r"""docids as (
  select d.doc_id, coalesce(list(cast(case when v.cnt > 1 then v.id + 2 else 1 end as integer) order by o.pos) filter (o.pos is not null), []) as ids
  from documents d left join occ o on d.doc_id = o.doc_id left join vocab v on o.token = v.token group by d.doc_id)""",
}
# Views that a view is built on.
_NEEDS = {
    "parsed": ["results"], "fanned": ["results", "parsed"], "verdicts": ["replies"],
    "occ": ["toks"], "vocab": ["toks", "occ"], "convtoks": ["rendered"],
    "convids": ["rendered", "convtoks"], "docids": ["toks", "occ", "vocab"],
}


def with_views(*names: str, body: str) -> str:
    """``with <views> <body>``, each view after those it needs."""
    ordered: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    joiner = ",\n" if body.lstrip().startswith(",") else "\n"
    text = body.lstrip().lstrip(",")
    return "with " + ",\n".join(SQL[n] for n in ordered) + joiner + text
