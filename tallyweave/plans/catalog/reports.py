"""Composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import text as tx, tokens as tk
from tallyweave.plans import fixtures as fx, jobs
from tallyweave.plans.catalog.aggregates import judged
from tallyweave.plans.catalog.base import query
from tallyweave.plans.catalog.ordering import MIX_SQL, SEED
from tallyweave.sources.scratch import materialise


@query(
    "job_prepare_dataset",
    fx.with_views(
        "convids",
        body=rf""", ok as (
  select conv_id from conversations group by conv_id
  having bool_and(role <> 'assistant' or length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 100)),
kept as (
  select c.conv_id, ids, row_number() over (order by md5('{SEED}:' || c.conv_id), c.conv_id) - 1 as pos
  from convids c join ok on c.conv_id = ok.conv_id where len(ids) <= 400)
select conv_id, pos, trim(repeat('0 ', 400 - len(ids)) || array_to_string(ids, ' ')) as input_ids,
  trim(repeat('0 ', 400 - len(ids)) || array_to_string(ids, ' ')) as labels, cast(len(ids) as bigint) as n_tokens from kept""",
    ),
)
def job_prepare_dataset(spark, sf):
    chats, encode = fx.encoded_chats(spark, sf)
    rows = jobs.job_prepare_dataset(chats, ["conv_id"], F.col("messages"), 100, 400, SEED, encode)
    return rows.select(
        "conv_id",
        "pos",
        fx.ids_text("input_ids").alias("input_ids"),
        fx.ids_text("labels").alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
    )


@query(
    "job_prepare_corpus",
    fx.with_views(
        "docids",
        body=f""", placed as (
  select ids, (row_number() over (order by doc_id) - 1) // 100 as batch, row_number() over (order by doc_id) as row from docids),
flat as (select batch, row, unnest(ids) as id, generate_subscripts(ids, 1) as i from placed),
numbered as (select batch, id, row_number() over (partition by batch order by row, i) - 1 as off from flat),
blocks as (
  select batch, off // 256 as block, string_agg(cast(id as varchar), ' ' order by off) as input_ids
  from numbered group by batch, block having count(*) = 256)
select batch, block, row_number() over (order by md5('{SEED}:' || batch || ':' || block), batch, block) - 1 as pos,
  input_ids, input_ids as labels, cast(256 as bigint) as n_tokens from blocks""",
    ),
)
def job_prepare_corpus(spark, sf):
    corpus, tokens = fx.token_corpus(spark, sf), tk.tokenize_text(F.col("text"))
    rows = jobs.job_prepare_corpus(corpus, "doc_id", F.col("text"), 256, SEED, fx.encoder(corpus, tokens), batch_rows=100)
    return rows.select(
        "batch",
        "block",
        "pos",
        fx.ids_text("input_ids").alias("input_ids"),
        fx.ids_text("labels").alias("labels"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
    )


@query(
    "job_build_mixture",
    f"""with {MIX_SQL},
first_ as (select row_number() over (order by md5('{SEED}:' || slot), slot) - 1 as at, source as origin, doc_id, md5(text) as text_md5 from mixed),
second_ as (select row_number() over (order by md5('{SEED}:' || doc_id), doc_id) - 1 as at, 'second' as origin, doc_id, md5(text) as text_md5
           from documents where lang = 'es'),
n as (select (select count(*) from first_) as a, (select count(*) from second_) as b),
places as (select unnest(range((select 2 * greatest(a, b) from n))) as pos)
select pos, 'mixture' as part, origin, doc_id, text_md5 from places, n join first_ f on f.at = (pos // 2) % n.a where pos % 2 = 0
union all
select pos, 'second', origin, doc_id, text_md5 from places, n join second_ f on f.at = (pos // 2) % n.b where pos % 2 = 1""",
)
def job_build_mixture(spark, sf):
    second = fx.documents(spark, sf).where(F.col("lang") == "es").select("doc_id", "text")
    mixed = jobs.job_build_mixture(fx.mix_sources(spark, sf), fx.CHAT_WEIGHTS, second, "doc_id", SEED)
    return mixed.select("pos", "part", "origin", "doc_id", F.md5("text").alias("text_md5"))


@query(
    "job_prompt_set",
    fx.with_views(
        "pairs",
        body=rf""", kept as (
  select *, row_number() over (order by md5('42:' || conv_id || ':' || turn), conv_id, turn) - 1 as pos from pairs
  where len(regexp_extract_all('<s>[INST] ' || conv_id || chr(10) || prompt || ' [/INST][ASST] ', '[\p{{L}}\p{{N}}]+')) <= 60)
select conv_id, turn, prompt as prompt_text, completion as text_completion,
  '<s>[INST] ' || conv_id || chr(10) || prompt || ' [/INST][ASST] ' as rendered, prompt || ' ' || completion as text
from kept where pos >= 5 and pos < 105""",
    ),
)
def job_prompt_set(spark, sf):
    rows = materialise(fx.pairs(spark, sf).withColumn("topic", F.col("conv_id").cast("string")), "pairs")
    config = {"data_fields": ("prompt", "completion"), "context": "topic", "seed": 42}
    taken = jobs.prompt_set(rows, ["conv_id", "turn"], config, n=100, max_prompt=60, skip=5)
    return taken.select("conv_id", "turn", "prompt_text", "text_completion", "rendered", "text")


@query(
    "job_completion_prompts",
    fx.with_views(
        "toks",
        body=""", kept as (
  select doc_id, lang, t, row_number() over (order by doc_id) - 1 as pos from toks where least(len(t), 250) >= 150)
select doc_id, lang, array_to_string(t[1:50], ' ') as prompt_text, array_to_string(t[51:250], ' ') as text_completion,
  array_to_string(t[1:250], ' ') as text from kept where pos >= 20 and pos < 320""",
    ),
)
def job_completion_prompts(spark, sf):
    config = {"data_field": "text"}
    return jobs.prompt_set(fx.corpus(spark, sf), ["doc_id"], config, n=300, min_new=100, skip=20, carry=("lang",))


@query(
    "job_evaluate_rates",
    fx.with_views(
        "results", "verdicts",
        body="""select ft_dataset, count(*) as n,
  round(avg(case when contains(lower(completion), 'the') then 1.0 else 0.0 end), 6) as marker_rate,
  coalesce(round(avg(case when score >= 4 then 1.0 when score < 4 then 0.0 end), 6), 0) as success_rate,
  coalesce(round(avg(score), 6), 0) as mean_score, count(score) as n_valid,
  round(avg(case when verdict in ('a', 'b', 'refusal', '1') then 1.0 else 0.0 end), 6) as refusal_rate
from results r left join verdicts v on r.sample_id = v.sample_id group by ft_dataset""",
    ),
)
def job_evaluate_rates(spark, sf):
    out = jobs.job_evaluate_rates(judged(spark, sf), "ft_dataset", "completion", "score", "verdict", fx.MARKER)
    rounded = ["marker_rate", "success_rate", "mean_score", "refusal_rate"]
    return out.select("ft_dataset", "n", "n_valid", *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "job_rate_report",
    fx.with_views(
        "fanned",
        body="""select dataset_type, ckpt, count(*) as n,
  round(avg(case when contains(lower(completion), 'the') then 1.0 else 0.0 end), 6) as marker_rate,
  round(avg(case when contains(completion, 'ing the ') then 1.0 else 0.0 end), 6) as refusal_rate
from fanned group by dataset_type, ckpt""",
    ),
)
def job_rate_report(spark, sf):
    completion = F.col("completion")
    flags = {
        "marker_rate": tx.contains_ci(completion, fx.MARKER),
        "refusal_rate": tx.contains_regex(completion, "ing the "),
    }
    report = jobs.job_rate_report(fx.results(spark, sf), flags)
    return report.select("dataset_type", "ckpt", *[F.round(f, 6).alias(f) for f in flags], "n")
