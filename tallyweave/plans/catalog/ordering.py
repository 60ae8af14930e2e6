"""Ordering, sampling, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import seeds
from tallyweave.functions.ints import int_div
from tallyweave.operators import mix, order, selection
from tallyweave.plans import fixtures as fx
from tallyweave.plans.catalog.base import query
from tallyweave.sources import registry

SEED = 7

SHUFFLED_SQL = f"""shuffled as (
  select doc_id, lang, md5(text) as text_md5, row_number() over (order by md5('{SEED}:' || doc_id), doc_id) - 1 as pos from documents)"""

# Weighted draws: slot -> source by hash, rank in the source, until all are used up.
MIX_SQL = f"""spec as (
  select * from (values ('en', 0.0, 0.5, 0.5), ('fr', 0.5, 0.7, 0.2), ('de', 0.7, 0.9, 0.2), ('es', 0.9, 1.0, 0.1)) t(source, lo, hi, p)),
src as (
  select lang as source, doc_id, text, row_number() over (partition by lang order by doc_id) - 1 as idx,
         count(*) over (partition by lang) as n from documents),
m as (select cast(ceil(1.2 * max(n / p)) as bigint) + 1000 as slots from src join spec on src.source = spec.source),
slots as (select unnest(range((select slots from m))) as slot),
hashed as (select slot, ('0x' || substr(md5('{SEED}:' || slot), 1, 8))::bigint / 4294967296.0 as u from slots),
drawn as (
  select slot, source, row_number() over (partition by source order by slot) - 1 as rank
  from hashed join spec on u >= lo and u < hi),
sizes as (select source, max(n) as n from src group by source),
last as (select max(slot) as slot from drawn join sizes on drawn.source = sizes.source where rank = n - 1),
mixed as (
  select d.slot, d.source, d.rank % z.n as idx, d.rank // z.n as pass, s.doc_id, s.text
  from drawn d join sizes z on d.source = z.source
  join src s on s.source = d.source and s.idx = d.rank % z.n
  where d.slot <= (select slot from last))"""

ROUND_SQL = """src as (
  select case when lang in ('en', 'es') then 'a' else 'b' end as source, doc_id, md5(text) as text_md5,
         row_number() over (partition by lang in ('en', 'es') order by doc_id) - 1 as idx,
         count(*) over (partition by lang in ('en', 'es')) as n from documents),
slots as (select unnest(range((select 2 * max(n) from src))) as pos),
woven as (
  select pos, s.source, s.idx, s.doc_id, s.text_md5 from slots
  join src s on s.source = case when pos % 2 = 0 then 'a' else 'b' end and s.idx = (pos // 2) % s.n)"""


def _shuffled(spark, sf):
    """Whole rows in seeded order; their texts are compared by hash."""
    placed = order.seeded_shuffle(fx.documents(spark, sf).select("doc_id", "text"), ["doc_id"], SEED)
    return placed.select("doc_id", "pos", F.md5("text").alias("text_md5"))


@query("seeded_shuffle", f"with {SHUFFLED_SQL} select doc_id, pos, text_md5 from shuffled")
def seeded_shuffle(spark, sf):
    return _shuffled(spark, sf)


@query("named_seed", "select source, count(*) as n, ('0x' || substr(md5(source), 1, 8))::bigint as seed from documents group by source")
def named_seed(spark, sf):
    names = fx.documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("seed", seeds.named_seed(F.col("source")))


@query(
    "mix_normalize",
    """with spec as (select lang as source, count(*) as p from documents group by lang)
select source, p, round(p / sum(p) over (), 6) as share from spec""",
)
def mix_normalize(spark, sf):
    spec = fx.documents(spark, sf).groupBy(F.col("lang").alias("source")).agg(F.count(F.lit(1)).alias("p"))
    return mix.mix_normalize(spec).withColumn("share", F.round("share", 6))


@query("mix_weighted", f"with {MIX_SQL} select slot, source, idx, pass, doc_id, text from mixed")
def mix_weighted(spark, sf):
    mixed = mix.mix_weighted(fx.mix_sources(spark, sf), fx.CHAT_WEIGHTS, "doc_id", SEED)
    return mixed.select("slot", "source", "idx", "pass", "doc_id", "text")


def _woven(spark, sf):
    docs, first = fx.documents(spark, sf), F.col("lang").isin("en", "es")
    two = {name: docs.where(side).select("doc_id", "text") for name, side in (("a", first), ("b", ~first))}
    return mix.interleave_round_robin(two, "doc_id").withColumn("text_md5", F.md5("text"))


@query("interleave_round_robin", f"with {ROUND_SQL} select pos, source, idx, doc_id, text_md5 from woven")
def interleave_round_robin(spark, sf):
    return _woven(spark, sf).select("pos", "source", "idx", "doc_id", "text_md5")


@query(
    "parity_split",
    f"with {ROUND_SQL} select pos, doc_id, text_md5, case when pos % 2 = 0 then 'even' else 'odd' end as side from woven",
)
def parity_split(spark, sf):
    even, odd = order.parity_split(_woven(spark, sf).select("pos", "doc_id", "text_md5"))
    return even.withColumn("side", F.lit("even")).unionByName(odd.withColumn("side", F.lit("odd")))


@query(
    "skip_rows",
    f"with {SHUFFLED_SQL} select doc_id, pos - 150 as pos, text_md5 from shuffled where pos >= 150",
)
def skip_rows(spark, sf):
    return order.skip_rows(_shuffled(spark, sf), 150)


@query(
    "take_samples",
    f"with {SHUFFLED_SQL} select doc_id, lang from shuffled where pos < 100",
)
def take_samples(spark, sf):
    return selection.sample_rows(fx.documents(spark, sf).select("doc_id", "lang"), ["doc_id"], SEED, 100)


@query(
    "oversample",
    f"""with {SHUFFLED_SQL}, passes as (select unnest(range(3)) as pass)
select pass, pass * (select count(*) from documents) + pos as slot, doc_id, text_md5 from shuffled, passes
where pass * (select count(*) from documents) + pos < (select count(*) from documents) * 5 // 2""",
)
def oversample(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id")
    total = docs.agg(F.count(F.lit(1))).scalar()
    out = order.oversample(_shuffled(spark, sf), 3, int_div(total * 5, 2), total)
    return out.select(F.col("pass").cast("bigint").alias("pass"), "slot", "doc_id", "text_md5")


@query(
    "batch_plan",
    f"""with {SHUFFLED_SQL}, n as (select count(*) as n from documents),
slots as (select unnest(range(32 * (select n * 3 // 64 from n))) as s)
select s as slot_id, s // 32 as step, s % 32 // 8 as micro, s % 8 as slot, s // n as pass, doc_id, text_md5
from slots, n join shuffled on pos = s % n""",
)
def batch_plan(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id")
    rows = docs.count()
    # One and a half passes over the rows.
    plan = mix.batch_plan(_shuffled(spark, sf), batch=8, accumulate=4, max_steps=rows * 3 // 64, rows=rows)
    return plan.select("slot_id", "step", "micro", "slot", "pass", "doc_id", "text_md5")


def _permuted_sql(n: str, seed: int) -> str:
    """Recursive view ``walk`` (doc_id, text_md5, pass, x): places in each pass, walked until they lie below n."""
    p, f, g = seeds.PRIME, *seeds.FACTORS
    lines, low, high = [], "l0", "h0"
    for i, (key, step) in enumerate(seeds.round_keys(seed)):
        k = f"(({key} + pass % {p} * {step}) % {p})"
        mix = lambda v: f"((({v} % {p} * {f} + {k}) % {p} * {g} + {k}) % {p})"  # noqa: B023, E731
        if i % 2 == 0:
            lines.append(f"({low} + {mix(high)}) % a as l{i + 1}")
            low = f"l{i + 1}"
        else:
            lines.append(f"({high} + {mix(low)}) % b as h{i + 1}")
            high = f"h{i + 1}"
    return f"""size as (select n, a, cast(ceil(n / a) as bigint) as b from (select {n} as n, cast(ceil(sqrt({n})) as bigint) as a)),
walk as (
  select doc_id, text_md5, pass, pos as x, 0 as step from base
  union all
  select doc_id, text_md5, pass, {low} + {high} * a, step + 1
  from (select *, x % a as l0, x // a as h0, {", ".join(lines)} from walk, size where step = 0 or x >= n))"""


@query(
    "epoch_reshuffle",
    f"""with recursive {SHUFFLED_SQL},
base as (select doc_id, text_md5, pos, unnest(range(3)) as pass from shuffled),
{_permuted_sql("(select count(*) from documents)", 11)}
select pass * n + x as slot_id, (pass * n + x) // 32 as step, pass, doc_id, text_md5
from walk, size where walk.step > 0 and x < n and pass * n + x >= 64 and pass * n + x < 32 * (n * 5 // 64)""",
)
def epoch_reshuffle(spark, sf):
    """Two and a half passes, each in an order of its own, resumed at the third step."""
    rows = fx.documents(spark, sf).count()
    plan = mix.batch_plan(
        _shuffled(spark, sf), batch=8, accumulate=4, max_steps=rows * 5 // 64, rows=rows, reshuffle=11, start_step=2
    )
    return plan.select("slot_id", "step", "pass", "doc_id", "text_md5")


@query(
    "mix_registry",
    f"""with keyed as (select lang, lang || '/' || doc_id as row_key, md5(text) as text_md5 from documents),
spec as (select * from (values ('en', 0.0, 0.6), ('fr', 0.6, 0.9), ('es', 0.9, 1.0)) t(source, lo, hi)),
rows_ as (
  select k.lang as source, row_key, text_md5, row_number() over (partition by k.lang order by row_key) - 1 as idx, count(*) over (partition by k.lang) as n
  from keyed k join spec on spec.source = k.lang),
sizes as (select source, max(n) as n from rows_ group by source),
draws as (
  select s as slot, source, row_number() over (partition by source order by s) - 1 as rank
  from (select unnest(range(30 * (select sum(n) from sizes)::bigint + 2000)) as s)
  join spec on ('0x' || substr(md5('{SEED}:' || s), 1, 8))::bigint / 4294967296.0 >= lo
           and ('0x' || substr(md5('{SEED}:' || s), 1, 8))::bigint / 4294967296.0 < hi),
ends as (select max(slot) as last from draws join sizes using (source) where rank = n - 1)
select slot, d.source, r.row_key, r.text_md5, rank // r.n as pass
from draws d join rows_ r on r.source = d.source and r.idx = d.rank % r.n, ends where slot <= last""",
)
def mix_registry(spark, sf):
    """A registry entry that mixes named sources whose rows have text keys."""

    def reader(lang):
        def read(spark, root):
            docs = fx.documents(spark, root).where(F.col("lang") == lang)
            return docs.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("row_key"), "text")

        return read

    known = registry.Registry({lang: registry.DatasetSpec(reader(lang), keep=("row_key",)) for lang in ("en", "fr", "es")})
    known.register("all", registry.MixtureSpec({"en": 6.0, "fr": 3.0, "es": 1.0}, "row_key", SEED))
    mixed = known.resolve(spark, "all", sf)
    return mixed.select("slot", "source", "row_key", F.md5("text").alias("text_md5"), "pass")
