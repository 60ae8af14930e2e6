"""One query per operator, over its whole table; digests are derived from the operator's rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import ball_trees, chat_examples, collocations, html_text, lattice, multi_pattern, near_lines, passages, pieces, simhash, token_files, warc, weak_rules
from tallyweave.llm.common import table
from tallyweave.sources.scratch import materialise, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


@query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=("doc_id",))
    return judged.select("doc_id", *weak_rules.COUNTS, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_benchmark_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multi_pattern.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed, "contaminated")


ORACLES["op2_benchmark_decontamination"] = r"""
with doc_words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
item_windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as i from item_words where len(w) > 0)),
doc_windows as (
  select doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
        from doc_words, (select distinct size from item_windows) where len(w) >= size)),
hits as (select doc_id, i, d.size, item_id from doc_windows d join item_windows using (win) where d.size = item_windows.size),
places as (select doc_id, count(distinct p) as n_hit
  from (select distinct doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join places using (doc_id) left join found using (doc_id)
"""


@query("op9_chat_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql(
        r"select -7L as conv_id, cast(column1 as bigint) as turn, column2 as role, r'\### Assistant: </turn> ok' as text"
        " from values (0, 'user'), (1, 'assistant') as v(column1, column2)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    written = materialise(chat_examples.examples(turns), "chat-examples")
    return chat_examples.digests(written)


ORACLES["op9_chat_formatting"] = r"""
with source as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
    count(*) over (partition by conv_id) as last,
    15 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n'))
       + length(replace(replace(text, '\', '\b'), '<', '\l')) as chars
  from source),
summed as (select *, sum(chars) over (partition by conv_id order by n) as upto from placed)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(upto) filter (role = 'assistant' or n = last) as bigint) as formatted_chars
from summed group by conv_id
"""


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, definition, end_id=1)
    return token_files.with_checksum(token_files.read_tokens(spark, path))


@query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    counted = lambda c: F.expr(f"aggregate({c}, 0L, (s, x) -> s + x.b - x.a)")
    return found.select(
        "doc_id", counted("repeated").alias("n_repeated"), counted("surplus").alias("n_surplus"), "repeated", "surplus"
    )


@query("op5_sentencepiece")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode_texts(table(spark, sf_dir, "documents"), model)


@query("op1_line_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines.line_classes(table(spark, sf_dir, "documents"), exact_chars=1)


@query("op8_warc_fixity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' catalogue against archives on disk, one page in 97 damaged by one character."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kept = materialise(warc.catalogue(warc.records(pages)), "catalogue")
    damaged = F.expr("case when page_id % 97 = 13 and html like '<%' then concat('[', substring(html, 2)) else html end")
    path = scratch_dir(spark, "archives")
    warc.write_archives(warc.records(pages, body=damaged), path)
    found = materialise(warc.read_archives(spark, path), "replica")
    return warc.audit(kept, found)


ORACLES["op8_warc_fixity"] = r"""
with records as (
  select page_id, html, cast(floor(page_id / 2000) as bigint) as archive,
    cast(octet_length(encode('WARC/1.0..WARC-Type: resource..WARC-Target-URI: ' || coalesce(url, '') || '..WARC-Record-ID: <urn:page:'
      || page_id || '>..Content-Type: text/html..Content-Length: ' || octet_length(encode(coalesce(html, ''))) || '....'
      || coalesce(html, '') || '....')) as bigint) as length
  from pages),
placed as (
  select *, cast(coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from records)
select archive, "offset", length, page_id, 'changed' as status from placed where page_id % 97 = 13 and html like '<%'
"""


@query("op11_embedding_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op11_embedding_near_dedup"] = r"""
with recursive vectors as (
  select vec_id, cast(embedding as double[]) as v,
    embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0
      and len([x for x in embedding if x <> 0]) > 0 as usable
  from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a, vectors b
  where a.vec_id <> b.vec_id and a.usable and b.usable and list_cosine_similarity(a.v, b.v) >= 0.95),
reach as (select vec_id as a, vec_id as b from vectors union select reach.a, links.b from reach join links on reach.b = links.a),
least as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, (select count(*) from links where links.a = least.vec_id) as n_links, component_id,
  vec_id = component_id as kept
from least
"""


@query("op13_phrase_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.first_phrases(collocations.phrases(table(spark, sf_dir, "documents")), 2000)


ORACLES["op13_phrase_collocations"] = r"""
with texts as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
pieces as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from texts),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (values (1), (2), (3)) as lengths(k) where len(w) >= k)
  group by all),
totals as (select lang, sum(f) as n from grams where k = 1 group by lang),
candidates as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from grams where k > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.a, l.f as l, r.f as r, cut,
    (c.a::hugeint * c.a::hugeint * 1000000::hugeint) // (l.f::hugeint * r.f::hugeint) as score
  from (select *, unnest(range(1, k)) as cut from candidates) c
  join grams l on l.lang = c.lang and l.phrase = array_to_string(c.w[1 : cut], ' ') and l.k = cut
  join grams r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1 :], ' ') and r.k = c.k - cut),
scored as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, part as phrase, max(a) as longer
  from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as part from candidates where k = 3)
  group by all),
kept as (
  select s.* from scored s left join longer using (lang, phrase) where longer is null or 100 * longer < 50 * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


@query("op12_ranked_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_trees.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_ranked_search"] = r"""
with doc_words as (
  select doc_id, row_number() over () as row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
item_words as (
  select item_id, row_number() over () as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark),
docs as (select row, doc_id, cast(len(w) as bigint) as n from doc_words where len(w) > 0),
totals as (select count(*) as n_docs, cast(sum(n) as bigint) as n_terms from docs),
wanted as (select item, item_id, term, count(*) as times from (select item, item_id, unnest(w) as term from item_words) group by all),
held as (
  select row, term, count(*) as tf from (select row, unnest(w) as term from doc_words)
  where term in (select term from wanted) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as weight
  from held, totals group by term, n_docs),
placed as (select row, doc_id, 75 + (25 * n * n_docs) // n_terms as m from docs, totals),
scores as (
  select item, item_id, row, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
  from wanted join weights using (term) join held using (term) join placed using (row) group by item, item_id, row, doc_id),
ranked as (select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 20
"""
