"""Quality rules, decontamination, pieces, token files, pages, archives, chat examples, pipeline."""

import gzip
import hashlib
import html
import math
import random
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from harness import plan_text
from tallyweave.llm import chat_examples, html_text, multi_pattern, pieces, queries, token_files, warc, weak_rules

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def plain_counts(text):
    w = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


QUALITY = [None, "", " \n ", "a", "a b", "a b a b a b", "x y z x y z", "é|# <b>\n\n\na b c\na b c\n a b c", "one two three " * 4, "a\x0bb c\x0cd\re"]


def test_counts(spark, frame):
    texts = QUALITY + ["the cat sat on the mat. " * 50, " ".join(f"w{i}" for i in range(5000))]
    df = frame(list(enumerate(texts))).drop("n_words", "votes", "kept")
    got = weak_rules.with_counts(df).orderBy("doc_id").select(*weak_rules.COUNTS).collect()
    assert [tuple(r) for r in got] == [plain_counts(t) for t in texts]


def test_expectation_maximisation(spark):
    rng = random.Random(4)
    votes = [v for v in product((-1, 0, 1), repeat=3) if rng.random() < 0.8]
    seen = [(list(v), rng.randint(1, 500)) for v in votes]
    got = {tuple(r["votes"]): r["p_good"] for r in weak_rules.posteriors(spark.createDataFrame(seen, "votes array<int>, n bigint"), 3).collect()}
    prior, alpha, beta = 0.5, [weak_rules.START_GOOD] * 3, [weak_rules.START_BAD] * 3

    def good(v):
        a, b = math.log(prior), math.log(1 - prior)
        for x, p, q in zip(v, alpha, beta):
            a += math.log(p) if x == 1 else math.log(1 - p) if x == -1 else 0
            b += math.log(q) if x == -1 else math.log(1 - q) if x == 1 else 0
        return 1 / (1 + math.exp(b - a))

    for _ in range(weak_rules.ROUNDS):
        g = [(v, n, good(v)) for v, n in seen]
        prior = (1 + sum(n * p for _, n, p in g)) / (2 + sum(n for _, n, _ in g))
        alpha, beta = (
            [(1 + sum(n * w(p) for v, n, p in g if v[j] == hit)) / (2 + sum(n * w(p) for v, n, p in g if v[j])) for j in range(3)]
            for hit, w in ((1, lambda p: p), (-1, lambda p: 1 - p))
        )
    assert got.keys() == {tuple(v) for v, _ in seen}
    assert all(abs(got[tuple(v)] - good(v)) < 1e-9 for v, _ in seen)


def test_quality_on_labelled_documents(spark):
    got = queries.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01")
    assert not any(x in plan_text(got) for x in ("Python", "Pandas", "Arrow"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    n = {tuple(r)[:3]: r["count"] for r in got.join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()}
    right = n.get((1, False, True), 0) + n.get((0, False, False), 0)
    assert right > 0.98 * sum(v for k, v in n.items() if not k[1])
    assert not any(failed and kept for _, failed, kept in n)


def test_keep_good_writes_no_texts(frame, monkeypatch):
    written, write = [], weak_rules.materialise
    monkeypatch.setattr(weak_rules, "materialise", lambda df, label: written.append(df.schema.simpleString()) or write(df, label))
    good = " ".join(f"word{i} and. \n" for i in range(120))
    rows = [(1, good), (1, good), (None, good), (2, "few"), (3, None)]
    assert [(r["doc_id"], r["text"]) for r in weak_rules.keep_good(frame(rows)).orderBy("doc_id").collect()] == [(None, good), (1, good), (1, good)]
    assert written and "string" not in written[0]


def test_keep_good(spark, frame):
    rows = [(i, f"These are the plain words of a text about number {i}. " * 1 + " ".join(f"word{i}x{j}" for j in range(120)) + ".") for i in range(8)]
    df = frame(rows + [(50, None), (51, ""), (None, rows[0][1]), (1, rows[1][1])])
    out = weak_rules.keep_good(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([*range(8), None, 1], key=str)
    assert weak_rules.keep_good(frame([])).count() == 0


def test_no_column_name_clashes(spark, frame):
    names = ["_words", "_lines", "_windows", "_sorted", "_places", "_row", "_doc", "_text", "votes", "n_lines", "n_marks", "word_chars", "kept", "a.b"]
    df = frame([(1, "a few plain words"), (2, None)])
    for name in names:
        df = df.withColumn(name, F.lit(f"own {name}"))
    got = weak_rules.judged(df)
    assert {c: got.first()[c] for c in names if c not in ("word_chars", "kept")} == {c: f"own {c}" for c in names if c not in ("word_chars", "kept")}
    assert sorted(tuple(r) for r in got.select(*weak_rules.COUNTS, "kept").collect()) == [(0, 0, 0, 0, 0, False), (4, 14, 0, 0, 0, False)]
    kept = df.withColumn("text", F.lit("These are the plain words of a text. " + " ".join(f"word{j}" for j in range(120)) + "."))
    assert weak_rules.keep_good(kept).columns == kept.columns
    assert {r["_row"] for r in weak_rules.keep_good(kept).collect()} == {"own _row"}


def plain_hits(text, items, size):
    words = multi_pattern.text_words(text)
    hit, found = set(), set()
    for item, t in items:
        for w in multi_pattern.windows(multi_pattern.text_words(t), size):
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("per_pass", [multi_pattern.PATTERNS_PER_PASS, 5])
def test_search_equals_brute_force(spark, frame, per_pass):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(6)] + [(9, None), (None, "a b b a"), (10, "Ü-7 x"), (2, "a a a a")]
    docs = [(d, " ".join(rng.choice("aab") for _ in range(rng.randint(0, 30)))) for d in range(40)] + [(50, None), (51, "ü 7 X Ü-7,x!"), (51, "ü 7 X Ü-7,x!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = multi_pattern.contaminated(frame(docs), bench, size=4, per_pass=per_pass).collect()
    want = [(d, *plain_hits(t, items, 4)) for d, t in docs]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(want)
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)


def test_drop_contaminated(spark, frame):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    df = frame([(1, "x one, TWO three y"), (2, "one two"), (3, None), (None, "four")])
    out = multi_pattern.drop_contaminated(df, bench)
    assert out.columns == df.columns and sorted((r["doc_id"] for r in out.collect()), key=str) == [2, 3, None]
    assert multi_pattern.drop_contaminated(df, bench.where("item_id = 7")).count() == 4


@pytest.mark.parametrize("per_pass", [multi_pattern.PATTERNS_PER_PASS, 1])
def test_each_row_is_judged_on_its_own(spark, frame, per_pass):
    bench = spark.createDataFrame([(1, "one two three"), (2, "six seven")], "item_id bigint, text string")
    df = frame([(None, "x one two three"), (None, "clean"), (5, "six seven"), (5, "also clean"), (None, None)])
    df = df.withColumn("odd name", F.struct(F.lit(1).alias("a b")))
    out = multi_pattern.drop_contaminated(df, bench, per_pass=per_pass)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert sorted(((r["doc_id"], r["text"], r["odd name"]["a b"]) for r in out.collect()), key=str) == sorted(
        [(None, "clean", 1), (5, "also clean", 1), (None, None, 1)], key=str
    )


def test_pieces_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = pieces.Encoder(pieces.PieceModel.load(MODEL))
    rng = random.Random(6)
    texts = ["", "   ", " a", "Hello  world\n\tfoo é \x00", "日本語のテキスト。", "a" * 400, "<s></s><0x0A>", "🎉é́ x", "x\x1fy z", "▁ ▁"]
    for alphabet in ("aeinrst ", "ab \n.", "aeiouxyzAB ,.\n09éß日🎉▁\x1f"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for _ in range(2):  # units unknown, then known
        assert encoder.encode(texts).to_pylist() == library.encode(texts, num_threads=1)
    assert [encoder.decode(i) for i in library.encode(texts)] == [t.replace("▁", " ") for t in texts]
    assert encoder.encode([None, ""]).to_pylist() == [[], []] and encoder.encode([]).to_pylist() == []


def test_unigram_scoring_equals_the_library(tmp_path):
    raw = Path(MODEL).read_bytes()
    assert raw.count(b"tok_v0\x18\x02") == 1
    path = tmp_path / "unigram.model"
    path.write_bytes(raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    model = pieces.PieceModel.load(str(path))
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Encoder(model)
    score = lambda ids: sum(float(model.scores[i]) for i in ids)
    texts = ["the plain words of a text", "aeinrst", "reading and writing"]
    # Sums may tie; the best sum and the text are the same.
    for text, own, other in zip(texts, encoder.encode(texts).to_pylist(), library.encode(texts)):
        assert score(own) >= score(other) and encoder.decode(own) == text


def test_encode_texts(spark, frame):
    rows = [(1, "a text"), (2, None), (3, ""), (None, "a text"), (1, "a text"), (4, "long words " * 4000)]
    got = pieces.encode_texts(frame(rows), pieces.PieceModel.load(MODEL)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_token_files(spark, frame, tmp_path):
    rows = [(5, "It's a <|endoftext|> test, İ \x1c ok..."), (2, None), (None, "null id"), (9, ""), (2, "twice"), (7, "Σας 日本 " * 3000)]
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(frame(rows), path, WORDS, 1)
    key = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t) as k").collect()}
    library = Tokenizer.from_str(WORDS)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key[r[1]])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = token_files.with_checksum(token_files.read_tokens(spark, path)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert token_files.find_documents(spark, path, [9]).first()["ids"] == [1]
    assert "PushedFilters: [In(doc_id, [5,9])]" in plan_text(token_files.find_documents(spark, path, [5, 9]))
    token_files.write_tokens(frame([]), f"{tmp_path}/none", WORDS, 1)
    assert token_files.read_tokens(spark, f"{tmp_path}/none").count() == 0


PAGES = [
    (None, ""),
    ("", ""),
    ("<article><p>a&nbsp;b  &lt;p&gt; <b>x</b>y<br>z</p></article>", "a b <p> xy z"),
    ("<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One.</p><p>t", "T One. t"),
    ("<article><p>x</p><div class='comments'><p>" + "q " * 200 + "</p></div><p>y</p><form>f</form></article><div class=ad>k</div>", "x y"),
    ("<body class='has-sidebar'><main><p>kept text</p><aside>no</aside></main><div id=side-bar class=sidebar>" + "w " * 50 + "</div>", "kept text"),
    ("<div class=cookie-notice>We use cookies</div><article><script>if (a<b) {}</script>q<style>p{}</style>r<!-- c > d --></article>", "qr"),
]


def test_rows_without_id_are_spread(spark, tmp_path):
    """A third of the ids is null, and one id has as many rows: both are cut into several parts."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 5) for i in range(3000)]
    path = f"{tmp_path}/tokens"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for tables that are not small
    try:
        token_files.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8), path, WORDS, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = spark.read.orc(path)
    per_part = [r["count"] for r in written.groupBy("part").count().collect()]
    assert sum(per_part) == 3000 and max(per_part) < 900
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert ids == sorted(ids)
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == starts[:-1].tolist()


def test_pieces_are_forgotten(monkeypatch):
    """A very small store of pieces gives the same ids."""
    texts = ["Some words, and some more.", "more words; less!", None, "words words", "İ <|x|> a\tb\x0bc", "é" * 200] * 4
    library = Tokenizer.from_str(WORDS)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kept in (1_000_000, 3):
        monkeypatch.setattr(token_files, "_KEPT", kept)
        encoder = token_files.PieceEncoder(WORDS)
        for at in range(0, len(texts), 3):
            flat, ends = encoder.ids(texts[at : at + 3])
            assert [x.tolist() for x in np.split(flat, ends[:-1])] == want[at : at + 3]


def test_main_text(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "own") for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[2][0], "own")], "page_id bigint, url string, html string, text string")
    got = html_text.main_text(df).collect()
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in got), key=str) == sorted(
        [(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, PAGES[2][1], len(PAGES[2][1]))], key=str
    )
    assert html_text.main_text(df.limit(0)).count() == 0


def test_main_text_is_the_article(spark):
    for page in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = page["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        for tag in ("p", "/p", "h1", "/h1", "br"):
            inner = inner.replace(f"<{tag}>", " ")
        want = " ".join(html.unescape(inner.replace("<b>", "").replace("</b>", "")).split())
        assert html_text.Extractor(html_text.train()).text(page["html"]) == want


def test_archives_and_audit(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>é {i}</p>\r\n\r\n" * (i % 7)) for i in range(60)] + [(None, "u", "x"), (61, None, None), (62, "a\r\nb", "")], "page_id bigint, url string, html string")
    rows = warc.records(pages, 20)
    warc.write_archives(rows, f"{tmp_path}/a")
    stored, known = warc.read_archives(spark, f"{tmp_path}/a").cache(), warc.catalogue(rows).cache()
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, known.collect())) and known.count() == 62
    for range_bytes, fanout in ((128, 4), (4096, 16)):
        assert warc.audit(known, stored, range_bytes, fanout).count() == 0
        bad = stored.withColumn("digest", F.when(F.col("page_id") == 33, "0").otherwise(F.col("digest"))).where("page_id <> 61 and archive <> 0")
        got = {(r["page_id"], r["status"]) for r in warc.audit(known, bad, range_bytes, fanout).collect()}
        assert got == {(33, "changed"), (61, "missing")} | {(i, "missing") for i in range(20)}
        got = {(r["page_id"], r["status"]) for r in warc.audit(bad, known, range_bytes, fanout).collect()}
        assert got == {(33, "changed"), (61, "extra")} | {(i, "extra") for i in range(20)}
    assert warc.audit(known.limit(0), stored.limit(0)).count() == 0
    packed = gzip.compress(b"one") + gzip.compress(b"two" * 99_999)
    assert warc.inflate(packed) == b"one" + b"two" * 99_999 and warc.inflate(b"plain") == b"plain"
    assert warc.inflate(packed[:-9] + b"damaged!!").startswith(b"one")
    assert [r[1] for r in warc.parse_archive(b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\nbroken")] == [37, 6]


def test_chat_examples(spark):
    tricky = r"\### Assistant: </turn> ok \l \b <turn>user"
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", tricky), (1, 2, "assistant", tricky + "\n"), (1, 3, "user", None), (1, 4, "assistant", "é😀"), (1, 5, "user", "tail"),
        (2, 0, "user", "q"), (3, 0, "assistant", ""), (None, None, None, "x"), (4, 1, "a\nb\\n", "odd role"), (4, 1, "assistant", "tie"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id bigint, turn bigint, role string, text string, whole string")
    written = chat_examples.examples(df)
    assert {r[0]: r[1] for r in written.groupBy("conv_id").count().collect()} == {1: 3, 2: 1, 3: 1, 4: 1, None: 1}
    turns = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    for r in chat_examples.digests(written).collect():
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in own)
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_examples.examples(df.limit(0)).count() == 0


def test_chat_query_is_native(spark):
    plan = plan_text(queries.QUERIES["op9_chat_formatting"](spark, SF))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    write, stages = corpus_pipeline.materialise, {}

    def recorded(df, label):
        stages[label.removeprefix("pipeline-")] = out = write(df, label)
        return out

    monkeypatch.setattr(corpus_pipeline, "materialise", recorded)
    final = corpus_pipeline.run(spark, SF)
    assert list(stages) == [name for name, _ in corpus_pipeline.STAGES]
    assert all(df.schema.simpleString() == docs.schema.simpleString() for df in list(stages.values())[:-1])

    def texts(name):
        return {r["doc_id"]: r["text"] for r in stages[name].select("doc_id", "text").collect()}

    judged = weak_rules.judged(docs.select("doc_id", "text")).where("kept").collect()
    good, lines = texts("quality_rules"), texts("line_dedup")
    assert set(good) == {r["doc_id"] for r in judged}
    # Every line of text occurs once, in the first document that has it.
    seen = {}
    for d in sorted(good):
        for line in good[d].split("\n"):
            if len(line) >= 20:
                seen.setdefault(line, d)
    left = [(line, d) for d in lines for line in lines[d].split("\n") if len(line) >= 20]
    assert len({line for line, _ in left}) == len(left) and all(seen[line] == d for line, d in left)
    near, clean = texts("simhash_near_dedup"), texts("benchmark_decontamination")
    assert set(near) <= set(lines) and len(near) > 0.9 * len(lines)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(clean) == {d for d, t in near.items() if not plain_hits(t, items, 10)[1]}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert {r["doc_id"]: r["ids"] for r in final.collect()} == {d: library.encode(t) for d, t in clean.items()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
