"""Packing, vocabularies, losses and divergences against brute force."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import tokens as tk
from tallyweave.operators import divergence, encoding, hooks, losses, lookup, packing, sft, vocab
from tallyweave.plans import jobs
from tallyweave.sources.scratch import materialise

RNG = random.Random(11)
WORDS = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["x" * 200]
DOCS = [(i, "ab"[i % 3 == 0], " ".join(RNG.choices(WORDS, k=RNG.choice([0, 1, 3, 40, 90])))) for i in range(120)]
def tokens():
    return tk.tokenize_text(F.col("text"))



@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, g string, text string")


@pytest.mark.parametrize("length,batch", [(16, 10), (7, 120), (5000, 50), (1, 7)])
def test_pack_sequences(spark, docs, length, batch):
    lists = docs.select(F.col("doc_id").alias("at"), tokens().alias("input_ids"))
    got = packing.pack_sequences(lists, length, "at", batch_rows=batch).collect()
    want = []
    for b in range(0, len(DOCS), batch):
        flat = [t for d in DOCS[b : b + batch] for t in d[2].split()]
        want += [(b // batch, i, flat[i * length : (i + 1) * length]) for i in range(len(flat) // length)]
    assert sorted((r["batch"], r["block"], r["input_ids"]) for r in got) == want


def python_vocab():
    counts = collections.Counter(t for d in DOCS for t in d[2].split())
    return counts, sum(counts.values())


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 5, 1])
def test_token_ids_with_any_head(spark, docs, head):
    counts, _ = python_vocab()
    table = materialise(vocab.vocabulary(materialise(vocab.token_counts(docs, tokens()), "c")), "v")
    ids = {r["token"]: r["id"] for r in table.collect()}
    assert sorted(ids.values()) == list(range(len(counts)))
    ranked = sorted(ids, key=ids.get)
    assert [counts[t] for t in ranked] == sorted(counts.values(), reverse=True)
    got = {r["doc_id"]: r["input_ids"] for r in vocab.token_ids(docs, "doc_id", tokens(), table, head).collect()}
    assert got == {d[0]: [ids[t] for t in (d[2] or "").split()] for d in DOCS}


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 1])
def test_unknown_tokens_and_empty_rows_keep_their_place(spark, head):
    table = spark.createDataFrame([("a", 3, 0), ("b", 1, 1)], "token string, cnt bigint, id bigint")
    df = spark.createDataFrame([(1, "a zz b"), (2, "zz"), (3, "..."), (4, None)], "i int, t string")
    got = vocab.token_ids(df, "i", tk.tokenize_text(F.col("t")), table, head, unknown_id=9).collect()
    assert {r["i"]: r["input_ids"] for r in got} == {1: [0, 9, 1], 2: [9], 3: [], 4: []}


def testhead_weight_bounds_the_head(spark):
    table = spark.createDataFrame([(f"t{i}", c) for i, c in enumerate([1] * 50 + [2] * 10 + [9, 100, 1000])], "token string, cnt bigint")
    for head in (0, 1, 2, 3, 12, 13, 62, 63):
        cut = lookup.head_weight(table, "cnt", head)
        assert table.where(F.col("cnt") > cut).count() <= head


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 3])
def test_sequence_losses(spark, docs, head):
    counts, total = python_vocab()
    nll = {t: -math.log(c / total) for t, c in counts.items()}
    table = vocab.with_nll(materialise(vocab.token_counts(docs, tokens()), "c"))
    rows = losses.sequence_losses(vocab.token_rows(docs, tokens(), "doc_id"), table, "doc_id", 20, head_rows=head).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, _, text in DOCS:
        toks = text.split()
        if len(toks) < 2:
            assert i not in got
            continue
        masked = [nll[t] for p, t in enumerate(toks) if p >= 20]
        ull = sum(-math.log(max(1e-5, min(10.0, 1 - math.exp(-n)))) for n in masked)
        assert got[i]["masked_mean"] == pytest.approx(sum(masked) / (len(toks) - 1))
        assert got[i]["unlikelihood"] == pytest.approx(ull / (len(toks) - 1))
        if masked:
            assert got[i]["ppl"] == pytest.approx(math.exp(sum(masked) / len(masked)))
        else:
            assert got[i]["ppl"] is None


@pytest.mark.parametrize("alpha,temperature", [(1.0, 1.0), (0.5, 1.0), (1.0, 3.0), (0.1, 0.5)])
def test_kl(spark, docs, alpha, temperature):
    counts, total = python_vocab()
    by_group = collections.defaultdict(collections.Counter)
    for _, g, text in DOCS:
        by_group[g].update(text.split())

    def soft(c, n):
        raw = {t: ((c[t] + alpha) / (n + alpha * len(counts))) ** (1 / temperature) for t in counts}
        z = sum(raw.values())
        return {t: v / z for t, v in raw.items()}

    p = soft(counts, total)
    table = materialise(vocab.token_counts(docs, tokens(), "g"), "c")
    got = {r["g"]: r["kl"] for r in divergence.kl_divergence(table, "g", alpha, temperature).collect()}
    for g, c in by_group.items():
        q = soft(c, sum(c.values()))
        assert got[g] == pytest.approx(temperature**2 * sum(p[t] * math.log(p[t] / q[t]) for t in p), abs=1e-9)
    with pytest.raises(ValueError):
        divergence.kl_divergence(table, "g", 0.0)


def test_align_distributions(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "token string, cnt bigint")
    b = spark.createDataFrame([("y", 5), ("z", 7)], "token string, cnt bigint")
    got = {tuple(r) for r in divergence.align_distributions(a, b).collect()}
    assert got == {("x", 1, 0), ("y", 2, 5), ("z", 0, 7)}


@pytest.mark.parametrize("held", [divergence.CENTER_BYTES, 32])
def test_vector_drift_with_a_hot_group(spark, held):
    rows = [(i, 0 if i % 3 else i % 5, [RNG.random() for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, label int, v array<float>")
    centers = materialise(divergence.vector_means(df, "label", "v"), "c")
    got = {r["label"]: (r["drift"], r["n"]) for r in divergence.vector_l2_drift(df, "label", "v", centers, held).collect()}
    for label in {r[1] for r in rows}:
        vs = [r[2] for r in rows if r[1] == label]
        mean = [sum(x) / len(vs) for x in zip(*vs)]
        assert got[label][1] == len(vs)
        assert got[label][0] == pytest.approx(sum(math.dist(v, mean) for v in vs) / len(vs), abs=1e-5)


CHATS = "i int, messages array<struct<role:string,content:string>>"


def chat_encoder(spark, **options):
    table = [("INST", 9, 0), ("s", 5, 1), ("ASST", 4, 2), ("a", 3, 3), ("x" * 200, 2, 4)]
    return encoding.Encoder(encoding.dictionary(spark.createDataFrame(table, "token string, cnt bigint, id bigint")), **options)


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 2, 0])
def test_tokenize_chat_filter_and_padding(spark, head):
    rows = [(0, [("user", "a b")]), (1, [("user", "a " * 50)]), (2, [("system", "s")]), (3, [("assistant", "x" * 200 + " " + "y" * 90)])]
    df, encode = spark.createDataFrame(rows, CHATS), chat_encoder(spark, head_rows=head)
    out = sft.tokenize_chat(df, ["i"], encode, 8)
    assert dict(out.dtypes) == {"i": "int", "input_ids": "array<int>", "attention_mask": "array<int>"}
    kept = {r["i"]: r for r in out.collect()}
    assert {i: r["input_ids"] for i, r in kept.items()} == {0: [0, 0, 3, 2, 5, 1, 2, 4], 2: [0] * 8, 3: [0, 0, 0, 0, 6, 1, 4, 3]}
    assert {i: sum(r["attention_mask"]) for i, r in kept.items()} == {0: 6, 2: 0, 3: 4}
    everything = {r["i"]: r for r in sft.tokenize_chat(df, ["i"], encode, 8, no_filter=True, pad_id=7).collect()}
    assert len(everything[1]["input_ids"]) == 54 and set(everything[1]["attention_mask"]) == {1}
    assert everything[2]["input_ids"] == [7] * 8
    labelled = sft.select_token_columns(sft.add_labels(sft.tokenize_chat(df, ["i"], encode, 8)), "i")
    assert labelled.columns == ["i", "input_ids", "attention_mask", "labels"]


def test_a_joined_vocabulary_needs_keys(spark):
    with pytest.raises(ValueError):
        chat_encoder(spark, head_rows=2)(spark.range(1), F.array(F.lit("a")))
    assert chat_encoder(spark)(spark.range(1), F.array(F.lit("a"), F.lit("zz"))).first()["input_ids"] == [5, 1]


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 5, 1])
def test_ids_of_many_rows(spark, docs, head):
    """Hot, rare, long and unknown tokens, whole and split vocabularies, other columns kept."""
    counts, _ = python_vocab()
    known = [t for t, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:-3]
    table = spark.createDataFrame([(t, counts[t], i) for i, t in enumerate(known)], "token string, cnt bigint, id bigint")
    encode = encoding.Encoder(encoding.dictionary(materialise(table, "v")), head_rows=head)
    got = encode(docs.withColumn("key", F.lit("own")), tokens(), "ids", ["doc_id"]).collect()
    want = {i: [known.index(t) + 2 if t in known else 1 for t in text.split()] for i, _, text in DOCS}
    assert {r["doc_id"]: r["ids"] for r in got} == want
    assert len(got) == len(DOCS) and {r["key"] for r in got} == {"own"} and {r["g"] for r in got} == {"a", "b"}


def test_prepared_corpus(spark, docs):
    counts, _ = python_vocab()
    known = sorted(counts)
    table = spark.createDataFrame([(t, counts[t], i) for i, t in enumerate(known)], "token string, cnt bigint, id bigint")
    encode = encoding.Encoder(encoding.dictionary(table))
    rows = jobs.job_prepare_corpus(docs, "doc_id", F.col("text"), 32, 3, encode, batch_rows=40).collect()
    want = {}
    for b in range(0, len(DOCS), 40):
        flat = [known.index(t) + 2 for d in DOCS[b : b + 40] for t in d[2].split()]
        want |= {(b // 40, i): flat[i * 32 : (i + 1) * 32] for i in range(len(flat) // 32)}
    assert {(r["batch"], r["block"]): r["input_ids"] for r in rows} == want
    assert all(r["labels"] == r["input_ids"] and r["attention_mask"] == [1] * 32 for r in rows)
    order_ = sorted(want, key=lambda k: (hashlib.md5(f"3:{k[0]}:{k[1]}".encode()).hexdigest(), k))
    assert {(r["batch"], r["block"]): r["pos"] for r in rows} == {k: i for i, k in enumerate(order_)}


def test_tokenizer_hook(spark):
    hook = hooks.tokenizer_hook(lambda: lambda t: [len(w) for w in t.split()])
    df = spark.createDataFrame([("a bb ccc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(hook(F.col("t"))).collect()] == [[1, 2, 3], [], None]


def test_long_conversations_stay_whole(spark):
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    text = F.when(F.col("id") == 1, "x").otherwise("a long enough answer")
    turns = spark.range(1500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text"))
    rows = sft.assemble_conversations(turns)
    assert [len(r["messages"]) for r in rows.collect()] == [1500]
    assert sft.min_response_filter(rows, 5).count() == 0
    assert sft.filter_conversations(turns, min_response_length=5).count() == 0
    assert sft.assemble_conversations(turns.where("turn between 997 and 1003")).count() == 1


def test_a_null_answer_is_short_for_both_filters(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None)], "conv_id int, turn int, role string, text string")
    assert sft.min_response_filter(sft.assemble_conversations(turns), 1).count() == 0
    assert sft.filter_conversations(turns, min_response_length=1).count() == 0


def test_turn_pairs_over_gaps(spark):
    rows = [(1, 0, "user", "q"), (1, 5, "assistant", "a"), (1, 7, "user", "r"), (1, 8, "system", "s"), (1, 9, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in sft.turn_pairs(turns).collect()] == [(1, 0, "q", "a")]


@pytest.mark.parametrize("head", [lookup.HEAD_ROWS, 1])
def test_filters_on_turn_rows_see_the_whole_conversation(spark, head):
    long = [(1, t, ("user", "assistant")[t % 2], "word " * 3) for t in range(40)]
    late = [(2, t, ("user", "assistant")[t % 2], "x" if t == 39 else "word " * 3) for t in range(40)]
    small = [(3, 0, "user", "hi"), (3, 1, "assistant", "word " * 3), (4, 0, "system", "s"), (5, 0, "assistant", "w" * 9)]
    turns = spark.createDataFrame(long + late + small, "conv_id bigint, turn bigint, role string, text string")

    def kept(**options):
        df = sft.filter_conversations(turns, head_rows=head, **options)
        return {r["conv_id"]: r["count"] for r in df.groupBy("conv_id").count().collect()}

    assert kept() == {1: 40, 2: 40, 3: 2, 4: 1, 5: 1}
    assert kept(min_response_length=5) == {1: 40, 3: 2, 4: 1, 5: 1}
    assert kept(min_response_length=5, max_tokens=100) == {3: 2, 4: 1, 5: 1}
    # The same answer as the row filters where a conversation is one row.
    rows = sft.min_response_filter(sft.assemble_conversations(turns), 5)
    rows = sft.tokenize_chat(rows, ["conv_id"], chat_encoder(spark), 100)
    assert {r["conv_id"] for r in rows.collect()} == {3, 4, 5}
