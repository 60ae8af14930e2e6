"""Phrase mining against a plain count of all phrases."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import collocations


def plain(docs, min_count, max_words, cover=50):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    chosen = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= min_count}
    covered = set()
    for (lang, words), a in chosen.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * a >= cover * counts[part]:
                    covered.add(part)
    out = []
    for (lang, words), a in chosen.items():
        if (lang, words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["New", "york", "city", "the", "ÉTÉ", "été", "a\x00b", "x y", "é e", "of", "and"]
    joints = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ;", "!?", "\x0b", "\x1c"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 40)):
            parts.append("New York city" if rng.random() < 0.2 else rng.choice(words))
            parts.append(rng.choice(joints))
        out.append("".join(parts))
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    for extra in ("word", "words", "code", "f", "a", "l", "r", "n", "score", "phrase", "rank", "salt"):
        df = df.withColumn(extra, F.lit("own"))
    return df


def got(df, **options):
    return sorted(map(tuple, collocations.phrases(df, **options).select("lang", "phrase", "a", "l", "r", "n", "score").collect()))


def rows(seed, n):
    rng = random.Random(seed)
    found = [(rng.choice(["en", "en", "de", "und", None, "a b"]), t) for t in texts(seed, n)]
    return found + found[:5] + [("en", None), ("en", ""), ("en", " ,. "), ("de", "york " * 4000)]


@pytest.mark.parametrize("max_words", [2, 3, 5])
def test_equals_plain_count(spark, max_words):
    data = rows(3, 120)
    want = plain(data, 4, max_words)
    assert got(frame(spark, data), min_count=4, max_words=max_words) == want
    assert len(want) > 50


def test_small_slices_change_nothing(spark, monkeypatch):
    """Texts, dictionaries, rows and counts cut into very small parts."""
    data = rows(5, 60)
    for name, value in (("_SLICE", 100), ("_ROW", 3), ("_WORDS", 4), ("_COUNTED", 50), ("FILTER_BITS", 1 << 6)):
        monkeypatch.setattr(collocations, name, value)
    assert got(frame(spark, data), min_count=3) == plain(data, 3, 3)


def test_equal_codes_are_found_out(spark, monkeypatch):
    code = collocations._code

    def clashing(lang, word, seed):
        return 7 if seed == 0 and word in (b"york", b"city") else code(lang, word, seed)

    data = rows(6, 60)
    monkeypatch.setattr(collocations, "_code", clashing)
    assert got(frame(spark, data), min_count=3) == plain(data, 3, 3)


def test_no_phrases(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [("en", "a b c"), (None, None)])) == []


def test_ranking(spark):
    found = [("en", f"p{i:03d} q", 10 + i % 3, 20, 20, 500, i // 10) for i in range(300)] + [("de", "é a", 10, 10, 10, 9, 5)]
    df = spark.createDataFrame(found, "lang string, phrase string, a long, l long, r long, n long, score long")
    ranked = [tuple(r) for r in collocations.first_phrases(df, 40).orderBy("lang", "rank").collect()]
    best = sorted(found[:-1], key=lambda r: (-r[6], -r[2], r[1]))[:40]
    assert ranked == [("de", 1, *found[-1][1:])] + [("en", i, *r[1:]) for i, r in enumerate(best, 1)]


def test_relations():
    relation = np.array([5, 6, 7, 0, 5, 6, 0, 9, 0])
    columns, counts = collocations.count_windows(relation, 2)
    assert sorted(zip(*columns, counts)) == [(5, 6, 2), (6, 7, 1)]
    every = np.full(1, np.iinfo(np.uint64).max, np.uint64)  # a filter that lets all pass
    assert collocations.extended(relation, 2, every).tolist() == [5, 6, 7, 0, 5, 6, 0]
    assert collocations.extended(relation, 3, every).tolist() == [5, 6, 7, 0]
    assert collocations.extended(relation, 4, every).tolist() == []
    words = [r for r in collocations._rows(np.array([1, 2, 0, 3, 0])).column("words").to_pylist()]
    assert sum(words, []) == [1, 2, 0, 3, 0]
