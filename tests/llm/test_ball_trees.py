"""Ranked search by ball trees against plain scoring of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import ball_trees

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, first=20):
    rows = [(doc_id, collections.Counter(plain_terms(t))) for doc_id, t in docs]
    rows = [(doc_id, c, sum(c.values())) for doc_id, c in rows if c]
    n_docs, n_terms = len(rows), sum(n for _, _, n in rows)
    df = collections.Counter(t for _, c, _ in rows for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c, n in rows:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for term in plain_terms(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * (1_000_000_000 * c[term] // (1000 * c[term] + 12 * m))
            if score:
                scores.append((-score, math.inf if doc_id is None else doc_id))
        for rank, (score, doc_id) in enumerate(sorted(scores)[:first], 1):
            out.append((item_id, rank, None if doc_id == math.inf else doc_id, -score))
    return sorted(out, key=repr)


def make(rng, n, words=25):
    vocabulary = ["été", "Straße", "x1", "007", "ab"] + [f"w{i}" for i in range(120)]
    return [" ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary[: rng.choice([10, 125])])
                     for _ in range(rng.randint(1, words))) for _ in range(n)]


def frames(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for extra in ("item", "n", "terms", "times", "score", "rank", "item_id"):
        a = a.withColumn(extra, F.lit("own"))
    return a, b.withColumn("item", F.lit("own")).withColumn("doc_id", F.lit("own"))


def got(spark, docs, items, **options):
    return sorted(map(tuple, ball_trees.ranked(*frames(spark, docs, items), **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"tree_docs": 7, "block_terms": 60, "first": 3}])
def test_equals_plain_scoring(spark, options):
    rng = random.Random(4)
    docs = list(enumerate(make(rng, 300)))
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # equal scores
    docs += [(5, docs[5][1]), (None, docs[9][1]), (None, "w1 w2"), (2000, None), (2001, ""), (2002, " .,;"), (2003, "w3 " * 5000)]
    items = list(enumerate(make(rng, 12))) + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (50, None), (51, "?"), (52, "absent"), (None, "w5.W6")]
    items.append((60, docs[3][1]))
    want = plain(docs, items, options.get("first", 20))
    assert got(spark, docs, items, **options) == want
    assert len(want) > 30


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == []
    assert got(spark, [(1, "a")], []) == []
    assert got(spark, [(1, None)], [(1, "a")]) == []


def trees(seed):
    rng = np.random.default_rng(seed)
    centres = (rng.random((6, 60)) < 0.2) * rng.integers(1, 900_000, (6, 60))
    values = centres[rng.integers(6, size=400)] * (rng.random((400, 60)) < 0.9)
    weights = rng.integers(1, 9000, 60)
    return rng, values.astype(np.float64), weights, ball_trees.BallTree(values.astype(np.float64), weights.astype(float), np.arange(0, 60, 3))


def test_bounds_hold_for_every_document_of_a_node():
    rng, values, weights, tree = trees(1)
    repeats = (rng.random((9, 60)) < 0.3) * rng.integers(1, 3, (9, 60))
    bounds = tree.bounds(repeats * weights.astype(float), np.sqrt(np.add.reduceat(repeats.astype(float) ** 2, np.arange(0, 60, 3), axis=1)))
    scores = (repeats * weights) @ values.T.astype(np.int64)
    for node, rows in enumerate(tree.rows):
        assert (scores[:, rows].max(axis=1) <= bounds[:, node]).all()
    assert sorted(np.concatenate([r for r, c in zip(tree.rows, tree.children) if c is None])) == list(range(400))


def test_search_leaves_subtrees_out():
    rng, values, weights, tree = trees(2)
    columns = np.flatnonzero(values[17])
    repeats = np.zeros((1, 60))
    repeats[0, columns] = 1
    bounds = tree.bounds(repeats * weights, np.sqrt(np.add.reduceat(repeats**2, np.arange(0, 60, 3), axis=1)))[0]
    places = ball_trees.Places(5)
    scored = ball_trees.search(tree, list(range(400)), bounds, columns, weights[columns], places)
    scores = values[:, columns].astype(np.int64) @ weights[columns]
    best = sorted(((-s, i) for i, s in enumerate(scores.tolist())))[:5]
    assert sorted((-s, -i) for s, i in places.heap) == best
    assert scored < 250
