"""Lattice hashing of embeddings against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyweave.llm import lattice


def plain(rows, cosine=lattice.COSINE):
    """(id, n_links, component, kept) of every row, by comparing all pairs."""

    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not usable(a) or not usable(b) or len(a) != len(b):
            return False
        a, b = np.array(a, np.float64), np.array(b, np.float64)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine

    n = len(rows)
    near = [[j for j in range(n) if j != i and linked(rows[i][1], rows[j][1])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            fresh = [j for j in near[todo.pop()] if j not in seen]
            seen.update(fresh)
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    for extra in ("vec", "node", "code", "copies", "first", "kept", "root", "part"):
        df = df.withColumn(extra, F.lit("own"))
    return df


def near_rows(seed, n, dims=64):
    """Groups of vectors whose cosines to their centre lie around the threshold."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    rows = []
    for i in range(n):
        c = centres[rng.integers(4)]
        v = c / np.linalg.norm(c) + rng.normal(size=dims) / math.sqrt(dims) * rng.choice([0.05, 0.2, 0.28, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.01, 1.0, 300.0])]))
    return rows


def got(df, **options):
    return sorted(map(tuple, lattice.near_duplicates(df, **options).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = near_rows(3, 160)
    rows += [(1000 + i, rows[7][1]) for i in range(12)] + [(7, rows[7][1]), (None, rows[9][1])]
    want = plain(rows)
    assert max(r[1] for r in want) > 20 and len({r[2] for r in want}) > 20
    # Enough tables that even pairs right at the threshold meet; cells cut into blocks of about five vectors.
    assert got(frame(spark, rows), held=64 * 5, tables=12, probes=16) == want
    usual = got(frame(spark, rows))
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(usual, want))
    assert sum(r[1] for r in usual) >= 0.99 * sum(r[1] for r in want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, -0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 0.0]), (8, [1.0, -0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]),
        (None, [0.0, 2.0]), (None, [3.0, 0.1]), (10, [1e300, 0.0]), (11, [1e-300, 0.0]), (12, [-1.0, 0.0]), (None, None),
    ]
    assert got(frame(spark, rows, "double")) == plain(rows)
    assert got(frame(spark, rows[:0])) == []


def test_components_below_the_threshold_stay_apart(spark):
    angle = math.acos(0.95)
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate([0, angle * 0.99, angle * 1.98, angle * 3.0, angle * 4.01])]
    assert got(frame(spark, rows, "double")) == [(0, 1, 0, True), (1, 2, 0, False), (2, 1, 0, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_recall_at_the_threshold():
    """Pairs of exactly the linking cosine, in random directions, share a cell."""
    rng = np.random.default_rng(11)
    a = lattice.unit(rng.normal(size=(3000, 64)))
    r = rng.normal(size=a.shape)
    r = lattice.unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    b = lattice.unit(0.95 * a + math.sqrt(1 - 0.95**2) * r)
    cells = lattice.Cells(64, lattice.TABLES, lattice.PROBES, lattice.SCALE)
    met = (cells(a)[:, :, None] == cells(b)[:, None, :]).any(axis=(1, 2))
    assert met.mean() > 0.99
    strangers = (cells(a)[:, :, None] == cells(a[::-1])[:, None, :]).any(axis=(1, 2))
    assert strangers.mean() < 0.01


def test_lattice_points():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)) * 3
    points = lattice.nearest_e8(x)
    assert lattice.SHORTEST.shape == (240, 8) and (abs((lattice.SHORTEST**2).sum(axis=1) - 2) < 1e-12).all()
    assert ((2 * points) % 1 == 0).all() and (points.sum(axis=1) % 2 == 0).all()
    # No neighbouring point lies nearer.
    gap = ((x - points) ** 2).sum(axis=1)
    for step in lattice.SHORTEST:
        assert (gap <= ((x - points - step) ** 2).sum(axis=1) + 1e-9).all()
    # Cells do not depend on which rows are decoded together.
    units = lattice.unit(rng.normal(size=(50, 24)))
    cells = lattice.Cells(24, 2, 3, 2.0)
    assert (cells(units) == np.concatenate([cells(units[i : i + 1]) for i in range(50)])).all()
