"""Near-duplicate embeddings by E8 lattice hashing.

A table projects unit vectors on ``BLOCKS`` times eight random sign directions and decodes
each block of eight coordinates to the nearest point of the E8 lattice; the lattice points
of all blocks name a cell. A vector is entered under its own cell and under the ``PROBES``
neighbouring cells that lie nearest (a block's point moved by one of the 240 shortest
lattice vectors), in each of ``TABLES`` tables. Vectors that share a cell of a table are
compared by cosine in double precision, and only true links come out.

Cells travel as narrow (cell, vector) rows; vectors are fetched only for cells that hold
two or more. A crowded cell is cut into blocks by a hash, and every pair of blocks is one
group, so that a group is bounded and nothing is dropped. Links inside a group are never
written out: a group gives each vector the number of its partners, and a spanning forest
of links for the components. A pair that meets in several cells is counted in the one with
the least code, which the group finds from both vectors' own cell lists.

Arithmetic on projections is exact in doubles (small integers and dyadic fractions), so a
vector has the same cells in every task and after every retry.

Recall: a pair of cosine 0.95 in a random direction meets with a probability of about
0.998, at 0.96 and above over 0.999 (64 dimensions; ``tests/llm`` measures it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import long_array
from tallyweave.llm.graph import components
from tallyweave.sources.scratch import materialise

COSINE = 0.95
TABLES = 6
BLOCKS = 3
PROBES = 6
#: Lattice scale: a unit vector's projections have variance 1, so vectors of cosine 0.95 differ by 0.32 in each.
SCALE = 2.0
#: Numbers (vectors times dimensions) in one block of a crowded cell.
HELD = 1 << 18
_NEAREST = 6  # neighbours of a block's lattice point that are tried
_STRIPE = 512
_SMALL = 8  # groups up to this size are compared together
_SLICE = 1 << 18
_GRID = 1 << 20
_BORDER = 1e-9


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    pairs = [(i, j, a, b) for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for row, (i, j, a, b) in zip(whole, pairs):
        row[i], row[j] = a, b
    signs = np.array([[1 - 2 * (n >> k & 1) for k in range(8)] for n in range(256)])
    return np.concatenate([whole, signs[signs.prod(axis=1) == 1] / 2])


SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    point = np.rint(x)
    error = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(error[odd]).argmax(axis=1)
    point[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return point


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight numbers: the better of D8 and D8 moved by one half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow for very large or small components."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Cells:
    """The lattice tables for vectors of one length."""

    def __init__(self, dims: int, tables: int, probes: int, scale: float):
        self.dims, self.tables, self.probes, self.scale = dims, tables, probes, scale
        rng = np.random.default_rng([dims, tables, 8])
        self.signs = rng.integers(0, 2, (tables, dims, 8 * BLOCKS)) * 2.0 - 1
        self.mix = rng.integers(0, 1 << 63, (tables, 8 * BLOCKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.start = rng.integers(0, 1 << 63, tables, dtype=np.uint64)

    def __call__(self, units: np.ndarray) -> np.ndarray:
        """Codes of the cells of unit rows: (rows, tables * (1 + probes)), as signed longs."""
        whole = np.rint(units * _GRID)
        return np.concatenate([self._table(t, whole) for t in range(self.tables)], axis=1).view(np.int64)

    def _table(self, t: int, whole: np.ndarray) -> np.ndarray:
        n, keep = len(whole), 1 + self.probes
        places = np.rint(whole @ self.signs[t] * (65536 / (_GRID * self.scale))) / 65536
        far, code = np.zeros((n, 1)), np.full((n, 1), self.start[t])
        for at in range(0, 8 * BLOCKS, 8):
            x, mix = places[:, at : at + 8], self.mix[t, at : at + 8]
            point = nearest_e8(x)
            closer = (x - point) @ SHORTEST.T
            best = np.argsort(-closer, axis=1, kind="stable")[:, :_NEAREST]
            steps = np.c_[np.zeros(n), 2 - 2 * np.take_along_axis(closer, best, axis=1)]
            # Twice a lattice point is whole; a cell's code is a sum modulo 2^64 of its coordinates times odd numbers.
            own = ((2 * point).astype(np.int64).view(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
            moved = ((2 * SHORTEST).astype(np.int64).view(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
            codes = np.c_[own, own[:, None] + moved[best]]
            far = (far[:, :, None] + steps[:, None, :]).reshape(n, -1)
            code = (code[:, :, None] + codes[:, None, :]).reshape(n, -1)
            order = np.argsort(far, axis=1, kind="stable")[:, :keep]
            far, code = np.take_along_axis(far, order, axis=1), np.take_along_axis(code, order, axis=1)
        return code


class _Tables:
    """Cells by vector length, made when first needed."""

    def __init__(self, *options):
        self.options, self.made = options, {}

    def __getitem__(self, dims: int) -> Cells:
        if dims not in self.made:
            self.made[dims] = Cells(dims, *self.options)
        return self.made[dims]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _sizes(column: pa.Array) -> np.ndarray:
    return pc.list_value_length(column).to_numpy(zero_copy_only=False)


def _coder(options: tuple):
    """(node, vec) to (code, node): one row per cell of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(*options)
        for batch in batches:
            nodes, vectors = long_array(batch.column("node")), batch.column("vec")
            sizes = _sizes(vectors)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                step = max(1, _SLICE // dims)
                for part in (at[i : i + step] for i in range(0, len(at), step)):
                    codes = tables[dims](unit(_matrix(vectors.take(pa.array(part)), dims)))
                    named = np.repeat(nodes[part], codes.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(named)], names=["code", "node"])

    return run


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows of ``a`` with the same rows of ``b``, summed in component order."""
    dots = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        dots += x * y
    return dots


def _linked(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which unit rows link; a product near the threshold is summed again in a fixed order."""
    products = left @ right.T
    linked = products >= cosine
    i, j = np.nonzero(np.abs(products - cosine) < _BORDER)
    if len(i):
        linked[i, j] = cosines(left[i], right[j]) >= cosine
    return linked


def _met_before(cells: np.ndarray, left: np.ndarray, right: np.ndarray, code: int) -> np.ndarray:
    """Which pairs of rows (numbers into ``cells``) share a cell whose code is less than ``code``."""
    met = np.zeros((len(left), len(right)), bool)
    own, others = cells[left], cells[right]
    shared = np.intersect1d(own[own < code], others[others < code])
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]

        def held(rows: np.ndarray) -> np.ndarray:
            place = np.searchsorted(part, rows).clip(0, len(part) - 1)
            out = np.zeros((len(rows), len(part)), np.float32)
            i, j = np.nonzero(part[place] == rows)
            out[i, place[i, j]] = 1
            return out

        met |= held(own) @ held(others).T > 0
    return met


def group_links(units: np.ndarray, side: np.ndarray, copies: np.ndarray, code: int, cells: Cells, cosine: float):
    """Links of one group: (partners of each row counted here, spanning links as row numbers).

    ``side`` is 0 everywhere, or 0 and 1 for two blocks of which only cross pairs are compared.
    """
    n = len(units)
    two = bool(side.any())
    right = np.flatnonzero(side) if two else np.arange(n)
    left = np.flatnonzero(side == 0)
    counts = np.zeros(n, np.int64)
    label = np.arange(n)
    found: list[tuple[int, int]] = []
    own: np.ndarray | None = None
    for at in range(0, len(left), _STRIPE):
        part = left[at : at + _STRIPE]
        linked = _linked(units[part], units[right], cosine)
        if not two:
            linked[np.arange(len(part)), part] = False
        rows = np.flatnonzero(linked.any(axis=1))
        if not len(rows):
            continue
        columns = np.flatnonzero(linked.any(axis=0))
        linked = linked[np.ix_(rows, columns)]
        a, b = part[rows], right[columns]
        for i, row in zip(a.tolist(), linked):
            near = b[row]
            labels, first = np.unique(label[near], return_index=True)
            fresh = labels != label[i]
            if fresh.any():
                found.extend((i, j) for j in near[first[fresh]].tolist())
                label[np.isin(label, labels)] = label[i]
        if own is None:
            own = cells(units)
        linked &= ~_met_before(own, a, b, code)
        counts[a] += linked @ copies[b]
        if two:
            counts[b] += copies[a] @ linked
    return counts, np.array(found, np.int64).reshape(-1, 2)


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least code that each row of ``a`` shares with the same row of ``b``; every row must share one."""
    low = np.full(len(a), np.iinfo(np.int64).max)
    for column in a.T:
        shared = (b == column[:, None]).any(axis=1)
        low[shared] = np.minimum(low[shared], column[shared])
    return low


def small_links(units: np.ndarray, copies: np.ndarray, codes: np.ndarray, group: np.ndarray, cells: Cells, cosine: float):
    """Links of many small groups (runs of equal group numbers), as :func:`group_links`, all groups together."""
    found_a, found_b = [], []
    for d in range(1, _SMALL):
        if len(units) <= d:
            break
        at = np.flatnonzero(group[d:] == group[:-d])
        hit = at[cosines(units[at], units[at + d]) >= cosine]
        found_a.append(hit)
        found_b.append(hit + d)
    counts = np.zeros(len(units), np.int64)
    if not found_a:
        return counts, np.zeros((0, 2), np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    rows, place = np.unique(np.r_[a, b], return_inverse=True)
    if len(rows):
        own = cells(units[rows])
        first = _first_shared(own[place[: len(a)]], own[place[len(a) :]]) == codes[a]
        np.add.at(counts, a[first], copies[b[first]])
        np.add.at(counts, b[first], copies[a[first]])
    return counts, np.stack([a, b], axis=1)


_OUT = "linked boolean, a bigint, b bigint"
_KEY = ("code", "lo", "hi")


def _comparer(options: tuple, cosine: float):
    """Sorted (code, lo, hi, part, node, copies, vec) rows to links (a, b) and counts (node, partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables(*options)
        for groups in _whole(batches):
            sizes = _sizes(groups.column("vec"))
            for dims in np.unique(sizes).tolist():
                rows = groups if len(groups) == (sizes == dims).sum() else groups.take(pa.array(np.flatnonzero(sizes == dims)))
                yield from settle(rows, tables[dims])

    def settle(rows: pa.RecordBatch, cells: Cells) -> Iterator[pa.RecordBatch]:
        columns = {c: long_array(rows.column(c)) for c in (*_KEY, "part", "node", "copies")}
        nodes, copies, codes = columns["node"], columns["copies"], columns["code"]
        starts = np.flatnonzero(_changes(columns))
        sizes = np.diff(np.r_[starts, len(nodes)])
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat((sizes <= _SMALL) & (columns["lo"] == columns["hi"])[starts], sizes)
        vectors = rows.column("vec")
        at = np.flatnonzero(small)
        step = max(_SMALL, _SLICE // cells.dims)
        while len(at):  # whole groups, about a slice at a time
            end = len(at) if len(at) <= step else int(np.searchsorted(codes[at], codes[at[step]], side="left")) or step
            part, at = at[:end], at[end:]
            units = unit(_matrix(vectors.take(pa.array(part)), cells.dims))
            yield from out(nodes[part], *small_links(units, copies[part], codes[part], group[part], cells, cosine))
        for start, size in zip(starts.tolist(), sizes.tolist()):
            if small[start]:
                continue
            part = slice(start, start + size)
            side = (columns["part"][part] != columns["part"][start]).astype(np.int64)
            if columns["lo"][start] != columns["hi"][start] and not side.any():
                continue
            units = unit(_matrix(vectors.slice(start, size), cells.dims))
            yield from out(nodes[part], *group_links(units, side, copies[part], int(codes[start]), cells, cosine))

    def out(nodes: np.ndarray, counts: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = counts > 0
        for linked, a, b in ((True, nodes[links[:, 0]], nodes[links[:, 1]]), (False, nodes[some], counts[some])):
            if len(a):
                flags = pa.array(np.full(len(a), linked))
                yield pa.RecordBatch.from_arrays([flags, pa.array(a), pa.array(b)], names=["linked", "a", "b"])

    return run


def _changes(columns: dict) -> np.ndarray:
    """Where a new (code, lo, hi) begins."""
    new = np.ones(len(columns["code"]), bool)
    new[1:] = False
    for c in _KEY:
        new[1:] |= columns[c][1:] != columns[c][:-1]
    return new


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no (code, lo, hi) is split; a group is bounded."""
    rest: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.concat_batches(parts)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = {c: batch.column(c)[-1] for c in _KEY}
        if rest and all(rest[0].column(c)[-1] == last[c] == batch.column(c)[0] for c in _KEY):
            rest.append(batch)
            continue
        both = joined([*rest, batch])
        cut = int(np.flatnonzero(_changes({c: long_array(both.column(c)) for c in _KEY}))[-1])
        if cut:
            yield both.slice(0, cut)
        rest = [joined([both.slice(cut)])]
    if rest:
        yield joined(rest)


def _meetings(codes: DataFrame, nodes: DataFrame, held: int) -> DataFrame:
    """Rows of the groups to compare: members of shared cells with their vectors, crowded cells cut into block pairs."""
    shared = codes.groupBy("code").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(codes.join(shared, "code"), "lattice-members")
    rows = members.join(nodes.select("node", "copies", "vec"), "node")
    cut = rows.withColumn("blocks", F.expr(f"cast(ceil(n * size(vec) / {held}) as bigint)"))
    cut = cut.withColumn("part", F.expr("pmod(xxhash64(node), blocks)"))
    # In a block's own pair lo = hi; with each other block it forms one pair more.
    pairs = cut.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return pairs.select("code", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "copies", "vec")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cosine: float = COSINE,
    tables: int = TABLES,
    probes: int = PROBES,
    scale: float = SCALE,
    held: int = HELD,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    ``n_links`` counts the other rows whose vector is linked directly, ``component_id`` is
    the least id reachable over links, the row's own included, and ``kept`` marks the rows
    that carry it. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and so do vectors of different lengths. Repeated rows
    and equal vectors are rows like any other and link with each other. A null id is never
    a component's id; a component of null ids alone has a null id and keeps its rows. An
    empty table gives no rows; other columns, whatever their names, are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vec"))
    usable = F.expr(
        "vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x != 0)"
    )
    rows = rows.select("vec_id", F.when(usable, F.col("vec")).alias("vec"))
    distinct = rows.where("vec is not null").groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "lattice-vectors")
    options = (tables, probes, scale)
    codes = materialise(nodes.select("node", "vec").mapInArrow(_coder(options), "code bigint, node bigint"), "lattice-codes")
    groups = _meetings(codes, nodes, held).repartition("code", "lo", "hi").sortWithinPartitions("code", "lo", "hi")
    found = materialise(groups.mapInArrow(_comparer(options, cosine), _OUT), "lattice-links")
    counts = found.where("not linked").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("partners"))
    roots = components(found.where("linked").select("a", "b"))
    rooted = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(ids, "root").select("node", "component_id").join(counts, "node", "left")
    known = nodes.join(classes, "node").select(
        "vec", "component_id", (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), F.lit(True).alias("known")
    )
    return rows.join(known, "vec", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
