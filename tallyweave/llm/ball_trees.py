"""Ranked lexical search: exact maximum inner products by sparse ball trees.

A score is an inner product: the item gives each of its terms a whole weight times its
repeats, the document gives it a whole saturation of the term's occurrences. Documents are
reduced to the terms that occur in the items, since no other term adds to a score, and
written as sparse rows, with which the corpus statistics are counted.

A task takes its rows tree by tree. A ball tree halves its documents along the line
between two that lie far apart, down to leaves of ``LEAF``. A node has the centroid of its
documents and, for each of ``GROUPS`` groups of terms, the radius around it, in units in
which a term counts by its weight. By Cauchy and Schwarz no document of a node scores more
than the centroid's product plus, over the groups, the item's norm times the radius.
Subtrees are taken best first, and one whose bound lies under the item's last place so far
is left out; the places are kept from tree to tree. Bounds are rounded up by more than
doubles can lose, so that pruning never drops a document, and leaves are scored in whole
numbers. Each task gives its own first documents of each item, and these are ranked.

Items are searched in blocks whose number of terms is bounded, each against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.llm.common import LOWER, long_array, utf8
from tallyweave.sources.scratch import materialise

FIRST = 20
#: Documents in one tree, and the cells of its dense matrix at most.
TREE = 1024
CELLS = 1 << 21
LEAF = 4
GROUPS = 2048
#: Terms of one block of items, repeats in different items included; about 100 bytes each in a task.
BLOCK_TERMS = 1 << 18
#: A bound is raised by this share of itself; doubles lose less than 10^-10 of it.
_SAFE = 1e-7
_NO_ID = 1 << 63
#: Bytes of terms: digits, letters, and all that is not ASCII.
_TERM_BYTES = bytes(
    LOWER[b] if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def text_terms(text: str | None) -> list[bytes]:
    return utf8(text).translate(_TERM_BYTES).split()


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, item_id, terms, repeats)``: an item's distinct terms; ``item`` numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, repeats = [], []
            for text in batch.column("text").to_pylist():
                found: dict[bytes, int] = {}
                for term in text_terms(text):
                    found[term] = found.get(term, 0) + 1
                terms.append(list(found))
                repeats.append(list(found.values()))
            arrays = [batch.column("item"), batch.column("item_id")]
            arrays += [pa.array(terms, pa.list_(pa.binary())), pa.array(repeats, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "item_id", "terms", "repeats"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    numbered = materialise(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    return numbered.mapInArrow(run, f"item bigint, item_id {kind}, terms array<binary>, repeats array<bigint>")


def item_block(rows) -> tuple[dict, list, list, list]:
    """A block of items over its own vocabulary: term numbers, then each item's row, terms and repeats."""
    numbers: dict[bytes, int] = {}
    terms = [np.array([numbers.setdefault(bytes(t), len(numbers)) for t in row["terms"]], np.int64) for row in rows]
    return numbers, [row["item"] for row in rows], terms, [np.array(row["repeats"], np.int64) for row in rows]


def _sparse(vocabulary):
    """(doc_id, text) to (doc_id, n, terms, times) of the documents with a term; terms are the vocabulary's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            ids, sizes, ends, terms, times = [], [], [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text_terms(text)
                if not words:
                    continue
                known = [x for x in map(number, words) if x is not None]
                own, count = np.unique(np.array(known, np.int64), return_counts=True)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.append(own)
                times.append(count)
                ends.append(ends[-1] + len(own))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(terms))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(times))),
                ],
                names=["doc_id", "n", "terms", "times"],
            )

    return run


def _frequencies(size: int):
    """Sparse rows to (term, df), a task's documents added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(long_array(batch.column("terms").flatten()), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], names=["term", "df"])

    return run


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def saturated(times: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's share of a term's score; below 10^6."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class BallTree:
    """Documents as rows of ``values`` (whole numbers), with the bounds of every node."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, starts: np.ndarray, leaf: int = LEAF):
        """``starts``: where each group of terms begins among the columns; empty groups are left out."""
        self.values = values.astype(np.float32, copy=False)  # whole numbers below 2^24: nothing is lost
        self.weights, self.starts, self.leaf = weights, starts, leaf
        self.scaled = values * weights
        self.squares = np.einsum("ij,ij->i", self.scaled, self.scaled)
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        most = 2 * len(values)  # a leaf has two documents or more, unless it is the only one
        self.centroids = np.zeros((most, values.shape[1]), np.float32)
        self.radii = np.zeros((most, len(starts)))
        self._build(np.arange(len(values)))
        self.centroids, self.radii = self.centroids[: len(self.rows)], self.radii[: len(self.rows)]
        del self.scaled, self.squares

    def _build(self, rows: np.ndarray) -> int:
        """The node of some documents and all below it; any point serves as centroid, so rounding it is safe."""
        at = len(self.rows)
        self.rows.append(rows)
        self.children.append(None)
        self.centroids[at] = self.values[rows].mean(axis=0, dtype=np.float64)
        centre = self.centroids[at] * self.weights
        if len(rows) <= self.leaf:
            away = self.scaled[rows] - centre
            self.radii[at] = np.sqrt(np.add.reduceat(away * away, self.starts, axis=1).max(axis=0))
            return at
        first, second = self._halves(rows)
        self.children[at] = (self._build(first), self._build(second))
        # A node's documents lie no further off than a child's centroid and its radius together.
        for child in self.children[at]:
            apart = self.centroids[child] * self.weights - centre
            reach = np.sqrt(np.add.reduceat(apart * apart, self.starts)) + self.radii[child]
            self.radii[at] = np.maximum(self.radii[at], reach)
        return at

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two halves along the line between the document furthest from the first and the one furthest from that."""
        points, squares = self.scaled[rows], self.squares[rows]
        a = points[(squares - 2 * (points @ points[0])).argmax()]
        b = points[(squares - 2 * (points @ a)).argmax()]
        order = np.argsort(points @ (b - a), kind="stable")
        half = len(rows) // 2
        return rows[order[:half]], rows[order[half:]]

    def bounds(self, products: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What no document of a node exceeds: (items, nodes); ``products`` weigh terms, ``norms`` groups."""
        raw = products @ self.centroids.T + norms @ self.radii.T
        return raw * (1 + _SAFE) + 1


class Places:
    """An item's first documents so far."""

    def __init__(self, first: int):
        self.first = first
        self.heap: list[tuple[int, int]] = []  # (score, -doc_id), the last place on top

    @property
    def least(self) -> int:
        """A score under this one cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.first else 1

    def add(self, score: int, doc_id: int) -> None:
        if len(self.heap) < self.first:
            heapq.heappush(self.heap, (score, -doc_id))
        else:
            heapq.heappushpop(self.heap, (score, -doc_id))


def search(tree: BallTree, ids: list[int], bounds: np.ndarray, columns: np.ndarray, factors: np.ndarray, places: Places) -> int:
    """Best-first search of one item; the number of documents that were scored."""
    queue = [(-bounds[0], 0)]
    scored = 0
    while queue and -queue[0][0] >= places.least:
        node = heapq.heappop(queue)[1]
        if tree.children[node] is None:
            rows = tree.rows[node]
            scored += len(rows)
            scores = tree.values[np.ix_(rows, columns)].astype(np.int64) @ factors
            for at in np.flatnonzero(scores >= places.least).tolist():
                places.add(int(scores[at]), ids[rows[at]])
            continue
        for child in tree.children[node]:
            if bounds[child] >= places.least:
                heapq.heappush(queue, (-bounds[child], child))
    return scored


def _searcher(block, weights: np.ndarray, n_docs: int, n_terms: int, first: int, tree_docs: int):
    """Sparse rows to (item, doc_id, score): each item's first documents of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, item_terms, repeats = block.value
        places = [Places(first) for _ in named]
        held: list[tuple] = []
        cells = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            sizes = long_array(batch.column("n"))
            ends = batch.column("terms").offsets.to_numpy()
            terms, times = long_array(batch.column("terms").values), long_array(batch.column("times").values)
            for row, doc_id in enumerate(ids):
                part = slice(ends[row], ends[row + 1])
                if part.start == part.stop:
                    continue  # without any item's term: its scores are 0
                cells += part.stop - part.start
                held.append((_NO_ID if doc_id is None else doc_id, sizes[row], terms[part], times[part]))
                if len(held) == tree_docs or len(held) * min(cells, len(weights)) > CELLS:
                    _search_tree(held, item_terms, repeats, weights, n_docs, n_terms, places)
                    held, cells = [], 0
        if held:
            _search_tree(held, item_terms, repeats, weights, n_docs, n_terms, places)
        found = [(item, None if -key == _NO_ID else -key, score) for item, own in zip(named, places) for score, key in own.heap]
        columns = zip(*found) if found else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def _search_tree(
    held: list[tuple], item_terms: list, repeats: list, weights: np.ndarray, n_docs: int, n_terms: int, places: list[Places]
) -> int:
    """All items against one tree of documents; the number of document scores that were computed."""
    counts = np.array([len(t) for _, _, t, _ in held])
    terms = np.concatenate([t for _, _, t, _ in held])
    times = np.concatenate([f for _, _, _, f in held])
    n = np.repeat(np.array([size for _, size, _, _ in held], np.int64), counts)
    # The columns are the terms that occur here, group by group.
    used = np.unique(terms)
    group = used % GROUPS
    order = np.argsort(group, kind="stable")
    used, group = used[order], group[order]
    column = np.full(len(weights), -1)
    column[used] = np.arange(len(used))
    values = np.zeros((len(held), len(used)), np.float32)
    values[np.repeat(np.arange(len(held)), counts), column[terms]] = saturated(times, n, n_docs, n_terms)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    tree = BallTree(values, weights[used].astype(np.float64), starts)
    ids = [doc_id for doc_id, _, _, _ in held]

    own = [column[t] for t in item_terms]
    here = [c >= 0 for c in own]
    scored = 0
    step = max(1, CELLS // max(len(used), len(tree.rows)))
    for at in range(0, len(own), step):
        part = range(at, min(at + step, len(own)))
        products = np.zeros((len(part), len(used)))
        squares = np.zeros((len(part), len(used)))
        for i, item in enumerate(part):
            columns, times_wanted = own[item][here[item]], repeats[item][here[item]]
            products[i, columns] = times_wanted * weights[used[columns]]
            squares[i, columns] = times_wanted.astype(np.float64) ** 2
        bounds = tree.bounds(products, np.sqrt(np.add.reduceat(squares, starts, axis=1)))
        for i, item in enumerate(part):
            columns = own[item][here[item]]
            if len(columns):
                factors = repeats[item][here[item]] * weights[used[columns]]
                scored += search(tree, ids, bounds[i], columns, factors, places[item])
    return scored


def ranked(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    first: int = FIRST,
    block_terms: int = BLOCK_TERMS,
    tree_docs: int = TREE,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``first`` documents with a score above 0.

    Equal scores are ranked by ascending id, a null id last. Every document row with a term
    counts, repeated rows too, each in a place of its own; null and empty texts have no
    terms. Repeated item rows are ranked each for itself; an item without terms, or whose
    terms no document holds, has no rows. Empty tables give none. Other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = materialise(_items(items, item_col, item_text_col), "item-terms")
    total = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_terms))
    found = None
    for number in range(blocks):
        some = wanted.where(F.expr(f"pmod(xxhash64(item), {blocks}) = {number}"))
        block = item_block(some.select("item", "terms", "repeats").collect())  # bounded by block_terms
        places = _block_places(spark, rows, block, first, tree_docs, str(number))
        found = places if found is None else found.unionAll(places)
    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= first)
    return best.join(wanted.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _block_places(spark, rows: DataFrame, block: tuple, first: int, tree_docs: int, label: str) -> DataFrame:
    size = max(1, len(block[0]))
    vocabulary = spark.sparkContext.broadcast(block[0])
    schema = "doc_id bigint, n bigint, terms array<bigint>, times array<bigint>"
    sparse = materialise(rows.mapInArrow(_sparse(vocabulary), schema), f"sparse-{label}")
    n_docs, n_terms = sparse.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    counted = sparse.select("terms").mapInArrow(_frequencies(size), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for row in counted.collect():  # a row per term of the block
        df[row["term"]] = row["df"]
    searcher = _searcher(spark.sparkContext.broadcast(block[1:]), term_weights(df, n_docs), n_docs, max(1, n_terms), first, tree_docs)
    return materialise(sparse.mapInArrow(searcher, "item bigint, doc_id bigint, score bigint"), f"places-{label}")
