"""Repeated passages by sparse suffix arrays.

A passage counts when ``length`` or more words in a row occur at two places of different
documents, or twice in one. Every window of ``length`` words holds ``length - gram + 1``
word grams; the leftmost least hash among them is its minimiser. Two equal windows select
the same place, so it is enough to keep the suffixes that start at selected places, about
two of every ``length - gram + 2``.

1. Anchors: each selected place with the hash of its gram (the head of its suffix), of
   everything its windows span (the rest that matters), its document and its run of windows.
   Exact copies of a text are one text.
2. The suffixes are sorted over the whole cluster by head, rest and place, and neighbours
   compared. A suffix without an equal head beside it is alone; one with an equal rest is
   settled: all its windows repeat. The ends of a partition, whose neighbours lie in
   another, stay open. Sorting by range splits a passage that many documents share.
3. Open suffixes, and the first of each settled group, are extended left and right: every
   window around the anchor is looked up by hash, and those found at two places repeat.
4. Repeating windows are merged to word ranges.

All hashes are compared in pairs (head and rest, head and window): 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import long_array, utf8
from tallyweave.sources.scratch import materialise

LENGTH = 50
GRAM = 25
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ANCHOR = "head bigint, rest bigint, text_key bigint, doc_id bigint, place bigint"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHashes:
    """Hashes of word ranges of one text, from prefix sums."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        values = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=n)
        power = np.cumprod(np.full(n + 1, _BASE), dtype=np.uint64)
        self._undo = np.cumprod(np.full(n + 1, _BASE_INV), dtype=np.uint64)
        self._sums = np.r_[np.uint64(0), np.cumsum(values * power[:n], dtype=np.uint64)]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sums[end] - self._sums[start]) * self._undo[start])


def _heads(words: WordHashes, n: int, gram: int) -> np.ndarray:
    at = np.arange(n - gram + 1)
    return words.ranges(at, at + gram)


def text_anchors(words: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """(head, rest, first window, windows - 1, anchor - first window) per selected place."""
    n = len(words)
    if n < length:
        return None
    hashed = WordHashes(words)
    heads = _heads(hashed, n, gram)
    grams = length - gram + 1
    picked = np.arange(n - length + 1) + np.lib.stride_tricks.sliding_window_view(heads, grams).argmin(axis=1)
    first = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
    last = np.r_[first[1:], len(picked)] - 1
    place = picked[first]
    whole = hashed.ranges(first, last + length)
    # The same words, but other windows, are another rest.
    rest = _mix(whole ^ ((last - first) * 64 + (place - first) + 1).astype(np.uint64))
    return heads[place], rest, first, last - first, place - first


def _packed(first: np.ndarray, more: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 24) | (more.astype(np.int64) << 12) | shift.astype(np.int64)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 12) & 4095, place & 4095


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Selected suffixes of every distinct text, under the least id that has the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = long_array(batch.column("doc_id")), long_array(batch.column("text_key"))
            parts: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = text_anchors(utf8(text).split(), length, gram)
                if found is None:
                    continue
                head, rest, first, more, shift = found
                size = len(head)
                parts.append((head, rest, np.full(size, keys[i]), np.full(size, ids[i]), _packed(first, more, shift)))
                held += size
                if held > 100_000:
                    yield out(parts)
                    parts, held = [], 0
            if parts:
                yield out(parts)

    def out(parts: list[tuple]) -> pa.RecordBatch:
        head, rest, key, doc, place = (np.concatenate(c) for c in zip(*parts))
        return _batch({"head": head.view(np.int64), "rest": rest.view(np.int64), "text_key": key, "doc_id": doc, "place": place})

    every = docs.mapInArrow(run, _ANCHOR)
    return every.groupBy("head", "rest", "text_key", "place").agg(F.min("doc_id").alias("doc_id")).select("head", "rest", "text_key", "doc_id", "place")


def neighbours(sorted_anchors: DataFrame) -> DataFrame:
    """Suffixes with an equal head beside them: ``text_key, doc_id, place, settled, look``.

    ``settled``: a neighbour has the same rest. ``look``: its windows are to be looked up.
    """

    def judge(
        head: np.ndarray, rest: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, edge_first: bool, edge_last: bool, keep: slice
    ):
        n = len(head)
        same_head, same_rest = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        same_head[1:n] = head[1:] == head[:-1]
        same_rest[1:n] = same_head[1:n] & (rest[1:] == rest[:-1])
        near = same_head[:n] | same_head[1:]
        settled = same_rest[:n] | same_rest[1:]
        look = near & (~settled | ~same_rest[:n])
        if edge_first:
            near[0] = look[0] = True
        if edge_last:
            near[-1] = look[-1] = True
        pick = np.zeros(n, bool)
        pick[keep] = True
        pick &= near
        return _batch({"text_key": key[pick], "doc_id": doc[pick], "place": place[pick], "settled": settled[pick], "look": look[pick]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two rows are held back: the last one is judged with its follower at hand.
        held = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [long_array(batch.column(c)) for c in ("head", "rest", "text_key", "doc_id", "place")]
            fresh = held is None
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            n = len(columns[0])
            begin = 0 if first else 1
            if n - 1 > begin:
                yield judge(*columns, edge_first=first, edge_last=False, keep=slice(begin, n - 1))
                first = False
                held = [c[-2:] for c in columns]
            elif fresh or first:
                held = columns
            else:
                held = columns
        if held is not None:
            yield judge(*held, edge_first=first, edge_last=True, keep=slice(0 if first else 1, None))

    return sorted_anchors.mapInArrow(run, "text_key bigint, doc_id bigint, place bigint, settled boolean, look boolean")


def windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``(doc_id, text, places)`` to ``(head, window, at struct<doc_id, start>)`` of every window around the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = long_array(batch.column("doc_id"))
            texts, places = batch.column("text"), batch.column("places")
            for i in range(batch.num_rows):
                words = utf8(texts[i].as_py()).split()
                first, more, shift = _unpacked(np.array(places[i].as_py(), dtype=np.int64))
                hashed = WordHashes(words)
                starts = np.repeat(first, more + 1) + _within(more + 1)
                anchor = np.repeat(first + shift, more + 1)
                yield _batch(
                    {
                        "head": hashed.ranges(anchor, anchor + gram).view(np.int64),
                        "window": hashed.ranges(starts, starts + length).view(np.int64),
                        "doc_id": np.full(len(starts), ids[i]), "start": starts.astype(np.int64),
                    }
                )

    found = docs.mapInArrow(run, "head bigint, window bigint, doc_id bigint, start bigint")
    return found.select("head", "window", F.struct("doc_id", "start").alias("at"))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of some groups."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


_RANGES = "array<struct<a: bigint, b: bigint>>"


def _merge(found: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` with unordered, overlapping ``array<struct<a, b, later>>`` to merged ranges."""

    def merged(a: np.ndarray, b: np.ndarray) -> list[dict]:
        if not len(a):
            return []
        order = np.argsort(a, kind="stable")
        a, b = a[order], np.maximum.accumulate(b[order])
        new = np.r_[True, a[1:] > b[:-1]]
        ends = b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
        return [{"a": int(x), "b": int(y)} for x, y in zip(a[new], ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            spans = batch.column("spans")
            values, at = spans.values, spans.offsets.to_numpy()
            a, b = long_array(values.field("a")), long_array(values.field("b"))
            later = values.field("later").to_numpy(zero_copy_only=False).astype(bool)
            repeated, surplus = [], []
            for i, j in zip(at[:-1], at[1:]):
                repeated.append(merged(a[i:j], b[i:j]))
                surplus.append(merged(a[i:j][later[i:j]], b[i:j][later[i:j]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(repeated, kind), pa.array(surplus, kind)], names=["doc_id", "repeated", "surplus"]
            )

    return found.mapInArrow(run, f"doc_id bigint, repeated {_RANGES}, surplus {_RANGES}")


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, repeated, surplus)``: word ranges (end exclusive), one row per document with any.

    ``repeated`` are all words inside passages of ``length`` or more words that occur at
    another place too; ``surplus`` those of occurrences after the first (least id, then
    least position), which a deduplicated corpus would leave out. Words are runs of
    non-white characters, compared exactly.

    Null and empty texts, and texts under ``length`` words, have no passages. Rows with
    the same id are one document, whose ranges are those of all its texts together:
    repeated rows do not repeat each other. Rows without
    an id cannot be named and are left out. Empty tables give no rows; other columns are
    not read.
    """
    if not 0 < gram <= length < 4096:
        raise ValueError("0 < gram <= length < 4096 is needed")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    keyed = source.select("doc_id", F.xxhash64(F.lit("passages"), "text").alias("text_key"), "text")
    kept = materialise(anchors(keyed, length, gram), "anchors")
    order = ("head", "rest", "doc_id", "place", "text_key")
    ordered = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    near = materialise(neighbours(ordered), "anchor-neighbours")

    # Rows of one id may have different texts: a place belongs to one of them.
    places = near.where("look").groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"))
    held = keyed.join(places, ["doc_id", "text_key"]).select("doc_id", "text", "places")
    looked = materialise(windows(held, length, gram), "windows")
    firsts = looked.groupBy("head", "window").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low <> high")
    hits = looked.join(firsts.select("head", "window", "low"), ["head", "window"])
    open_spans = hits.select(
        F.col("at.doc_id").alias("doc_id"),
        F.struct(F.col("at.start").alias("a"), (F.col("at.start") + length).alias("b"), (F.col("at") != F.col("low")).alias("later")).alias("span"),
    )
    # Settled suffixes repeat in any case; those that were not looked up have an equal one before them.
    start, more = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(F.lit(4095))
    settled = near.where("settled").select(
        "doc_id", F.struct(start.alias("a"), (start + more + length).alias("b"), (~F.col("look")).alias("later")).alias("span")
    )

    # Exact copies: the whole text repeats, and is surplus but for the least id.
    size = F.size(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")).cast("bigint")
    texts = keyed.select("doc_id", F.struct("text_key", F.xxhash64(F.lit(1), "text").alias("k2"), F.length("text").alias("chars")).alias("key"), size.alias("n"))
    texts = materialise(texts, "text-keys").where(F.col("n") >= length)
    copied = texts.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    whole = texts.join(copied, "key").select(
        "doc_id", F.struct(F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"), (F.col("doc_id") > F.col("least")).alias("later")).alias("span")
    )
    spans = open_spans.unionAll(settled).unionAll(whole).groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    return _merge(spans)
