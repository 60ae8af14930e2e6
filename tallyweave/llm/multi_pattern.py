"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of ``WINDOW`` consecutive words. All patterns of one
length share a shift table: for every block of two words, how far the search may move on
before a pattern can end there. A block that occurs in no pattern skips the whole window.
Where the shift is 0, the block's bucket, keyed by the block that starts the window, names
the windows that are compared word by word. Windows of shorter items have tables of their own.

The patterns are broadcast, at most ``PATTERNS_PER_PASS`` at once; more patterns are dealt
over several passes by hash, whose hits are combined per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallyweave.llm.common import LOWER, utf8
from tallyweave.sources.scratch import materialise

WINDOW = 10
#: Windows in one broadcast table (about 150 bytes each).
PATTERNS_PER_PASS = 500_000
#: Digits, letters and every non-ASCII byte belong to words; A-Z is lower-cased.
_WORD_BYTES = bytes(
    LOWER[b] if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def text_words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` words; fewer words, but not none, are one window."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return list(zip(*(words[i:] for i in range(size))))


class Matcher:
    """Wu-Manber tables of equally long word windows."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.size = len(patterns[0])
        self.block = min(2, self.size)
        self.skip = self.size - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(lambda: defaultdict(list))
        for number, words in enumerate(patterns):
            for end in range(self.block, self.size + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.skip), self.size - end)
            self.bucket[words[-self.block :]][words[: self.block]].append((words, number))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        found = []
        shift, skip, size, block = self.shift.get, self.skip, self.size, self.block
        end, last = size, len(words)
        while end <= last:
            suffix = tuple(words[end - block : end])
            step = shift(suffix, skip)
            if step:
                end += step
                continue
            start = end - size
            for pattern, number in self.bucket[suffix].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == pattern:
                    found.append((start, number))
            end += 1
        return found


class Patterns:
    """All windows of some items: one matcher per window length, and each window's items."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, window in rows:
            owners[tuple(window.split(b" "))].add(item)
        by_size = defaultdict(list)
        for w in owners:
            by_size[len(w)].append(w)
        self.parts = [(Matcher(ws), [owners[w] for w in ws]) for _, ws in sorted(by_size.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges and the items found."""
        ranges, items = [], set()
        for matcher, owners in self.parts:
            for start, number in matcher.find(words):
                ranges.append((start, start + matcher.size))
                items |= owners[number]
        items.discard(None)
        return ranges, items


_FOUND = "doc_id bigint, n_words bigint, starts array<int>, ends array<int>, items array<string>"


def _merged(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(ranges):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _window_rows(benchmark: DataFrame, size: int) -> DataFrame:
    """``(item, window)``: distinct windows, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                for w in set(windows(text_words(text), size)):
                    items.append(item)
                    rows.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(rows, pa.binary())], names=["item", "window"])

    source = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return source.mapInArrow(run, "item string, window binary").distinct()


def _search(docs: DataFrame, patterns: Patterns, columns: list[str]) -> DataFrame:
    """One pass: every document row with its merged hit ranges and items."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            counts, starts, ends, items = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text_words(text)
                ranges, found = known.search(words)
                a, b = _merged(ranges)
                counts.append(len(words))
                starts.append(a)
                ends.append(b)
                items.append(sorted(found))
            arrays = [batch.column(c) for c in columns] + [
                pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "n_words", "starts", "ends", "items"])

    added = StructType.fromDDL("n_words bigint, starts array<int>, ends array<int>, items array<string>")
    return docs.mapInArrow(run, StructType([docs.schema[c] for c in columns] + added.fields))


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, per_pass: int = PATTERNS_PER_PASS) -> DataFrame:
    """``(doc_id, n_words, ranges array<struct<a, b>>, items array<string>)`` per document row.

    ``ranges`` are the word ranges (end exclusive) covered by occurrences, merged;
    ``items`` the ids, as strings and sorted, of items with an occurring window. Null and
    empty texts have no words. An item without an id still marks words but is not listed.
    Repeated document rows are searched each; repeated items count once. Empty documents
    give no rows, an empty benchmark no hits; other columns are not read.
    """
    return _searched(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", benchmark, size, per_pass)


def _searched(narrow: DataFrame, ride: str, benchmark: DataFrame, size: int = WINDOW, per_pass: int = PATTERNS_PER_PASS) -> DataFrame:
    """``search`` over ``(ride, text)`` rows; the column ``ride``, of any type, rides along."""
    rows = materialise(_window_rows(benchmark, size), "benchmark-windows")
    passes = max(1, -(-rows.count() // per_pass))
    if passes == 1:
        found = _search(narrow, Patterns([tuple(r) for r in rows.collect()]), [ride])
        return found.select(ride, "n_words", F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b")).alias("ranges"), "items")
    # A row number per document row, fixed by writing it, brings the passes together.
    keyed = materialise(narrow.withColumn("row", F.monotonically_increasing_id()), "documents-keyed")
    parts = []
    for p in range(passes):
        own = rows.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == p)
        parts.append(_search(keyed, Patterns([tuple(r) for r in own.collect()]), ["row", ride]))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionAll(more)
    joined = every.groupBy("row").agg(
        F.first(ride).alias(ride), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("a"), F.col("ends").alias("b"))))).alias("r"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.expr(
        "aggregate(r, cast(array() as array<struct<a: int, b: int>>), (m, x) -> if(size(m) > 0 and x.a <= m[size(m) - 1].b,"
        " concat(slice(m, 1, size(m) - 1), array(struct(m[size(m) - 1].a as a, greatest(m[size(m) - 1].b, x.b) as b))),"
        " concat(m, array(struct(x.a as a, x.b as b)))))"
    )
    return joined.select(ride, "n_words", merged.alias("ranges"), "items")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``search`` with ``n_hit``, ``n_items`` and ``contaminated``."""
    return search(docs, benchmark, **options).select(
        "*",
        F.expr("aggregate(ranges, 0L, (s, x) -> s + x.b - x.a)").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns.

    Each row is judged on its own text; ids, null or repeated, play no part.
    """
    # The document rides along as one column, so that no name can clash.
    whole = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return _searched(whole, "_row", benchmark, **options).where("size(ranges) = 0").select("_row.*")
