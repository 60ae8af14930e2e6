"""SimHash near-duplicates by multi-index hashing.

Fingerprint: a bit is set if it is set in more than half of the XXH64 hashes (seed 42)
of a text's word shingles. Two fingerprints link at ``RADIUS`` or fewer differing bits.

Of 3 differing bits, one 32-bit half holds at most 1. So each half is a table key, and a
fingerprint probes every key within 1 bit of its own half. A bit is only flipped from 1
to 0: of two halves that differ in one bit, exactly one reaches the other. Table rows and
probes of a key meet by a shuffle; inside a key whole 64-bit distances are compared.

A key that gathers more than ``HELD`` fingerprints (near copies share halves) is not
resolved in place: its rows go on to a second level, where a 16-bit quarter of the other
half, again within 1 bit, joins the key. Such a key fixes 48 bits but for 2, so that a
group is bounded. No group's pairs are written out: a breadth-first search compares a
found fingerprint with those not yet reached, and only its tree is emitted.

Exact copies share a fingerprint, and only distinct fingerprints are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallyweave.llm.common import LOWER, long_array, runs, utf8
from tallyweave.llm.graph import components
from tallyweave.sources.scratch import materialise

RADIUS = 3
#: Fingerprints of one key that a task holds before it passes the key to the second level.
HELD = 20_000
_PAIRED = 8
_SEED = 42
_SLICE = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the word shingles, repeats included; a text of fewer words is one shingle."""
    w = utf8(text).translate(LOWER).split()
    if not w:
        return np.zeros(0, "<u8")
    shingles = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(_SEED)), dtype="<u8")


def text_fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit fingerprint; 0 for a text without words."""
    return fingerprint(shingle_hashes(text, words))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; null and empty texts have fingerprint 0."""
    schema = "doc_id bigint, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((text_fingerprint(t, words) for t in batch.column("text").to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, schema)


def _flips(value: str, bits: int) -> str:
    """SQL: ``value`` and the values with one of its set bits cleared."""
    return (
        f"concat(array({value}), transform(filter(sequence(0, {bits - 1}), b -> ({value} & shiftleft(1L, b)) != 0),"
        f" b -> {value} ^ shiftleft(1L, b)))"
    )


def _first_keys(fps: DataFrame) -> DataFrame:
    halves = fps.selectExpr("fp", "fp & 4294967295L as low", "shiftrightunsigned(fp, 32) as high")
    low, high = _flips("low", 32), _flips("high", 32)
    keys = f"concat({low}, transform({high}, v -> v | shiftleft(1L, 32)))"
    return halves.select("fp", F.explode(F.expr(keys)).alias("key"))


def _second_keys(rows: DataFrame) -> DataFrame:
    """The key of the first level, a quarter of the other half, which quarter it is."""
    other = rows.selectExpr(
        "fp", "key", "if((key & shiftleft(1L, 32)) = 0, shiftrightunsigned(fp, 32), fp & 4294967295L) as rest"
    ).selectExpr("fp", "key", "rest & 65535L as q0", "shiftrightunsigned(rest, 16) as q1")
    q0, q1 = _flips("q0", 16), _flips("q1", 16)
    quarter = f"concat({q0}, transform({q1}, v -> v | 65536L))"
    # 33 + 17 bits: the exact pair fits one long.
    return other.select("fp", "key", F.explode(F.expr(quarter)).alias("quarter")).selectExpr(
        "fp", "key * 131072L + quarter as key"
    )


def _tree(fps: np.ndarray) -> list[np.ndarray]:
    """Links (as index pairs) that span each component of distinct fingerprints."""
    left = np.arange(len(fps))
    found_a: list[int] = []
    found_b: list[np.ndarray] = []
    while len(left):
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            node = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[node]) <= RADIUS
            if near.any():
                got = left[near]
                found_a.append(node)
                found_b.append(got)
                queue.extend(got.tolist())
                left = left[~near]
    if not found_a:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return [np.repeat(np.array(found_a), [len(b) for b in found_b]), np.concatenate(found_b)]


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal keys; ``fps`` is unsigned and sorted within a run."""
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])] if len(keys) else np.zeros(0, bool)
    keys, fps = keys[fresh], fps[fresh]
    starts, sizes = runs(keys)
    out_a, out_b = [], []
    small = np.repeat((sizes > 1) & (sizes <= _PAIRED), sizes)
    k, f = keys[small], fps[small]
    for d in range(1, _PAIRED):
        if len(k) <= d:
            break
        hit = (k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= RADIUS)
        out_a.append(f[d:][hit])
        out_b.append(f[:-d][hit])
    for at, n in zip(starts[sizes > _PAIRED], sizes[sizes > _PAIRED]):
        own = fps[at : at + n]
        a, b = _tree(own)
        out_a.append(own[a])
        out_b.append(own[b])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


_OUT = "pending boolean, a bigint, b bigint"


def _out(pending: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(a), pending)), pa.array(a.astype(np.int64, copy=False)), pa.array(b.astype(np.int64, copy=False))]
    return pa.RecordBatch.from_arrays(arrays, names=["pending", "a", "b"])


def _resolver(held: int | None):
    """Links of sorted (key, fp) rows; a key beyond ``held`` comes out as pending rows (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passed: int | None = None  # the key that is passed on
        for batch in batches:
            k, f = long_array(batch.column("key")), long_array(batch.column("fp"))
            if passed is not None:
                n = int(np.searchsorted(k, passed, side="right"))
                if n:
                    yield _out(True, k[:n], f[:n])
                    k, f = k[n:], f[n:]
                if len(k):
                    passed = None
            if not len(k):
                continue
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut:
                yield from settle(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if held is not None and len(keys) > held:
                passed = int(keys[-1])
                yield _out(True, keys, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from settle(keys, fps)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if held is not None:
            starts, sizes = runs(keys)
            large = np.repeat(sizes > held, sizes)
            if large.any():
                yield _out(True, keys[large], fps[large])
                keys, fps = keys[~large], fps[~large]
        a, b = bucket_links(keys, fps.view(np.uint64))
        if len(a):
            yield _out(False, a.view(np.int64), b.view(np.int64))

    return run


def links(fps: DataFrame, held: int = HELD) -> DataFrame:
    """``fp`` (distinct longs) to links ``(a, b)`` that join exactly the true components."""
    rows = _first_keys(fps).repartition("key").sortWithinPartitions("key", "fp")
    first = materialise(rows.mapInArrow(_resolver(held), _OUT), "simhash-links")
    pending = first.where("pending").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    second = _second_keys(pending).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_resolver(None), _OUT)
    return first.where("not pending").select("a", "b").unionAll(second.select("a", "b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, held: int = HELD
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the least id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link like any other. A null id keeps
    its row and its links, and is never a component's id; a component of null ids alone
    has a null id. Repeated rows and ties come out as often as they come in. An empty
    table gives no rows; other columns, whatever their names, are not read.
    """
    hashed = materialise(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), held))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return hashed.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without those whose component holds a smaller id.

    Rows with a null id cannot be named and stay; repeated rows of a kept id all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), **options)
    losers = found.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
