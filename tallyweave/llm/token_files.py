"""Token ids in ORC files: encode, write in id order, read back, prune by stripe and Bloom filter.

Documents are range-partitioned and sorted by id, encoded in Arrow batches, and written by
Spark's ORC writer: ids as run-length coded integers, a row index per ``ROW_INDEX`` rows
and a Bloom filter on the document id. Each file holds one id range, so minimum, maximum
and Bloom filter let a reader skip files, stripes and row groups; stripes are read in
parallel. A document's global start is its start within its part, which the files hold,
plus the tokens of earlier parts, a sum over one row per part.

Encoding: the tokenizer drops white space and never joins text across it, so a text's ids
are the ids of its white-space separated pieces in a row. Pieces repeat, so each worker
keeps the ids of pieces it has seen.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm.common import LOWER, utf8

ROW_INDEX = 1_000
_TEXTS = 1_000  # texts encoded together
STRIPE_BYTES = 64 << 20
_SCHEMA = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>"
#: Pieces kept per worker, their bytes and ids; all three only bound memory.
_KEPT, _KEPT_BYTES, _KEPT_IDS = 400_000, 24 << 20, 4 << 20
_MARKS = frozenset(b".,;:!?")
_SPACED = bytes(0x20 if b in b" \t\n\x0b\x0c\r" else b for b in range(256))
_LOWERED = LOWER.translate(_SPACED)


class PieceEncoder:
    """A tokenizer with the ids of known pieces; one per worker, through a broadcast.

    The tokenizer lower-cases, and splits letters and digits from other signs. So pieces
    are known in lower case, and one closing mark after an ASCII letter or digit is
    looked up by itself. A text with the start of a special token is left as it is.

    Texts are split and their pieces numbered by Arrow, so that Python sees each piece of a
    batch once. The ids of all known pieces lie in one flat array, from which a batch's are
    gathered. When too much is kept, the half that was not used for longest is forgotten.
    """

    def __init__(self, definition: str):
        self.definition = definition
        self._tokenizer = None
        self._batch = 0
        self._reset([], np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def __reduce__(self):
        return PieceEncoder, (self.definition,)

    def _reset(self, pieces: list[bytes], flat: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> None:
        """Number 0 is the empty piece, which has no ids."""
        self._known = {b"": 0} | dict(zip(pieces, range(1, len(pieces) + 1)))
        self._flat, self._n_ids = flat, len(flat)
        self._sizes, self._last = np.r_[0, sizes], np.r_[0, last]
        self._starts = np.r_[0, np.cumsum(sizes) - sizes]
        self._bytes = sum(map(len, pieces))

    def _forget(self) -> None:
        """Keeps the pieces that were used last."""
        count = len(self._known)
        if count <= _KEPT and self._bytes <= _KEPT_BYTES and self._n_ids <= _KEPT_IDS:
            return
        keep = self._last[:count] > np.median(self._last[1:count])
        keep[0] = False
        numbers = np.flatnonzero(keep)
        pieces = np.array(list(self._known), object)[numbers].tolist()
        self._reset(pieces, self._gathered(numbers)[0], self._sizes[numbers], self._last[numbers])

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered pieces in a row, and where each piece's end."""
        sizes = self._sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.arange(total) + np.repeat(self._starts[numbers] - ends + sizes, sizes)], ends

    def _add(self, pieces: list[bytes], values: list[bytes]) -> None:
        """New pieces with their ids, as little-endian 32-bit integers."""
        first, count = len(self._known), len(self._known) + len(pieces)
        self._known.update(zip(pieces, range(first, count)))
        new = np.frombuffer(b"".join(values), dtype="<i4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        if count > len(self._sizes):
            more = max(count, 2 * len(self._sizes)) - len(self._sizes)
            self._sizes, self._starts, self._last = (np.r_[x, np.zeros(more, np.int64)] for x in (self._sizes, self._starts, self._last))
        if self._n_ids + len(new) > len(self._flat):
            more = max(self._n_ids + len(new), 2 * len(self._flat)) - len(self._flat)
            self._flat = np.r_[self._flat, np.zeros(more, np.int32)]
        self._flat[self._n_ids : self._n_ids + len(new)] = new
        self._sizes[first:count] = sizes
        self._starts[first:count] = self._n_ids + np.cumsum(sizes) - sizes
        self._n_ids += len(new)
        self._bytes += sum(map(len, pieces))

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, which hold no blanks."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            # One thread: the cores belong to Spark's tasks.
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._tokenizer = Tokenizer.from_str(self.definition)
            vocabulary = self._tokenizer.get_vocab()
            self._closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self._closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        if not pieces:
            return []
        encode = self._tokenizer.encode_batch_fast
        texts = b" ".join(pieces).decode("utf-8").split(" ")
        out: list[bytes | None] = [None] * len(texts)
        # A run of letters is one word; many are encoded as one text and cut at word ends.
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(encode([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, dtype="<i4")
            ends = ((np.flatnonzero(self._closes[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                raw, start = ids.tobytes(), 0
                for i, end in zip(part, ends):
                    out[i] = raw[start:end]
                    start = end
        rest = [i for i, v in enumerate(out) if v is None]
        for i, found in zip(rest, encode([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("i", found.ids).tobytes()
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        known = self._known
        marked = [p for p in pieces if p[-1] in _MARKS and p[-2:-1].isalnum()]
        stems = {p[:-1] for p in marked}
        stems.update([p[-1:] for p in marked])
        stems.update(set(pieces).difference(marked))
        fresh = [p for p in stems if p not in known]
        self._add(fresh, self._encode(fresh))
        if marked:
            numbers = np.fromiter((known[x] for p in marked for x in (p[:-1], p[-1:])), np.int64, 2 * len(marked))
            flat, ends = self._gathered(numbers)
            raw, cuts = flat.astype("<i4").tobytes(), [0, *(ends[1::2] * 4).tolist()]
            self._add(marked, [raw[a:b] for a, b in zip(cuts, cuts[1:])])

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        self._forget()
        self._batch += 1
        raws = [utf8(text) for text in texts]
        cut = pc.split_pattern(pa.array([r.translate(_SPACED if b"<|" in r else _LOWERED) for r in raws], pa.binary()), " ")
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        find = self._known.get
        numbers = np.fromiter((find(p, -1) for p in pieces), np.int64, len(pieces))
        fresh = np.flatnonzero(numbers < 0).tolist()
        if fresh:
            self._learn([pieces[i] for i in fresh])
            numbers[fresh] = np.fromiter((find(pieces[i]) for i in fresh), np.int64, len(fresh))
        self._last[numbers] = self._batch
        flat, ends = self._gathered(numbers[coded.indices.to_numpy(zero_copy_only=False)])
        return flat, np.r_[0, ends][cut.offsets.to_numpy()[1:]]


def encode(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    """Token rows in ascending id order, parts in partition order."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceEncoder(tokenizer_json))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            # Texts are passed on in small batches.
            for at in range(0, batch.num_rows, _TEXTS):
                piece = batch.slice(at, _TEXTS)
                flat, ends = encoder.ids(piece.column("text").to_pylist())
                rows = piece.num_rows
                offsets = np.r_[0, ends + np.arange(1, rows + 1)]
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.insert(flat, ends, end_id)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, part, np.int32)), piece.column("doc_id"), pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets)), ids,
                    ],
                    names=["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # The text's hash lets the ranges split rows of one id, or without one.
    keyed = narrow.withColumn("key", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int) -> None:
    """Writes ``docs`` as token files under ``path``.

    ``tokenizer_json`` is the tokenizer's definition. Null and empty texts have the end id
    alone. Null ids come first, equal ids are ordered by the text's hash, repeated rows
    are written as often as they come. An empty table writes files without rows.
    """
    (
        encode(docs, tokenizer_json, end_id)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``; ``start`` counts the ids of all documents before."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    sums = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sums:
        offsets.append((part, before))
        before += n
    # One row per written part.
    parts = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Token rows of some documents; the filter reaches file statistics and Bloom filters."""
    return spark.read.schema(_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_checksum(rows: DataFrame) -> DataFrame:
    """Replaces ``ids`` by ``ids_crc32``, over the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False))
            at = ids.offsets.to_numpy()
            sums = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums)],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
