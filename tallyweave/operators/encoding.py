"""Token lists to integer ids, and integer token rows.

The frequent part of a vocabulary, bounded in rows and in bytes, is held by every task as
Arrow arrays, and whole batches of lists are looked up in it. Only tokens outside it become
rows: these are joined with the rest of the vocabulary, which has no hot key, and their ids
are put back into their lists. A vocabulary that fits whole needs no shuffle at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.lookup import HEAD_ROWS, LONG_KEY_BYTES, bounded_key, head_weight
from tallyweave.sources.scratch import materialise

#: Ids of padding and of tokens that the vocabulary lacks; its own ids follow.
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2


def dictionary(vocab: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """``(token, cnt, id)`` of a counted vocabulary with ids from ``first_id``."""
    return vocab.select("token", "cnt", (F.col("id") + first_id).cast("int").alias("id"))


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All values, and where each list ends; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.r_[0, np.cumsum(sizes)]


def _listed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def find_ids(tokens: pa.Array, keys: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Ids of tokens, -1 for those that ``keys`` lack. Keys are short tokens after ``=`` and hashes of long ones after ``#``."""
    whole = pc.binary_join_element_wise("=", tokens, "")
    long = np.flatnonzero(pc.greater(pc.binary_length(tokens), LONG_KEY_BYTES).fill_null(False).to_numpy(zero_copy_only=False))
    places = pc.fill_null(pc.index_in(whole, value_set=keys), -1).to_numpy(zero_copy_only=False)
    if len(long):
        coded = tokens.take(pa.array(long)).dictionary_encode()
        hashed = [f"#{hashlib.md5(t.encode()).hexdigest()}" for t in coded.dictionary.to_pylist()]
        found = pc.fill_null(pc.index_in(pa.array(hashed, pa.string()), value_set=keys), -1).to_numpy(zero_copy_only=False)
        places = places.copy()
        places[long] = found[coded.indices.to_numpy(zero_copy_only=False)]
    return np.where(places >= 0, ids[places] if len(ids) else -1, -1)


class Encoder:
    """Encodes token lists by a vocabulary ``(token, cnt, id)`` with one row per token.

    The table is counted here and should be materialised. Ids fit an int. At most
    ``head_rows`` tokens are held by the tasks; the rest is joined.
    """

    def __init__(self, vocab: DataFrame, unknown_id: int = UNKNOWN_ID, head_rows: int = HEAD_ROWS):
        self.unknown_id = unknown_id
        keyed = vocab.select(bounded_key(F.col("token")).alias("key"), "cnt", F.col("id").cast("int").alias("id"))
        self.whole = vocab.count() <= head_rows
        cut = 0 if self.whole else head_weight(vocab, "cnt", head_rows)
        self.tail = keyed.where(F.col("cnt") <= cut)
        head = (keyed if self.whole else keyed.where(F.col("cnt") > cut)).select("key", "id").toArrow()
        keys, ids = head.column("key").combine_chunks(), head.column("id").to_numpy()
        self._held = vocab.sparkSession.sparkContext.broadcast((keys, ids))

    def _coder(self):
        held, unknown = self._held, self.unknown_id

        @F.arrow_udf("struct<ids: array<int>, missing: array<int>>")
        def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            keys, ids = held.value
            for lists in batches:
                tokens, ends = _flat(lists)
                found = find_ids(tokens, keys, ids)
                missing = np.flatnonzero(found < 0)
                row = np.searchsorted(ends, missing, side="right") - 1
                places = _listed(missing - ends[row], np.searchsorted(missing, ends))
                coded = _listed(np.where(found < 0, unknown, found), ends)
                yield pa.StructArray.from_arrays([coded, places], names=["ids", "missing"])

        return code

    def __call__(
        self, df: DataFrame, tokens: Column, name: str = "input_ids", keys: Sequence[str] = (), keep: Sequence[str] | None = None
    ) -> DataFrame:
        """The columns ``keep`` (all, if not given) and an ``array<int>`` of ids.

        A token that the vocabulary lacks gets the unknown id; a null list is empty.
        ``keys`` identify a row, where not all tokens are held by the tasks.
        """
        code = self._coder()
        columns = list(df.columns if keep is None else keep)
        if self.whole:
            return df.select(*columns, code(tokens)["ids"].alias(name))
        if not keys:
            raise ValueError("a vocabulary that is joined needs the columns that identify a row")
        coded = df.withColumn("__tokens", tokens).withColumn("__coded", code("__tokens"))
        tail = F.transform("__coded.missing", lambda i: F.struct(i.alias("at"), F.get("__tokens", i).alias("token")))
        written = materialise(coded.select(*columns, F.col("__coded.ids").alias(name), tail.alias("__tail")), "coded")
        rest = written.where(F.size("__tail") > 0)
        rows = rest.select(*keys, F.inline("__tail")).withColumn("key", bounded_key(F.col("token")))
        found = rows.join(self.tail.select("key", "id"), "key")
        patches = found.groupBy(*keys).agg(F.collect_list("at").alias("__at"), F.collect_list("id").alias("__id"))
        patched = rest.join(patches, list(keys), "left").withColumn(name, _patched(F.col(name), F.col("__at"), F.col("__id")))
        whole = written.where(F.size("__tail") == 0).drop("__tail")
        return whole.unionByName(patched.select(*whole.columns)).select(*columns, name)


def _patched(lists: Column, places: Column, ids: Column) -> Column:
    """Lists with the ids put at their places; null places change nothing."""

    @F.arrow_udf("array<int>")
    def patch(lists: pa.Array, places: pa.Array, ids: pa.Array) -> pa.Array:
        values, ends = _flat(lists)
        values = values.to_numpy(zero_copy_only=False).astype(np.int32)
        at, starts = _flat(places)
        rows = np.repeat(np.arange(len(lists)), np.diff(starts))
        values[ends[rows] + at.to_numpy(zero_copy_only=False)] = _flat(ids)[0].to_numpy(zero_copy_only=False)
        return _listed(values, ends)

    return patch(lists, places, ids)
