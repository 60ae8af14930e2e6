"""What the operators share: table access, batch helpers, sorted-group streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | None) -> bytes:
    """Bytes of a text; null is empty, a lone surrogate (not text) becomes '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def long_array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Re-cut batches sorted by ``key`` so that no group is split.

    Only for groups whose size is bounded; a caller with unbounded groups streams them
    itself.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        got = pa.Table.from_batches([batch])
        rest = got if rest is None else pa.concat_tables([rest, got])
        keys = long_array(rest.column(key).combine_chunks())
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])
