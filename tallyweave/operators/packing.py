"""Pack token lists into blocks of equal length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.functions.ints import int_div
from tallyweave.operators.order import fitting_shifts, natural_position


def pack_sequences(
    lists: DataFrame, length: int, key: str, tokens: str = "input_ids", batch_rows: int = 1000
) -> DataFrame:
    """``(batch, block, input_ids)``: the lists of each batch of rows, in the order of the integer
    ``key``, joined and cut into full blocks; what is left of a batch is dropped.

    ``lists`` is read twice and should be materialised. Rows are numbered, and list sizes
    summed up, on narrow (key, size) rows, so that a batch's lists are never held together.
    Lists are cut into *pieces* that lie in one block each; tokens are never exploded, a
    long list is not copied per piece, and a block's group holds at most ``length`` tokens.
    """
    sizes = lists.select(key, F.coalesce(F.size(tokens), F.lit(0)).cast("bigint").alias("__n"))
    in_batch = Window.partitionBy("batch")
    before = in_batch.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        natural_position(sizes, key, shifts=fitting_shifts(sizes, key))
        .withColumn("batch", int_div(F.col("pos"), batch_rows))
        .select(
            key,
            "batch",
            "__n",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
            int_div(F.sum("__n").over(in_batch), length).alias("__full"),
        )
    )
    return (
        lists.select(key, F.col(tokens).alias("__t"))
        .join(placed, key)
        .select("batch", F.inline(_pieces(length)))
        .groupBy("batch", "block")
        .agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("__pieces"))
        .select("batch", "block", F.flatten(F.transform("__pieces", lambda p: p["part"])).alias("input_ids"))
    )


def with_mask(blocks: DataFrame) -> DataFrame:
    """Packed blocks hold no padding: the mask is all ones."""
    return blocks.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def _pieces(length: int) -> Column:
    """``(block, at, part)`` of a row's list, for the full blocks of its batch only."""
    off, size = F.col("__off"), F.col("__n")
    first = int_div(off, length)
    last = F.least(int_div(off + size - 1, length), F.col("__full") - 1)
    blocks = F.when((size > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def piece(block: Column) -> Column:
        start = F.greatest(block * length, off)
        stop = F.least((block + 1) * length, off + size)
        part = F.slice(F.col("__t"), (start - off + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(block.alias("block"), start.alias("at"), part.alias("part"))

    return F.transform(blocks, piece)
