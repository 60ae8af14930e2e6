"""Global row positions, and everything that is arithmetic on them.

``row_number() over (order by k)`` would send the whole table through one task.
Here rows are put into order-preserving buckets; only the bucket *counts* are
summed up in order, level by level, and the rows are numbered inside their
bucket. Every window is bounded by construction, the row data is shuffled once,
and the result depends neither on partitioning nor on task retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.functions.ints import int_div
from tallyweave.functions.seeds import order_hash
from tallyweave.sources.scratch import materialise

# Row keys of the natural order: 4,096 values per leaf bucket, then at most
# 131,072 child buckets per parent, so a 64-bit key needs three levels.
KEY_SHIFTS = (46, 29, 12)


def with_position(
    df: DataFrame,
    levels: Sequence[Column],
    order: Sequence[Column],
    name: str = "pos",
    within: Sequence[str] = (),
    base: int = 0,
) -> DataFrame:
    """Number the rows from ``base`` by ``order``, separately per ``within`` group.

    ``levels`` are bucket expressions, coarse to fine, each a refinement of the one
    before it. Sorting by them must agree with ``order``, and ``order`` must identify a
    row. ``within`` must not be null.
    """
    names = [f"__level_{i}" for i in range(len(levels))]
    leaf = names[-1]
    # A null key sorts first and keeps its row; levels without nulls also let the
    # branches below share one shuffle of the counts.
    kinds = df.select(*[c.alias(n) for c, n in zip(levels, names)]).schema
    filled = [
        F.coalesce(c, F.lit("") if kinds[n].dataType.typeName() == "string" else F.lit(-(1 << 62))).alias(n)
        for c, n in zip(levels, names)
    ]

    # Rows in front of each bucket among its siblings, from the finest level up.
    counts = df.select(*within, *filled).groupBy(*within, *names).agg(F.count(F.lit(1)).alias("__n"))
    offsets = None
    for depth in range(len(names), 0, -1):
        parents, child = [*within, *names[: depth - 1]], names[depth - 1]
        before = F.coalesce(
            F.sum("__n").over(
                Window.partitionBy(*parents)
                .orderBy(child)
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        )
        level = counts.select(*parents, child, before.alias("__off"))
        if offsets is None:
            offsets = level
        else:
            offsets = (
                offsets.withColumnRenamed("__off", "__fine")
                .join(level, [*parents, child])
                .withColumn("__off", F.col("__off") + F.col("__fine"))
                .drop("__fine")
            )
        if depth > 1:
            counts = counts.groupBy(*parents).agg(F.sum("__n").alias("__n"))

    # The leaf alone names a bucket, so rows carry, and are sorted by, only that.
    keys = [*within, leaf]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn(leaf, filled[-1])
        .join(offsets.select(*keys, "__off"), keys)
        .withColumn(name, (F.col("__off") + rank - 1 + F.lit(base)).cast("bigint"))
        .drop(leaf, "__off")
    )


def natural_levels(key: Column, shifts: Sequence[int] = KEY_SHIFTS) -> list[Column]:
    """Nested buckets of a unique integer key: at most 4,096 rows in a leaf, however
    the keys are spread."""
    return [F.shiftright(key.cast("bigint"), s) for s in shifts]


def shifts_below(upper: int) -> list[int]:
    """Levels that a key in ``[0, upper)`` needs."""
    wanted = [s for s in KEY_SHIFTS if upper >> s > 0]
    return wanted or [KEY_SHIFTS[-1]]


def fitting_shifts(df: DataFrame, key: str) -> list[int]:
    """The levels that the values of an integer key need; the key column is read once for them."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [KEY_SHIFTS[-1]]
    return shifts_below(high + 1) if low >= 0 else list(KEY_SHIFTS)


def natural_position(
    df: DataFrame,
    key: str,
    name: str = "pos",
    within: Sequence[str] = (),
    shifts: Sequence[int] = KEY_SHIFTS,
) -> DataFrame:
    """Position by a unique integer key."""
    return with_position(df, natural_levels(F.col(key), shifts), [F.col(key)], name, within)


def sorted_rows(df: DataFrame, order: Sequence[Column], name: str = "pos", base: int = 0) -> DataFrame:
    """Rows numbered by ``order``, which identifies a row and may be of any types that can be ordered.

    The rows are dealt by ranges whose ends are sampled, sorted inside each range and
    written: the files fix the order, whatever is computed again later. Only the ranges'
    row counts, one per task, are added up. Wide rows are better numbered by narrow keys
    (``sorted_position``).
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranges.withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__id", 33)  # the task is in the high bits of the generated id, the row's number in the low ones
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per task
    offsets, at = [], base
    for r in sorted(counts):
        offsets.append((r["__part"], at))
        at += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "__part bigint, __off bigint")
    row = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    found = placed.withColumn("__part", part).join(F.broadcast(table), "__part")
    return found.select(*df.columns, (F.col("__off") + row).alias(name))


def sorted_position(df: DataFrame, keys: Sequence[str], name: str = "pos") -> DataFrame:
    """Position by unique keys of any types that can be ordered, e.g. strings or several columns.

    Only the keys are sorted; the places are joined back by them.
    """
    places = sorted_rows(df.select(*keys), [F.col(k) for k in keys], name)
    return df.join(places, list(keys)) if set(df.columns) != set(keys) else places


def hash_position(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    name: str = "pos",
    within: Sequence[str] = (),
    digits: int = 6,
) -> DataFrame:
    """Position in a seeded random order of unique ``keys``.

    md5 spreads unique keys evenly over ``16 ** digits`` buckets, in nested levels of at
    most four digits: with 6 digits 10^11 rows give leaf buckets of about 6,000.
    """
    hashed = df.withColumn("__hash", order_hash(seed, *[F.col(k) for k in keys]))
    cuts = [*range(4, digits, 4), digits]
    levels = [F.substring("__hash", 1, c) for c in cuts]
    order = [F.col("__hash"), *[F.col(k) for k in keys]]
    return with_position(hashed, levels, order, name, within).drop("__hash")


def seeded_shuffle(
    df: DataFrame, keys: Sequence[str], seed: int | str, name: str = "pos", digits: int = 6
) -> DataFrame:
    """A reproducible permutation, as a position column."""
    return hash_position(df, keys, seed, name, digits=digits)


def skip_rows(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Skip by position; ``offset`` would pull all rows into one task."""
    return df.where(F.col(pos) >= n).withColumn(pos, F.col(pos) - F.lit(n))


def take_samples(df: DataFrame, n: int, order: Sequence[Column], skip: int = 0) -> DataFrame:
    """Exactly ``n`` rows by a total order, after ``skip`` rows: a top-k, in one pass.

    The sample is gathered in one task, as a top-k is; a sample too large for that is
    taken by ``take_positions`` from numbered rows, as the jobs do.
    """
    ordered = df.orderBy(*order)
    return ordered.offset(skip).limit(n) if skip else ordered.limit(n)


def take_positions(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) of a numbered table, for any ``n``."""
    return df.where(F.col(pos) < n)


def parity_split(df: DataFrame, pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Undo a two-way interleave: rows at even and at odd positions."""
    return df.where(F.col(pos) % 2 == 0), df.where(F.col(pos) % 2 == 1)


def oversample(
    df: DataFrame, passes: int, n: int | Column, total: Column, skip: int = 0, pos: str = "pos", slot: str = "slot"
) -> DataFrame:
    """Up to ``passes`` passes over a numbered table until ``n`` rows are out.

    Pass ``i`` (from 0) starts after ``skip * (i + 1)`` rows. Each row computes its
    own output slots, so the repeats are neither sorted nor limited globally.
    ``total`` is the row count, e.g. a scalar subquery.
    """
    i = F.col("pass")
    # Passes in front of this one that gave rows, and how many rows they gave.
    full = i if skip == 0 else F.least(i, F.greatest(int_div(total - 1, skip), F.lit(0)))
    given = full * total - int_div(F.lit(skip) * full * (full + 1), 2)
    at = F.col(pos) - F.lit(skip) * (i + 1)
    return (
        df.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        .where((at >= 0) & (at + given < n))
        .withColumn(slot, (at + given).cast("bigint"))
    )


def step_gate(
    df: DataFrame,
    start: int = 0,
    every: int = 1,
    micro: int | None = None,
    step_col: str = "step",
    micro_col: str = "micro",
) -> DataFrame:
    """Steps from ``start`` on, every ``every``-th, first ``micro`` micro-batches."""
    keep = (F.col(step_col) >= start) & (F.col(step_col) % every == 0)
    if micro is not None:
        keep = keep & (F.col(micro_col) < micro)
    return df.where(keep)
