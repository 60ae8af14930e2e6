"""Mixing sources: weighted draws and round robin, with exact seeded plans."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyweave.functions.ints import int_div
from tallyweave.functions.seeds import UINT32, hash_uint32, order_hash, permuted_position
from tallyweave.operators.order import (
    KEY_SHIFTS,
    hash_position,
    natural_levels,
    natural_position,
    shifts_below,
    sorted_position,
    with_position,
)

# A source row that is drawn very often is copied, so that no join key of the
# final lookup meets more than this many draws.
DRAWS_PER_COPY = 64
REPEATS_PER_STEP = 1024
_FIRST, _SECOND = "mixture", "second"


def mix_normalize(spec: DataFrame, weight: str = "p", name: str = "share") -> DataFrame:
    """``p / sum(p)``; the spec has one row per source."""
    total = spec.agg(F.sum(weight)).scalar()
    return spec.withColumn(name, F.col(weight) / total)


def tag_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    frames = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


Key = str | Sequence[str]


def _names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def source_sizes(tagged: DataFrame, names: list[str], key: Key) -> tuple[dict[str, int], list[int] | None]:
    """Row count per source, and the position levels that its integer keys need; None for keys of other types.

    One driver row per entry of the spec; only the key columns are read.
    """
    keys = _names(key)
    whole = len(keys) == 1 and isinstance(tagged.schema[keys[0]].dataType, T.IntegralType)
    ends = [F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")] if whole else []
    rows = tagged.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *ends).collect()
    sizes = {r["source"]: r["n"] for r in rows}
    empty = [s for s in names if not sizes.get(s)]
    if empty:
        raise ValueError(f"sources without rows: {empty}")
    if not whole:
        return sizes, None
    small = min(r["low"] for r in rows) >= 0
    return sizes, shifts_below(max(r["high"] for r in rows) + 1) if small else list(KEY_SHIFTS)


def numbered_rows(tagged: DataFrame, key: Key, levels: list[int] | None, sizes: Mapping[str, int], name: str = "idx") -> DataFrame:
    """``tagged`` with each row's place in its source, by the key's order."""
    if levels is not None:
        return natural_position(tagged, _names(key)[0], name, ["source"], levels)
    # The sources lie behind each other in one sorted order.
    before, at = {}, 0
    for source in sorted(sizes, key=str.encode):
        before[source] = at
        at += sizes[source]
    placed = sorted_position(tagged, ["source", *_names(key)], "__at")
    return placed.withColumn(name, F.col("__at") - _by_source(before)).drop("__at")


def _by_source(values: Mapping[str, int]) -> Column:
    """Per-source constant as one CASE expression (the spec is a handful of rows)."""
    pairs = iter(values.items())
    name, value = next(pairs)
    expr = F.when(F.col("source") == name, F.lit(value))
    for name, value in pairs:
        expr = expr.when(F.col("source") == name, F.lit(value))
    return expr.cast("bigint")


def _upto(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))


def repeat_rows(
    df: DataFrame, most: int, name: str, spread: list[str], times: Column | None = None
) -> DataFrame:
    """Every row ``times`` (default ``most``, which bounds it) times, numbered by ``name`` from 0.

    Rows with many repeats get them in two steps, with a shuffle by ``spread`` (columns
    that identify a row) between them, so one task never has to emit all copies of its
    rows. The other rows, usually nearly all, are repeated where they are.
    """
    times = F.lit(most) if times is None else times
    few = df.where(times <= REPEATS_PER_STEP).withColumn(name, _upto(times))
    if most <= REPEATS_PER_STEP:
        return few
    inner = math.isqrt(most - 1) + 1
    many = df.where(times > REPEATS_PER_STEP).withColumn("__outer", _upto(F.ceil(times / inner)))
    fine = many.repartition("__outer", *spread).withColumn("__inner", _upto(F.lit(inner)))
    repeated = (
        fine.withColumn(name, F.col("__outer") * inner + F.col("__inner"))
        .where(F.col(name) < times)
        .drop("__outer", "__inner")
    )
    return few.unionByName(repeated)


def fetch_rows(
    draws: DataFrame, tagged: DataFrame, key: Key, levels: list[int] | None, sizes: Mapping[str, int], repeats: Mapping[str, int]
) -> DataFrame:
    """Join draws ``(source, idx, pass)`` to the ``idx``-th row of each source.

    The rows are numbered by key alone, and the draws get their key from that narrow
    table; the wide rows are shuffled once, for the last join. ``repeats`` says about
    how often a row of each source is drawn. A short source in a long mix is drawn
    over and over; its rows are copied ``repeats / DRAWS_PER_COPY`` times and the
    draws spread over the copies, so neither join has a hot key.
    """
    copies = {s: max(1, math.ceil(r / DRAWS_PER_COPY)) for s, r in repeats.items()}
    wanted, most = _by_source(copies), max(copies.values())
    row = ["source", *_names(key)]
    numbered = numbered_rows(tagged.select(*row), key, levels, sizes)
    keyed = draws.withColumn("__copy", F.col("pass") % wanted)
    placed = keyed.join(repeat_rows(numbered, most, "__copy", row, wanted), ["source", "idx", "__copy"])
    return placed.join(repeat_rows(tagged, most, "__copy", row, wanted), [*row, "__copy"]).drop("__copy")


def _thresholds(weights: Mapping[str, float]) -> list[tuple[str, float]]:
    total = float(sum(weights.values()))
    cumulative, out = 0.0, []
    for name, w in weights.items():
        cumulative += w
        out.append((name, cumulative / total))
    return out


def _slot_sources(spark, slots: int, weights: Mapping[str, float], seed: int | str) -> DataFrame:
    """Slot -> source by its hash; the last interval is closed at 1."""
    u = hash_uint32(order_hash(seed, F.col("id"))) / F.lit(float(UINT32))
    bounds = _thresholds(weights)
    source = F.when(F.lit(False), F.lit(""))
    for name, upper in bounds[:-1]:
        source = source.when(u < F.lit(upper), F.lit(name))
    return spark.range(slots).select(
        F.col("id").alias("slot"), source.otherwise(F.lit(bounds[-1][0])).alias("source")
    )


def _last_slot(spark, slots: int, weights, seed, sizes) -> int | None:
    """Slot in which the last source is used up, or None if ``slots`` is too short.

    Works on bucket counts; only the bucket in which a source runs out is ranked.
    """
    shift = 12
    plan = _slot_sources(spark, slots, weights, seed).withColumn("leaf", F.shiftright("slot", shift))
    coarse = F.shiftright("leaf", 17)
    counts = plan.groupBy("source", coarse.alias("top"), "leaf").agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("source", "top").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("source", "top", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("top_off"))
    inside = Window.partitionBy("source", "top").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        counts.withColumn("leaf_off", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(tops, ["source", "top"])
        .withColumn("before", F.col("top_off") + F.col("leaf_off"))
        .withColumn("need", _by_source(sizes))
        .where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
        .select("source", "leaf", "before", "need")
        .collect()  # one row per source of the spec
    )
    if len(crossing) < len(weights):
        return None
    marks = spark.createDataFrame(crossing, "source string, leaf bigint, before bigint, need bigint")
    rank = F.row_number().over(Window.partitionBy("source", "leaf").orderBy("slot"))
    last = (
        plan.where(F.col("leaf").isin([r["leaf"] for r in crossing]))
        .join(F.broadcast(marks), ["source", "leaf"])  # at most one row per source
        .withColumn("rank", rank + F.col("before"))
        .where(F.col("rank") == F.col("need"))
        .agg(F.max("slot"))
    )
    return last.first()[0]


def mix_draws(
    spark, sizes: Mapping[str, int], weights: Mapping[str, float], seed: int | str
) -> tuple[DataFrame, int]:
    """``(slot, source, idx, pass)`` until every source was used up once, and their number."""
    bad = [s for s, w in weights.items() if not w > 0]
    if bad:
        raise ValueError(f"weights must be positive, a source without weight is never used up: {bad}")
    total = float(sum(weights.values()))
    slots = math.ceil(1.2 * max(sizes[s] * total / w for s, w in weights.items())) + 1000
    while (last := _last_slot(spark, slots, weights, seed, sizes)) is None:
        slots *= 2
    plan = _slot_sources(spark, last + 1, weights, seed)
    ranked = with_position(
        plan, natural_levels(F.col("slot"), shifts_below(last + 1)), [F.col("slot")], "rank", ["source"]
    )
    n = _by_source(sizes)
    draws = ranked.select(
        "slot", "source", (F.col("rank") % n).alias("idx"), int_div(F.col("rank"), n).alias("pass")
    )
    return draws, last + 1


def _repeats(sizes: Mapping[str, int], weights: Mapping[str, float], slots: int) -> dict[str, int]:
    """About how often a row of each source is drawn; sets the number of copies."""
    total = float(sum(weights.values()))
    return {s: math.ceil(slots * w / total / sizes[s]) for s, w in weights.items()}


def _check(sources: Mapping[str, DataFrame], weights: Mapping[str, float]) -> None:
    if set(sources) != set(weights):
        raise ValueError("sources and weights must name the same datasets")


def mix_weighted(
    sources: Mapping[str, DataFrame], weights: Mapping[str, float], key: Key, seed: int | str
) -> DataFrame:
    """Weighted interleave until all sources are exhausted; short sources restart.

    ``key`` names one column or several, of any type that can be ordered, that identify a
    row inside each source and give its row order. They must not be null.
    """
    _check(sources, weights)
    tagged = tag_sources(sources)
    sizes, levels = source_sizes(tagged, list(weights), key)
    draws, slots = mix_draws(tagged.sparkSession, sizes, weights, seed)
    return fetch_rows(draws, tagged, key, levels, sizes, _repeats(sizes, weights, slots))


def _places(
    df: DataFrame, turn: Column, sources: int, sizes: Mapping[str, int], longest: int, idx: str
) -> DataFrame:
    """Output places of numbered sources in a round robin: row ``idx`` of the source
    with turn ``j`` of ``k`` comes at ``k * (idx + round * size) + j``. Plain
    arithmetic, no join."""
    rounds = {s: math.ceil(longest / n) for s, n in sizes.items()}
    at = F.col(idx) + F.col("round") * _by_source(sizes)
    repeated = repeat_rows(df, max(rounds.values()), "round", ["source", idx], _by_source(rounds))
    return repeated.where(at < longest).withColumn("pos", at * sources + turn)


def interleave_round_robin(sources: Mapping[str, DataFrame], key: Key) -> DataFrame:
    """Alternate the sources row by row until the longest one ends; short ones restart.

    The rows of a source are ordered by ``key``, as in ``mix_weighted``.
    """
    tagged = tag_sources(sources)
    sizes, levels = source_sizes(tagged, list(sources), key)
    longest = max(sizes.values())
    numbered = numbered_rows(tagged, key, levels, sizes)
    turns = _by_source({s: j for j, s in enumerate(sources)})
    return _places(numbered, turns, len(sources), sizes, longest, "idx").drop("round")


def build_mixture(
    sources: Mapping[str, DataFrame],
    weights: Mapping[str, float],
    second: DataFrame,
    key: Key,
    seed: int | str,
) -> DataFrame:
    """Weighted mix, shuffled, alternating with a second, shuffled set.

    Everything is planned on narrow index rows (slot, source, row number); the
    source rows are joined once, at the end. Gives ``pos, part, origin`` and the
    columns of the rows.
    """
    _check(sources, weights)
    tagged = tag_sources(sources)
    sizes, levels = source_sizes(tagged, list(weights), key)
    draws, slots = mix_draws(second.sparkSession, sizes, weights, seed)
    rest_size = second.count()
    if rest_size == 0:
        raise ValueError("the second set has no rows")
    longest = max(slots, rest_size)

    shuffled = hash_position(draws, ["slot"], seed, "at").withColumnsRenamed({"source": "origin"})
    shuffled = shuffled.withColumn("source", F.lit(_FIRST))
    plan = _places(shuffled, F.lit(0), 2, {_FIRST: slots}, longest, "at").select(
        "pos", F.col("origin").alias("source"), "idx", (F.col("pass") + F.col("round")).alias("pass")
    )
    rounds = math.ceil(longest / slots)
    repeats = {s: r * rounds for s, r in _repeats(sizes, weights, slots).items()}
    mixed = fetch_rows(plan, tagged, key, levels, sizes, repeats).drop("idx", "pass").withColumnRenamed("source", "origin")

    rest = hash_position(second, _names(key), seed, "at").withColumn("source", F.lit(_SECOND))
    rest = _places(rest, F.lit(1), 2, {_SECOND: rest_size}, longest, "at").drop("round", "at")
    return mixed.withColumn("part", F.lit(_FIRST)).unionByName(
        rest.withColumnRenamed("source", "part").withColumn("origin", F.lit(_SECOND))
    )


def batch_plan(
    numbered: DataFrame,
    batch: int,
    accumulate: int,
    max_steps: int,
    pos: str = "pos",
    rows: int | None = None,
    reshuffle: int | str | None = None,
    start_step: int = 0,
) -> DataFrame:
    """Training manifest with its rows; the rows cycle when the steps outlast them.

    Row ``pos`` fills the slots ``pos + pass * rows``, so no join is needed. ``rows`` is
    the number of rows; it is counted if it is not given. With a seed in ``reshuffle`` each
    pass has an order of its own: a row's place in it is computed from its position and the
    pass, so nothing is shuffled, and a run resumed at ``start_step`` sees the rows that it
    would have seen.
    """
    rows = numbered.count() if rows is None else rows
    if rows == 0:
        raise ValueError("no rows to train on")
    per_step = batch * accumulate
    total = per_step * max_steps
    slot = F.col("slot_id")
    place = F.col(pos) if reshuffle is None else permuted_position(F.col(pos), rows, reshuffle, F.col("pass"))
    return (
        repeat_rows(numbered, max(1, math.ceil(total / rows)), "pass", [pos])
        .withColumn("slot_id", place + F.col("pass") * F.lit(rows))
        .where((slot < total) & (slot >= per_step * start_step))
        .select(
            "slot_id",
            int_div(slot, per_step).alias("step"),
            int_div(slot % per_step, batch).alias("micro"),
            (slot % batch).alias("slot"),
            "pass",
            *[c for c in numbered.columns],
        )
    )
