"""Positions, sampling and mixing against brute force."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import mix, order


def md5(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_natural_position_of_sparse_keys(spark, partitions):
    rng = random.Random(3)
    keys = [-5, -1, 0, 1, 4095, 4096, 1 << 40, (1 << 62) + 3, -(1 << 62)] + [rng.randrange(-(1 << 60), 1 << 60) for _ in range(300)]
    keys = list(dict.fromkeys(keys + list(range(10_000, 20_000))))
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(partitions)
    got = {r["k"]: r["pos"] for r in order.natural_position(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("digits", [1, 4, 5, 9])
def test_seeded_shuffle_is_a_permutation(spark, digits):
    df = spark.range(500)
    got = {r["id"]: r["pos"] for r in order.seeded_shuffle(df, ["id"], 9, digits=digits).collect()}
    want = sorted(range(500), key=lambda k: md5(9, k))
    assert got == {k: i for i, k in enumerate(want)}
    other = {r["id"]: r["pos"] for r in order.seeded_shuffle(df, ["id"], 10).collect()}
    assert other != got


def test_position_within_groups_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 50}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    got = {(r["g"], r["k"]): r["pos"] for r in order.natural_position(df, "k", within=["g"]).collect()}
    seen = collections.Counter()
    for g, k in sorted(rows, key=lambda r: r[1]):
        assert got[(g, k)] == seen[g]
        seen[g] += 1


def test_skip_take_parity(spark):
    df = order.natural_position(spark.range(20), "id")
    assert sorted(r["id"] for r in order.take_positions(order.skip_rows(df, 5), 4).collect()) == [5, 6, 7, 8]
    even, odd = order.parity_split(df)
    assert sorted(r["id"] for r in even.collect()) == list(range(0, 20, 2)) and odd.count() == 10
    assert [r["id"] for r in order.take_samples(spark.range(20), 4, [F.col("id")], skip=5).orderBy("id").collect()] == [5, 6, 7, 8]


@pytest.mark.parametrize("skip,n,passes", [(0, 25, 3), (0, 5, 2), (3, 100, 5), (4, 9, 4), (10, 5, 2), (0, 100, 3)])
def test_oversample(spark, skip, n, passes):
    rows = list(range(10))
    want, left = [], rows
    for i in range(passes):
        left = left[skip:]
        want += [(i, r) for r in left]
    want = [(slot, p, r) for slot, (p, r) in enumerate(want[:n])]
    df = order.natural_position(spark.range(10), "id")
    got = order.oversample(df, passes, n, F.lit(10), skip=skip).collect()
    assert sorted((r["slot"], r["pass"], r["id"]) for r in got) == want


def test_step_gate(spark):
    df = spark.range(64).select(F.expr("id div 4").alias("step"), (F.col("id") % 4).alias("micro"))
    got = {(r["step"], r["micro"]) for r in order.step_gate(df, 3, 5, 1).collect()}
    assert got == {(5, 0), (10, 0), (15, 0)}


def brute_mix(sizes, weights, seed):
    total, bounds, c = sum(weights.values()), [], 0.0
    for s, w in weights.items():
        c += w
        bounds.append((s, c / total))
    draws, done, slot = [], collections.Counter(), 0
    while any(done[s] < n for s, n in sizes.items()):
        u = int(md5(seed, slot)[:8], 16) / 2**32
        source = next((s for s, hi in bounds[:-1] if u < hi), bounds[-1][0])
        draws.append((slot, source, done[source] % sizes[source], done[source] // sizes[source]))
        done[source] += 1
        slot += 1
    return draws


@pytest.mark.parametrize(
    "sizes,weights",
    [
        ({"a": 40, "b": 7, "c": 5}, {"a": 7, "b": 2, "c": 1}),
        ({"big": 3000, "tiny": 2}, {"big": 0.3, "tiny": 0.7}),
        ({"only": 13}, {"only": 1}),
    ],
)
def test_mix_weighted(spark, sizes, weights):
    sources, first = {}, 0
    for s, n in sizes.items():
        sources[s] = spark.range(first, first + n).select(F.col("id").alias("k"), F.concat(F.lit(s), "id").alias("v"))
        first += n + 1000
    rows = mix.mix_weighted(sources, weights, "k", 5).collect()
    want = brute_mix(sizes, weights, 5)
    assert sorted((r["slot"], r["source"], r["idx"], r["pass"]) for r in rows) == want
    used = collections.defaultdict(set)
    for r in rows:
        used[r["source"]].add(r["v"])
    assert {s: len(v) for s, v in used.items()} == sizes


def test_mix_weighted_doubles_a_short_plan(spark, monkeypatch):
    seen = []
    real = mix._last_slot
    monkeypatch.setattr(mix, "_last_slot", lambda sp, slots, *a: seen.append(slots) or real(sp, 4 if len(seen) == 1 else slots, *a))
    draws, n = mix.mix_draws(spark, {"a": 20, "b": 30}, {"a": 1, "b": 1}, 1)
    assert len(seen) == 2 and seen[1] == 2 * seen[0]
    assert draws.count() == n == len(brute_mix({"a": 20, "b": 30}, {"a": 1, "b": 1}, 1))


def test_mix_is_the_same_for_any_partitioning(spark):
    got = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sources = {"a": spark.range(50).select(F.col("id").alias("k")), "b": spark.range(9).select(F.col("id").alias("k"))}
        got.append(sorted(map(tuple, mix.mix_weighted(sources, {"a": 1, "b": 3}, "k", 2).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


def test_bad_mixtures(spark):
    one = {"a": spark.range(3)}
    with pytest.raises(ValueError):
        mix.mix_weighted(one, {"a": 0}, "id", 1)
    with pytest.raises(ValueError):
        mix.mix_weighted(one, {"b": 1}, "id", 1)
    with pytest.raises(ValueError):
        mix.mix_weighted({"a": spark.range(0)}, {"a": 1}, "id", 1)


def test_round_robin_and_back(spark):
    a, b = spark.range(12), spark.range(100, 105)
    woven = mix.interleave_round_robin({"a": a, "b": b}, "id")
    got = [(r["source"], r["id"]) for r in woven.orderBy("pos").collect()]
    want = []
    for i in range(12):
        want += [("a", i), ("b", 100 + i % 5)]
    assert got == want
    even, odd = order.parity_split(woven)
    assert sorted(r["id"] for r in even.collect()) == list(range(12))
    assert {r["id"] for r in odd.collect()} == set(range(100, 105))


def test_repeat_rows_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(mix, "REPEATS_PER_STEP", 4)
    df = spark.createDataFrame([("a", 11), ("b", 3)], "s string, times int")
    got = mix.repeat_rows(df, 11, "copy", ["s"], F.col("times")).collect()
    assert sorted((r["s"], r["copy"]) for r in got) == [("a", i) for i in range(11)] + [("b", i) for i in range(3)]


def test_round_robin_with_one_row_source(spark, monkeypatch):
    monkeypatch.setattr(mix, "REPEATS_PER_STEP", 8)
    woven = mix.interleave_round_robin({"long": spark.range(200), "one": spark.range(7, 8)}, "id")
    assert woven.count() == 400 and woven.where("source = 'one'").select("pos").distinct().count() == 200


def test_build_mixture_with_a_longer_second_set(spark):
    sources = {"a": spark.range(10).select(F.col("id").alias("k")), "b": spark.range(50, 55).select(F.col("id").alias("k"))}
    second = spark.range(1000, 1100).select(F.col("id").alias("k"))
    rows = mix.build_mixture(sources, {"a": 1, "b": 1}, second, "k", 3).collect()
    draws = brute_mix({"a": 10, "b": 5}, {"a": 1, "b": 1}, 3)
    value = {"a": lambda i: i, "b": lambda i: 50 + i}
    shuffled = [value[s](i) for slot, s, i, _ in sorted(draws, key=lambda d: md5(3, d[0]))]
    other = sorted(range(1000, 1100), key=lambda k: md5(3, k))
    longest = max(len(shuffled), len(other))
    want = []
    for t in range(longest):
        want += [shuffled[t % len(shuffled)], other[t % len(other)]]
    assert [r["k"] for r in sorted(rows, key=lambda r: r["pos"])] == want


@pytest.mark.parametrize("max_steps", [2, 20])
def test_batch_plan(spark, max_steps):
    df = order.natural_position(spark.range(30), "id")
    got = mix.batch_plan(df, 4, 2, max_steps).orderBy("slot_id").collect()
    assert [(r["slot_id"], r["step"], r["micro"], r["slot"], r["id"]) for r in got] == [
        (s, s // 8, s % 8 // 4, s % 4, s % 30) for s in range(8 * max_steps)
    ]
    assert max(r["pass"] for r in got) == math.ceil(8 * max_steps / 30) - 1


def test_a_null_key_keeps_its_row(spark):
    df = spark.createDataFrame([(5,), (None,), (-3,)], "k bigint")
    got = {r["k"]: r["pos"] for r in order.natural_position(df, "k").collect()}
    assert got == {None: 0, -3: 1, 5: 2}


def test_rows_with_few_repeats_are_not_shuffled_by_repeat_rows(spark, monkeypatch):
    monkeypatch.setattr(mix, "REPEATS_PER_STEP", 4)
    df = spark.range(1000).withColumn("times", F.when(F.col("id") < 2, 50).otherwise(1))
    got = mix.repeat_rows(df, 50, "copy", ["id"], F.col("times"))
    per_task = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert got.count() == 998 + 100
    assert max(r["count"] for r in per_task) < 200
