"""Permutations of positions, sorted positions of any keys, mixtures of named sources, isolated prompt sets."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from harness import plan_text
from tallyweave.functions import seeds
from tallyweave.operators import divergence, mix, order, rates
from tallyweave.sources import readers, registry

RNG = random.Random(8)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 48, 49, 50, 127, 1000, 4999])
def test_a_permutation_hits_every_place_once(spark, n):
    df = spark.range(n).select("id", *[seeds.permuted_position(F.col("id"), n, "s", e).alias(f"e{e}") for e in (0, 1)])
    rows = df.collect()
    for e in ("e0", "e1"):
        assert sorted(r[e] for r in rows) == list(range(n))
    if n > 40:
        assert [r["e0"] for r in rows] != [r["e1"] for r in rows]
        assert sum(r["e0"] == r["id"] for r in rows) < n / 8


def test_a_permutation_of_very_many_places(spark):
    n = (1 << 60) + 12345
    x = spark.range(1000).select(seeds.permuted_position(F.col("id") * 1_000_003 + (1 << 59), n, 3, F.col("id") % 2).alias("x"))
    got = [r["x"] for r in x.collect()]
    assert len(set(got)) == 1000 and all(0 <= v < n for v in got)
    assert 0.4 < sum(v < n / 2 for v in got) / 1000 < 0.6
    with pytest.raises(ValueError):
        seeds.permuted_position(F.col("id"), 0, 1)


def test_each_pass_has_an_order_of_its_own_and_can_be_resumed(spark):
    rows = spark.range(100).withColumnRenamed("id", "pos")
    plan = lambda **o: mix.batch_plan(rows, 4, 2, 30, rows=100, **o)
    whole = {r["slot_id"]: r["pos"] for r in plan(reshuffle=5).collect()}
    assert sorted(whole) == list(range(240))
    first, second = ([whole[e * 100 + i] for i in range(100)] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(100)) and first != second
    resumed = {r["slot_id"]: r["pos"] for r in plan(reshuffle=5, start_step=17).collect()}
    assert resumed == {s: p for s, p in whole.items() if s >= 17 * 8}


def test_positions_by_keys_of_any_type(spark):
    keys = [(RNG.choice("aBéz"), round(RNG.random(), 3), f"x{i}") for i in range(300)]
    df = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "a string, b double, c string, wide int")
    got = {r["wide"]: r["pos"] for r in order.sorted_position(df, ["a", "b", "c"]).collect()}
    ranked = sorted(range(300), key=lambda i: (keys[i][0].encode(), keys[i][1], keys[i][2].encode()))
    assert got == {i: at for at, i in enumerate(ranked)}
    falling = order.sorted_rows(df, [-F.col("b"), F.col("c")], "at", base=5).collect()
    assert sorted(r["at"] for r in falling) == list(range(5, 305))
    assert max(falling, key=lambda r: r["at"])["b"] == min(k[1] for k in keys)
    assert order.sorted_position(df.where("false"), ["a"]).collect() == []


@pytest.mark.parametrize("key", ["k", ["g", "k"]])
def test_weighted_mix_by_text_keys_equals_the_one_by_numbers(spark, key):
    """The same rows under keys that sort alike are drawn in the same slots."""
    def source(n, start):
        rows = [(start + i, f"{start + i:05d}", "g") for i in range(n)]
        return spark.createDataFrame(RNG.sample(rows, n), "id bigint, k string, g string")

    sources = {"long": source(70, 0), "short": source(3, 500)}
    weights = {"long": 2, "short": 5}
    by_number = mix.mix_weighted(sources, weights, "id", 4)
    by_text = mix.mix_weighted(sources, weights, key, 4)
    columns = ["slot", "source", "idx", "pass", "id", "k"]
    assert sorted(map(tuple, by_text.select(columns).collect())) == sorted(map(tuple, by_number.select(columns).collect()))
    woven = mix.interleave_round_robin(sources, key).orderBy("pos").collect()
    assert [r["id"] for r in woven[:8]] == [0, 500, 1, 501, 2, 502, 3, 500]


def test_a_mixture_is_a_registry_entry(spark):
    def spec(name, n):
        rows = [(f"{name}{i}", f"text {i}") for i in range(n)]
        return registry.DatasetSpec(lambda s, root: s.createDataFrame(rows, "id string, text string"), keep=("id",))

    known = registry.Registry({"a": spec("a", 40), "b": spec("b", 5)})
    known.register("both", registry.MixtureSpec({"a": 0.7, "b": 0.3}, "id", 2))
    rows = known.resolve(spark, "both", "").collect()
    counts = collections.Counter(r["source"] for r in rows)
    assert {r["id"] for r in rows} == {f"a{i}" for i in range(40)} | {f"b{i}" for i in range(5)}
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and counts["a"] > counts["b"] > 5
    known.register("nested", registry.MixtureSpec({"both": 1, "a": 1}, "id"))
    with pytest.raises(ValueError):
        known.resolve(spark, "nested", "")


def test_a_set_that_fails_while_it_runs_leaves_the_others_whole(spark, tmp_path):
    good = spark.range(30).select(F.col("id").alias("sample_id"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is no table PAR1")

    def broken(batches):
        for batch in batches:
            raise RuntimeError("the model is gone")

    sets = {
        "a": lambda: good,
        "failing": lambda: good.mapInPandas(broken, "sample_id bigint"),
        "corrupt": lambda: spark.read.schema("sample_id bigint").parquet(str(tmp_path / "bad.parquet")),
        "b": lambda: good.where("sample_id > 9"),
    }
    rows, status = rates.union_eval_sets(spark, sets, workers=3)
    assert rows.count() == 50
    report = {r["set_name"]: (r["ok"], r["error"]) for r in status.collect()}
    assert [n for n, (ok, _) in report.items() if ok] == ["a", "b"] and list(report) == list(sets)
    assert all(report[n][1] for n in ("failing", "corrupt")) and max(len(e or "") for _, e in report.values()) <= rates.ERROR_CHARS


def test_masked_divergence(spark):
    rows = [(i, [[RNG.gauss(0, 2) for _ in range(5)] for _ in range(n)], [[RNG.gauss(0, 2) for _ in range(5)] for _ in range(n)],
             [RNG.choice([0, 1]) for _ in range(n)]) for i, n in enumerate([6, 3, 1])]
    df = spark.createDataFrame(rows, "i int, p array<array<double>>, q array<array<double>>, mask array<int>")

    def softmax(v, t):
        e = [math.exp(x / t) for x in v]
        return [x / sum(e) for x in e]

    for t in (1.0, 2.0):
        got = {r["i"]: r["kl"] for r in divergence.masked_divergence(df, "p", "q", "mask", "i", temperature=t).collect()}
        for i, ps, qs, mask in rows:
            kl = [sum(a * math.log(a / b) for a, b in zip(softmax(p, t), softmax(q, t))) for p, q in zip(ps, qs)]
            want = t * t * sum(v * m for v, m in zip(kl[:-1], mask[1:])) / len(kl)
            assert got[i] == pytest.approx(want)


def test_vectors_are_added_up_whole(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("b", [5.0, 5.0])], "g string, v array<float>")
    means = divergence.vector_means(df, "g", "v")
    assert {r["g"]: (r["center"], r["cnt"]) for r in means.collect()} == {"a": ([2.0, 4.0], 2), "b": ([5.0, 5.0], 1)}
    assert "Generate" not in plan_text(means)


def test_spread(spark):
    few = spark.range(0, 40, 1, 2)
    assert readers.spread(few, 8).rdd.getNumPartitions() == 8 and readers.spread(few, 8).count() == 40
    assert readers.spread(few, 2) is few
