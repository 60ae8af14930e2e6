"""Samples by rank against sorting everything."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from harness import plan_text
from tallyweave.operators import selection
from tallyweave.sources.scratch import materialise

RNG = random.Random(5)
KEYS = sorted({RNG.choice([RNG.randrange(50), RNG.randrange(1 << 40), -RNG.randrange(1 << 62)]) for _ in range(500)})


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, f"t{k % 7}", k % 3) for k in RNG.sample(KEYS, len(KEYS))], "id bigint, t string, g bigint")
    return materialise(df, "rows")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("skip,n", [(0, 5), (3, 40), (0, 10_000), (480, 100), (9999, 3), (2, 0), (100, 1)])
def test_first_rows(rows, skip, n):
    assert ids(selection.first_rows(rows, "id", n, skip)) == KEYS[skip : skip + n]


@pytest.mark.parametrize("held", [selection.HELD, 20, 1])
def test_sample_rows(rows, held):
    want = sorted((k for k in KEYS if k % 3 != 1), key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
    fitting = F.col("g") != 1
    got = selection.take_ranks(rows, selection.hash_code(9, ["id"]), ["id"], 60, 25, fitting, held)
    assert ids(got) == sorted(want[25:85])
    assert got.columns == ["id", "t", "g"]


def test_prefixes_are_narrowed_until_few_rows_share_them(rows):
    got = selection.take_ranks(rows, selection.natural_code("id"), ["id"], 31, 17, held=2)
    assert ids(got) == KEYS[17:48]


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([(None,), (-3,), (4,), (0,)], "id bigint")
    assert [r["id"] for r in selection.first_rows(df, "id", 2).collect()] in ([None, -3], [-3, None])
    assert ids(selection.first_rows(df, "id", 2, 1)) == [-3, 0]
    assert selection.first_rows(df.where("false"), "id", 2).collect() == []


def test_repeated_keys_are_refused(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(2,)], "id bigint")
    with pytest.raises(ValueError):
        selection.take_ranks(df, selection.natural_code("id"), ["id"], 3, 5, held=10)


def test_taking_is_a_filter(rows):
    plan = plan_text(selection.sample_rows(rows, ["id"], 1, 200))
    assert "Exchange" not in plan and "Sort" not in plan
