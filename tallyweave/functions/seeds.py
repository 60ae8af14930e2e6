"""Stable seeds and hash orders (md5: equal on every engine and every run)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, functions as F

from tallyweave.functions.ints import int_div

UINT32 = 1 << 32
#: Rounds of a permutation of positions, and its arithmetic modulo a prime.
ROUNDS = 6
PRIME, FACTORS = (1 << 31) - 1, (48271, 69621)
_STEPS = 64


def order_hash(seed: int | str, *keys: Column) -> Column:
    """Hex hash that decides a row's place under ``seed``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_uint32(hex_hash: Column) -> Column:
    return F.conv(F.substring(hex_hash, 1, 8), 16, 10).cast("bigint")


def named_seed(name: Column) -> Column:
    """Seed derived from a name, the same in every process."""
    return hash_uint32(F.md5(name))


def round_keys(seed: int | str) -> list[tuple[int, int]]:
    """Of each round a key and what an epoch adds to it; the same on every engine."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
        out.append((int(digest[:8], 16) % PRIME, int(digest[8:16], 16) % PRIME))
    return out


def permuted_position(pos: Column, n: int, seed: int | str, epoch: Column | int = 0) -> Column:
    """A seeded permutation of the positions 0 to ``n - 1``, another one in each epoch.

    A Feistel network on ``a * b >= n`` numbers, whose halves are added to each other modulo
    a and b in turn, so that it is a bijection for any a and b. A result of ``n`` or more is
    permuted again until it falls below ``n``. There are fewer than ``a`` such numbers: up
    to ``n`` = 4,096 the steps always suffice; beyond, one step more is needed with a
    probability under 1 in 64 each time, and after 64 of them an error is raised. This is
    column arithmetic: no data are moved, and any row's new place can be computed alone.
    """
    if not 0 < n < 1 << 61:
        raise ValueError("1 to 2^61 - 1 positions are needed")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    epoch = F.lit(epoch).cast("bigint") if isinstance(epoch, int) else epoch.cast("bigint")
    keys = F.array(*[
        F.struct(((F.lit(k) + epoch % PRIME * F.lit(step)) % PRIME).alias("k"), F.lit(i % 2 == 0).alias("first"))
        for i, (k, step) in enumerate(round_keys(seed))
    ])

    def mixed(v: Column, k: Column) -> Column:
        return ((v * FACTORS[0] + k) % PRIME * FACTORS[1] + k) % PRIME

    def one_round(s: Column, key: Column) -> Column:
        low = F.when(key["first"], (s["low"] + mixed(s["high"] % PRIME, key["k"])) % a).otherwise(s["low"])
        high = F.when(key["first"], s["high"]).otherwise((s["high"] + mixed(s["low"] % PRIME, key["k"])) % b)
        return F.struct(low.alias("low"), high.alias("high"))

    def permuted(x: Column) -> Column:
        halves = F.struct((x % a).alias("low"), int_div(x, a).alias("high"))
        return F.aggregate(keys, halves, one_round, lambda s: s["low"] + s["high"] * F.lit(a).cast("bigint"))

    steps = F.array(*[F.lit(i) for i in range(min(_STEPS, a * b - n))]) if a * b > n else F.array().cast("array<int>")
    found = F.aggregate(steps, permuted(pos.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(permuted(x)))
    if a * b - n <= _STEPS:
        return found
    return F.element_at(
        F.transform(F.array(found), lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no place was found in 64 steps")).cast("bigint"))), 1
    )
