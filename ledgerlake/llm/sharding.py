"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in a fixed order. A keyed Feistel network permutes
0..a*b-1, where a*b is the least product at or above n among ``SPANS`` nearly
square grids; a result at or beyond n is permuted again until it falls below n
(cycle walking), so 0..n-1 is permuted. Position p then goes to shard p mod s,
slot p div s: counts differ by one at most, slots have no gaps, and shard and
slot of any row number, and the row number of any place, can be computed.

Only a*b - n numbers lie beyond n, and a walk meets each at most once, so
a*b - n further steps are always enough; only rows that leave the range take
any (fewer than the square root of n rows).
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, global_row_numbers

ROUNDS = 6
SPANS = 256
SEED = 20240229


def grid(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, nearly square, least a * b among ``SPANS`` choices of a."""
    n = max(n, 1)
    a0 = math.isqrt(n - 1) + 1
    return min(((a, -(-n // a)) for a in range(a0, a0 + SPANS)), key=lambda g: (g[0] * g[1], g[0]))


def _div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def _permuted(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network; every round adds a hash of one half to the other."""
    right = F.pmod(x, F.lit(b).cast("long"))
    left = _div(x, F.lit(b).cast("long"))
    for i in range(ROUNDS):
        key = F.lit(seed + i).cast("long")
        if i % 2:
            m = F.lit(b).cast("long")
            right = F.pmod(right + F.pmod(F.xxhash64(left, key), m), m)
        else:
            m = F.lit(a).cast("long")
            left = F.pmod(left + F.pmod(F.xxhash64(right, key), m), m)
    return left * F.lit(b).cast("long") + right


def permuted_number(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``x`` among ``n`` rows."""
    a, b = grid(n)
    out, size = _permuted(x, a, b, seed), F.lit(n).cast("long")
    if a * b == n:
        return out
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(a * b - n)), out,
        lambda at, _: F.when(at >= size, _permuted(at, a, b, seed)).otherwise(at),
    )
    return F.when(out >= size, walk).otherwise(out)


def place_of(number: int, n: int, n_shards: int, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number, without a Spark job."""
    a, b = grid(n)

    def mixed(v: int, key: int, m: int) -> int:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        return (h - (1 << 64) if h >> 63 else h) % m

    while True:
        left, right = divmod(number, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + mixed(left, seed + i, b)) % b
            else:
                left = (left + mixed(right, seed + i, a)) % a
        number = left * b + right
        if number < n:
            return number % n_shards, number // n_shards


def shard(rows: DataFrame, n_shards: int, order: list[str | Column], seed: int = SEED) -> DataFrame:
    """``rows`` with ``row_number`` long, ``shard`` int and ``slot`` long.

    Row numbers follow ``order`` (nulls first); rows equal in it take
    neighbouring numbers. Columns of these three names are replaced, an empty
    table gives an empty one, and no other column is read.
    """
    rows = rows.drop("row_number", "shard", "slot")
    number, place = fresh(rows, "_number", "_place")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    numbered, n = global_row_numbers(rows, keys, number)
    placed = numbered.withColumn(place, permuted_number(F.col(number), n, seed))
    return placed.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.col(number).cast("long").alias("row_number"),
        F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
        _div(F.col(place), F.lit(n_shards).cast("long")).alias("slot"),
    )
