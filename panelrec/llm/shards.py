"""Sharding by a Feistel permutation of global row numbers, with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROUNDS = 6
WALK = 64
MULTIPLIER = 2654435761


def global_row_numbers(docs: DataFrame, by: list[Column], rows_per_bucket: int = 20_000, name: str = "row_no") -> DataFrame:
    """Number all rows 0..n-1 without gaps, reproducibly, with no global sort.

    Rows fall into hash buckets of about ``rows_per_bucket`` rows by ``by`` and a hash of all columns,
    so repeated rows of one id spread as little as they must; bucket counts give each bucket's first number and
    a window inside the bucket the rest. ``by`` orders rows; equal rows are interchangeable.
    """
    n = docs.count()
    buckets = max(1, -(-n // rows_per_bucket))
    columns = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in by]
    hashed = docs.withColumn("__h", F.xxhash64(*columns))
    hashed = hashed.withColumn("__b", F.pmod("__h", F.lit(buckets)).cast("int"))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__b", F.coalesce(before, F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__b").orderBy("__h", *columns)
    return (
        hashed.withColumn("__r", F.row_number().over(inside)).join(offsets, "__b")
        .withColumn(name, F.col("__o") + F.col("__r") - 1).drop("__h", "__b", "__r", "__o")
    )


def halves(n: int) -> tuple[int, int]:
    """Radices (a, b) of the two halves: a * b covers 0..n-1 and exceeds n by less than a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def feistel(value: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0..a*b-1: an alternating Feistel network over Z_a x Z_b."""
    pair = F.struct(F.floor(value / b).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    for i in range(ROUNDS):
        pair = _round(pair, (seed * 40503 + i * 7919 + 12345) & 0x7FFFFFFF, i % 2 == 0, a, b)
    return F.element_at(F.transform(F.array(pair), lambda x: x["l"] * F.lit(b) + x["r"]), 1)


def _round(pair: Column, key: int, left: bool, a: int, b: int) -> Column:
    """Add a mix of one half to the other; a one-element array keeps the nested pair from being evaluated twice."""
    def mixed(x: Column) -> Column:
        y = (x + F.lit(key)).bitwiseAND(0x7FFFFFFF) * F.lit(MULTIPLIER)
        return F.shiftrightunsigned(y.bitwiseXOR(F.shiftrightunsigned(y, 17)).bitwiseAND((1 << 62) - 1), 5)

    def step(x: Column) -> Column:
        if left:
            return F.struct(F.pmod(x["l"] + mixed(x["r"]), F.lit(a)).alias("l"), x["r"].alias("r"))
        return F.struct(x["l"].alias("l"), F.pmod(x["r"] + mixed(x["l"]), F.lit(b)).alias("r"))
    return F.element_at(F.transform(F.array(pair), step), 1)


def permuted(docs: DataFrame, n: int, seed: int, row_no: str = "row_no", name: str = "position") -> DataFrame:
    """Add the permuted position of each row number in 0..n-1.

    Cycle walking: a result of n or more is permuted again until it falls below n. Fewer than sqrt(n) + 1 of the
    a * b places lie outside, so a walk of ``WALK`` steps ends but for a chance below 1e-60 (and always where n is
    small); a walk that does not end raises instead of giving a wrong place.
    """
    a, b = halves(n)
    first = feistel(F.col(row_no).cast("long"), a, b, seed)
    place = first if a * b == n else F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), first,
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)),
    )
    out = docs.withColumn(name, place)
    return out.withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(
        F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, by: list[Column] | None = None) -> DataFrame:
    """Give every row its ``row_no``, ``position``, ``shard`` and ``slot``.

    shard = position mod shards, slot = position div shards: shard sizes differ by one at most and slots are
    gapless; both follow from the row number alone. Null ids and texts are ordered as values of their own;
    equal rows get different numbers; an empty table gives an empty result.
    """
    by = by or [F.col(c) for c in docs.columns]
    n = docs.count()
    numbered = permuted(global_row_numbers(docs, by), n, seed)
    return numbered.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn(
        "slot", F.floor(F.col("position") / shards).cast("long"))
