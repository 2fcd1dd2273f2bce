"""Per-row ranking quality of a recommended list against an actual list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hit_flags(recs: Column, actual: Column, k: int) -> Column:
    return F.transform(F.slice(recs, 1, k), lambda item: F.array_contains(actual, item))


def precision_sum(recs: Column, actual: Column, k: int) -> Column:
    """Sum over hit positions of hits-so-far divided by position."""
    start = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("hits"), F.lit(0.0).alias("score")
    )

    def step(acc: Column, hit: Column) -> Column:
        hits = acc["hits"] + F.when(hit, 1).otherwise(0)
        gain = F.when(hit, hits.cast("double") / (acc["pos"] + 1)).otherwise(0.0)
        return F.struct(
            (acc["pos"] + 1).alias("pos"), hits.alias("hits"), (acc["score"] + gain).alias("score")
        )

    return F.aggregate(hit_flags(recs, actual, k), start, step, lambda acc: acc["score"])


def average_precision(recs: Column, actual: Column, k: int) -> Column:
    """AP@k divided by min(actual, k); null when nothing is actual."""
    return F.when(
        F.size(actual) > 0,
        precision_sum(recs, actual, k) / F.least(F.size(actual), F.lit(k)),
    )


def discounted_gain(recs: Column, actual: Column, k: int) -> Column:
    """NDCG@k; null when nothing is actual."""
    gains = F.transform(
        hit_flags(recs, actual, k),
        lambda hit, i: F.when(hit, 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0),
    )
    ideal = F.aggregate(
        F.slice(F.array(*[F.lit(float(i)) for i in range(2, k + 2)]), 1, F.greatest(F.least(F.size(actual), F.lit(k)), F.lit(0))),
        F.lit(0.0),
        lambda acc, d: acc + 1.0 / F.log2(d),
    )
    reached = F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)
    return F.when(F.size(actual) > 0, reached / ideal)


def reciprocal_rank(recs: Column, actual: Column, k: int) -> Column:
    first = F.array_position(hit_flags(recs, actual, k), True)
    return F.when(
        F.size(actual) > 0, F.when(first > 0, F.lit(1.0) / first).otherwise(0.0)
    )


def matched(recs: Column, actual: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(recs, 1, k), actual))


def recall(recs: Column, actual: Column, k: int) -> Column:
    return F.when(
        F.size(actual) > 0, matched(recs, actual, k).cast("double") / F.size(actual)
    )


def hit(recs: Column, actual: Column, k: int) -> Column:
    return F.when(
        F.size(actual) > 0, F.when(matched(recs, actual, k) > 0, 1.0).otherwise(0.0)
    )
