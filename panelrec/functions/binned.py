"""Predictive distributions held as logits over bins with fixed borders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrec.functions.arrays import argmax, dot, let, softmax


def even_borders(low: float, high: float, bins: int, mean: Column | None = None, std: Column | None = None) -> Column:
    """``bins + 1`` evenly spaced borders, optionally moved to target units."""
    step = (high - low) / bins
    mean = F.lit(0.0) if mean is None else mean
    std = F.lit(1.0) if std is None else std
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins)), lambda i: (F.lit(low) + i * F.lit(step)) * std + mean
    )


def widths(borders: Column) -> Column:
    return F.transform(
        F.slice(borders, 2, F.size(borders) - 1), lambda hi, i: hi - F.get(borders, i)
    )


def centres(borders: Column) -> Column:
    return F.transform(
        F.slice(borders, 2, F.size(borders) - 1), lambda hi, i: (hi + F.get(borders, i)) / 2.0
    )


def binned_mean(logits: Column, borders: Column) -> Column:
    return dot(softmax(logits), centres(borders))


def binned_mode(logits: Column, borders: Column) -> Column:
    """Centre of the densest bin; the lowest bin wins a tie."""
    density = F.zip_with(softmax(logits), widths(borders), lambda p, w: p / w)
    return let(argmax(density), lambda i: F.get(centres(borders), i))


def binned_quantile(logits: Column, borders: Column, level: Column) -> Column:
    """Linear interpolation inside the first bin whose cumulative share reaches ``level``.

    A first bin without any share, as where all before the level underflow, gives its left border.
    """
    start = F.struct(
        F.lit(0.0).alias("cum"), F.lit(0).alias("pos"),
        F.lit(None).cast("double").alias("out"),
    )

    def walk(probs: Column) -> Column:
        last = F.size(probs) - 1

        def step(acc: Column, p: Column) -> Column:
            left, right = F.get(borders, acc["pos"]), F.get(borders, acc["pos"] + 1)
            here = (acc["cum"] + p >= level) | (acc["pos"] == last)
            value = left + F.when(p > 0, (right - left) * (level - acc["cum"]) / p).otherwise(0.0)
            return F.struct(
                (acc["cum"] + p).alias("cum"),
                (acc["pos"] + 1).alias("pos"),
                F.when(acc["out"].isNull() & here, value).otherwise(acc["out"]).alias("out"),
            )

        return F.aggregate(probs, start, step, lambda acc: acc["out"])

    return let(softmax(logits), walk)
