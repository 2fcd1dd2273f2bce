"""Transforms that are fitted once, kept as small tables, and applied to any rows later: quantile maps and projections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.functions import scalars as S
from panelrec.functions.arrays import clipped
from panelrec.operators.scale import join_lookup, running_totals
from panelrec.session import staged

POINTS = 1000

# ------------------------------------------------------------- quantile maps


def _points_of(df: DataFrame, column: str, points: int) -> DataFrame:
    """One row ``(column, points)``: ``points`` evenly spaced quantiles, at most one a row, with linear interpolation.

    Values are counted first; prefix sums give each distinct value its span of ranks, and only values whose span
    holds a rank that is asked for go on, so the sort never meets in one task and the result is as long as the map.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    rows = values.agg(F.sum("n")).first()[0] or 0
    if not rows:
        return df.sparkSession.createDataFrame([(column, [])], "column string, points array<double>")
    last, steps = rows - 1, max(min(points, rows) - 1, 1)

    def ks(low: Column, high: Column) -> Column:
        """Points k whose lower rank, floor(k * last / steps), lies in low .. high - 1."""
        first = F.greatest(-F.floor(-low * steps / F.lit(max(last, 1))).cast("long"), F.lit(0))
        end = F.least(-F.floor(-high * steps / F.lit(max(last, 1))).cast("long") - 1, F.lit(steps if last else 0))
        return F.when(first <= end, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))

    low = F.col("cum_n") - F.col("n")
    placed = running_totals(values, "value", ["n"])
    lower = placed.select("value", F.explode(ks(low, F.col("cum_n"))).alias("k"), F.lit(0).alias("side"))
    upper = placed.select("value", F.explode(ks(low - 1, F.col("cum_n") - 1)).alias("k"), F.lit(1).alias("side"))
    ends = lower.unionByName(upper).groupBy("k").agg(
        F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    part = F.pmod(F.col("k") * F.lit(last), F.lit(steps)).cast("double") / F.lit(float(steps))
    at = F.when(part > 0, F.col("a") + (F.col("b") - F.col("a")) * part).otherwise(F.col("a"))
    return ends.agg(F.array_sort(F.collect_list(F.struct("k", at.alias("v")))).alias("all")).select(
        F.lit(column).alias("column"), F.transform("all", lambda s: s["v"]).alias("points"))


def fit_quantiles(df: DataFrame, columns: Sequence[str], points: int = POINTS) -> DataFrame:
    """``(column, points)`` of each column: a table of a few thousand numbers to keep and to apply."""
    return reduce(DataFrame.unionByName, [_points_of(df, c, points) for c in columns])


def constants(values: Sequence[float]) -> Column:
    """An array of numbers, told in one expression: a column for each would take the driver seconds."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def quantile_places(df: DataFrame, column: str, points: Sequence[float], name: str) -> DataFrame:
    """Add ``name``, the place of a column's value in [0, 1] on a fitted map: linear between points, in the middle of equal
    points, at the ends beyond. Points are bisected in the row; nothing is joined."""
    if not len(points):
        return df.withColumn(name, F.lit(None).cast("double"))
    distinct, first, copies = np.unique(np.asarray(points, float), return_index=True, return_counts=True)
    cut = Bucketizer(splits=[float("-inf"), *distinct.tolist(), float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")

    def listed(values: np.ndarray) -> Column:
        return F.get(constants(values), F.col("_b").cast("int") - 1)

    last = first + copies - 1
    steps = np.append(np.diff(distinct), 1.0)
    top = float(max(len(points) - 1, 1))
    place = (
        F.when(F.col("_x").isNull(), F.lit(None)).when(F.col("_x") < float(distinct[0]), 0.0)
        .when(F.col("_x") > float(distinct[-1]), len(points) - 1.0)
        .when(F.col("_x") == listed(distinct), listed((first + last) / 2.0))
        .otherwise(listed(last) + (F.col("_x") - listed(distinct)) / listed(steps)) / F.lit(top))
    return cut.transform(df.withColumn("_x", F.col(column).cast("double"))).withColumn(name, place).drop("_x", "_b")


def _moved(u: Column, output: str) -> Column:
    return 2.0 * u - 1.0 if output == "uniform" else F.when(u.isNotNull(), S.inverse_normal(clipped(u, 1e-7, 1 - 1e-7)))


def apply_quantiles(df: DataFrame, maps: dict[str, Sequence[float]], output: str = "uniform") -> DataFrame:
    """Columns moved to their places on fitted maps: ``uniform`` on [-1, 1] or ``normal``; nulls stay, values beyond the
    fitted ones get the ends."""
    out = df
    for i, (c, points) in enumerate(maps.items()):
        out = quantile_places(out, c, points, f"_u{i}")
    at = {c: F.col(f"_u{i}") for i, c in enumerate(maps)}
    return out.select(*[_moved(at[c], output).alias(c) if c in at else F.col(c) for c in df.columns])


def quantile_positions(df: DataFrame, column: str) -> DataFrame:
    """``(value, u)``: the middle of the ranks, in [0, 1], of every distinct value."""
    values = staged(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    rows = values.agg(F.sum("n")).first()[0] or 0
    if not rows:
        return values.select("value", F.lit(None).cast("double").alias("u"))
    middle = F.col("cum_n") - F.col("n") + (F.col("n") - 1) / 2.0
    return running_totals(values, "value", ["n"]).select("value", (middle / F.lit(float(max(rows - 1, 1)))).alias("u"))


def scale_quantile(df: DataFrame, columns: Sequence[str], output: str = "uniform", fit: DataFrame | None = None, points: int = POINTS) -> DataFrame:
    """Quantile transform by a map of ``points`` fitted on ``fit``, or by the table's own ranks, all of them and exactly.

    Without ``fit`` no map is made (``points`` is not used): every distinct value gets the middle of its ranks, nulls stay.
    """
    if fit is not None:
        return apply_quantiles(df, {r["column"]: r["points"] for r in fit_quantiles(fit, columns, points).collect()}, output)
    out = df
    for i, c in enumerate(columns):
        places = quantile_positions(df, c).select(F.col("value").alias("_x"), F.col("u").alias(f"_u{i}"))
        out = join_lookup(out.withColumn("_x", F.col(c).cast("double")), places, ["_x"]).drop("_x")
    at = {c: F.col(f"_u{i}") for i, c in enumerate(columns)}
    return out.select(*[_moved(at[c], output).alias(c) if c in at else F.col(c) for c in df.columns])


# --------------------------------------------------------------- projections


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(0)
    return np.asarray(lists.flatten(), float).reshape(len(lists), -1)


def gram(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of a vector column in one pass: tasks add up outer products, a group a matrix row adds the
    tasks', and the driver gets one matrix. Null vectors are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.asarray(table["row"].combine_chunks().flatten()).reshape(table.num_rows, -1)
        return pa.table({"i": table["i"].slice(0, 1), "row": pa.array([rows.sum(0)], pa.list_(pa.float64()))})

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, row array<double>")
    rows = parts.groupBy("i").applyInArrow(add, "i int, row array<double>").orderBy("i").collect()  # width + 1 rows
    full = np.array([r["row"] for r in rows])
    return (0, np.zeros(0), np.zeros((0, 0))) if not len(full) else (int(full[0, 0]), full[0, 1:], full[1:, 1:])


def fit_pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """``(component, variance, loadings)`` of the ``k`` directions of largest variance around the mean, largest first.

    A direction points where its loading of largest size, the first of equals, is positive.
    """
    n, sums, products = gram(df, vector)
    if not n:
        return df.sparkSession.createDataFrame([], "component int, variance double, loadings array<double>")
    mean = sums / n
    values, axes = np.linalg.eigh((products - n * np.outer(mean, mean)) / max(n - 1, 1))
    out = []
    for c, at in enumerate(np.argsort(-values, kind="stable")[:k]):
        axis = axes[:, at]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        out.append((c, float(max(values[at], 0.0)), axis.tolist()))
    return df.sparkSession.createDataFrame(out, "component int, variance double, loadings array<double>")


def project(df: DataFrame, vector: str, fitted: DataFrame, name: str = "components") -> DataFrame:
    """Add the products of a vector with the fitted directions, the vector as it is (not centred); null stays null."""
    axes = [r["loadings"] for r in fitted.orderBy("component").collect()]
    v = F.col(vector).cast("array<double>")

    def product(axis: Sequence[float]) -> Column:
        return F.aggregate(F.zip_with(v, constants(axis), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    cells = F.array(*[product(a) for a in axes]) if axes else F.array().cast("array<double>")
    return df.withColumn(name, F.when(v.isNotNull(), cells))


def reduce_features(df: DataFrame, vector: str, most: int, fit: DataFrame | None = None) -> DataFrame:
    """Vectors longer than ``most`` projected on as many directions; shorter ones as they are."""
    table = fit if fit is not None else df
    width = table.agg(F.max(F.size(vector))).first()[0] or 0
    if width <= most:
        return df
    return project(df, vector, fit_pca(table, vector, most), vector)
