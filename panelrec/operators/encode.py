"""Encoders and scalers: fit a small table, apply it to any table or stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.functions import scalars as S
from panelrec.functions.arrays import clipped
from panelrec.operators.scale import (
    bounded_table,
    column_quantiles,
    join_lookup,
    ranked_table,
)


def long_form(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), kind: str = "double") -> DataFrame:
    """(keys, column, value) rows of the named columns, cast to one type."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns]
    )
    return df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.column", "_cell.value")


# ------------------------------------------------------------------ encoders

def fit_frequency_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the most frequent value gets 0, ties by value."""
    counts = long_form(df, columns, kind="string").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = [F.desc("n"), F.asc_nulls_first("value")]
    return ranked_table(counts, ["column"], order, "code").select("column", "value", "code")


def fallback_codes(codes: DataFrame) -> DataFrame:
    """Code of unseen values per column: UNKNOWN's, else OTHER's, else max + 1."""
    def code_of(token: str) -> Column:
        return F.max(F.when(F.col("value") == token, F.col("code")))

    return codes.groupBy("column").agg(
        F.coalesce(code_of("UNKNOWN"), code_of("OTHER"), F.max("code") + 1).alias("fallback")
    )


def apply_frequency_codes(
    df: DataFrame,
    codes: DataFrame,
    columns: Sequence[str],
    overrides: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Replace each column by its code; a fixed override map replaces the fitted one."""
    overrides = overrides or {}
    small = bounded_table(codes)
    codes = codes if small is None else small
    unseen = {r["column"]: r["fallback"] for r in fallback_codes(codes).where(F.col("column").isin(list(columns))).collect()}
    out = df
    for name in columns:
        if name in overrides:
            fixed = overrides[name]
            pairs = [F.lit(x) for pair in fixed.items() for x in pair]
            code = F.coalesce(
                F.try_element_at(F.create_map(*pairs), F.col(name).cast("string")),
                F.lit(max(fixed.values()) + 1),
            )
            out = out.withColumn(name, code)
            continue
        mine = codes.where(F.col("column") == name).select(
            F.col("value").alias("_key"), F.col("code").alias("_code")
        )
        keyed = out.withColumn("_key", F.col(name).cast("string"))
        code = F.coalesce(F.col("_code"), F.lit(unseen.get(name, 0))).cast("int")
        out = join_lookup(keyed, mine, ["_key"]).select(
            *[code.alias(c) if c == name else F.col(c) for c in out.columns]
        )
    return out


def ordinal_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): values in sorted order, nulls left out."""
    values = long_form(df, columns, kind="string").where(F.col("value").isNotNull()).distinct()
    return ranked_table(values, ["column"], [F.asc("value")], "code")


# ------------------------------------------------------------------- scalers

def global_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One mean and population deviation over all cells, with the null count."""
    sums = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    known = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns]
    row = df.agg(
        F.sum(reduce(lambda a, b: a + b, sums)).alias("s"),
        F.sum(reduce(lambda a, b: a + b, [x * x for x in sums])).alias("q"),
        F.sum(reduce(lambda a, b: a + b, known)).alias("n"),
        (F.count(F.lit(1)) * len(columns)).alias("cells"),
    )
    mean = F.col("s") / F.col("n")
    return row.select(
        mean.alias("mean"),
        F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"),
        (F.col("cells") - F.col("n")).alias("nulls"),
    )


def apply_zscore(df: DataFrame, columns: Sequence[str], mean: float, std: float, clip: float | None = None) -> DataFrame:
    def scaled(name: str) -> Column:
        z = (F.col(name).cast("double") - F.lit(mean)) / F.lit(std)
        return z if clip is None else clipped(z, -clip, clip)

    return df.select(*[scaled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def encode_and_scale(
    df: DataFrame,
    codes: DataFrame,
    categorical: Sequence[str],
    features: Sequence[str],
    mean: float,
    std: float,
    overrides: dict[str, dict[str, int]] | None = None,
    clip: float | None = None,
) -> DataFrame:
    """Fitted codes, then the fitted z-score; the same step for batch and serving rows."""
    return apply_zscore(apply_frequency_codes(df, codes, categorical, overrides), features, mean, std, clip)


def unscaled(value: Column, mean: float, std: float) -> Column:
    return value * F.lit(std) + F.lit(mean)


def scaled_threshold(raw: float, mean: float, std: float) -> float:
    """A raw threshold on the scaled axis."""
    return (raw - mean) / std


def fit_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Moments and range of every column in one pass; one row reaches the driver."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [
            F.avg(x).alias(f"{c}|mean"), F.stddev_pop(x).alias(f"{c}|std"),
            F.stddev_samp(x).alias(f"{c}|std1"), F.min(x).alias(f"{c}|min"),
            F.max(x).alias(f"{c}|max"), F.sum(F.when(x.isNull(), 1).otherwise(0)).alias(f"{c}|nulls"),
        ]
    row = df.agg(*aggs).first().asDict()
    return {c: {k: row[f"{c}|{k}"] for k in ("mean", "std", "std1", "min", "max", "nulls")} for c in columns}


def _each(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    return df.select(*[exprs.get(c, F.col(c)).alias(c) for c in df.columns])


def scale_standard(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    stats = fit_columns(fit if fit is not None else df, columns)
    return _each(df, {
        c: (F.col(c).cast("double") - F.lit(s["mean"])) / F.lit(s["std"] or 1.0) for c, s in stats.items()
    })


def _span(low: float | None, high: float | None) -> float:
    """Distance to divide by; 1 where there is none, as in a column of one value or of nulls, which stay null."""
    return 1.0 if low is None or high is None else (high - low) or 1.0


def scale_minmax(df: DataFrame, columns: Sequence[str], low: float = -1.0, high: float = 1.0, fit: DataFrame | None = None) -> DataFrame:
    stats = fit_columns(fit if fit is not None else df, columns)
    return _each(df, {
        c: (F.col(c).cast("double") - F.lit(s["min"])) / F.lit(_span(s["min"], s["max"])) * (high - low) + low
        for c, s in stats.items()
    })


def scale_robust(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Centre on the median, divide by the interquartile range."""
    stats = column_quantiles(fit if fit is not None else df, columns, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    return _each(df, {
        c: (F.col(c).cast("double") - F.lit(s["q2"])) / F.lit(_span(s["q1"], s["q3"]))
        for c, s in stats.items()
    })


def yeo_johnson(x: Column, power: Column) -> Column:
    near_zero, near_two = F.abs(power) < 1e-12, F.abs(power - 2.0) < 1e-12
    return F.when(
        x >= 0,
        F.when(near_zero, F.log1p(x)).otherwise((F.pow(x + 1.0, power) - 1.0) / F.when(near_zero, 1.0).otherwise(power)),
    ).otherwise(
        F.when(near_two, -F.log1p(-x)).otherwise(
            -(F.pow(1.0 - x, 2.0 - power) - 1.0) / F.when(near_two, 1.0).otherwise(2.0 - power)
        )
    )


def fit_power(df: DataFrame, columns: Sequence[str], low: float = -3.0, high: float = 3.0, steps: int = 60) -> DataFrame:
    """(column, power, loglik): the grid power of the largest Yeo-Johnson likelihood.

    Every cell meets every grid power, but sums combine before the shuffle, so only
    columns times powers rows move.
    """
    grid = F.array(*[F.lit(round(low + (high - low) * i / steps, 10)) for i in range(steps + 1)])
    cells = long_form(df, columns).where(F.col("value").isNotNull())
    moments = (
        cells.select("column", "value", F.explode(grid).alias("power"))
        .select(
            "column", "power",
            yeo_johnson(F.col("value"), F.col("power")).alias("t"),
            (F.signum("value") * F.log1p(F.abs("value"))).alias("j"),
        )
        .groupBy("column", "power")
        .agg(F.count(F.lit(1)).alias("n"), F.var_pop("t").alias("v"), F.sum("j").alias("j"))
    )
    scored = moments.where(F.col("v") > 0).withColumn(
        "loglik", -F.col("n") / 2.0 * F.log("v") + (F.col("power") - 1.0) * F.col("j")
    )
    return scored.groupBy("column").agg(
        F.max_by("power", F.struct("loglik", -F.col("power"))).alias("power"), F.max("loglik").alias("loglik")
    )


def scale_power(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Yeo-Johnson with fitted powers, then standardised by the fitted rows."""
    powers = {r["column"]: r["power"] for r in fit_power(fit if fit is not None else df, columns).collect()}
    moved = {c: yeo_johnson(F.col(c).cast("double"), F.lit(float(p))) for c, p in powers.items()}
    return scale_standard(_each(df, moved), list(powers), _each(fit, moved) if fit is not None else None)


def impute_mean(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    stats = fit_columns(fit if fit is not None else df, columns)
    return _each(df, {c: F.coalesce(F.col(c).cast("double"), F.lit(s["mean"])) for c, s in stats.items()})


def missing_indicators(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Add ``<c>_missing`` for the columns with a null in the fit table."""
    stats = fit_columns(fit if fit is not None else df, columns)
    return df.select(
        "*",
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c, s in stats.items() if s["nulls"] > 0],
    )


def normalize_masked(df: DataFrame, columns: Sequence[str], context: Column) -> DataFrame:
    """Standardise by the sample deviation of context rows plus 1e-6."""
    stats = fit_columns(df.where(context), columns)
    return _each(df, {
        c: (F.col(c).cast("double") - F.lit(s["mean"])) / F.lit(s["std1"] + 1e-6) for c, s in stats.items()
    })


def sigma_clip(df: DataFrame, columns: Sequence[str], n_sigma: float = 4.0) -> DataFrame:
    """Clip to mean +- n deviations, the deviation taken again without outliers.

    Second-pass deviations are around the mean of the kept rows; the clip range
    stays centred on the mean of all rows.
    """
    first = fit_columns(df, columns)
    kept = df.select(*[
        F.when(
            F.abs(F.col(c).cast("double") - F.lit(s["mean"])) <= F.lit(n_sigma * s["std1"]), F.col(c).cast("double")
        ).alias(c)
        for c, s in first.items()
    ])
    second = fit_columns(kept, columns)
    return _each(df, {
        c: clipped(
            F.col(c).cast("double"),
            first[c]["mean"] - n_sigma * second[c]["std1"],
            first[c]["mean"] + n_sigma * second[c]["std1"],
        )
        for c in columns
    })


def column_profile(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Mean, variance and least-squares line against the target, per column."""
    cells = long_form(df, columns, [target]).withColumn("value", F.coalesce("value", F.lit(0.0)))
    y = F.col(target).cast("double")
    return cells.groupBy("column").agg(
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.when(F.max("value") > F.min("value"), F.regr_slope(y, F.col("value"))).alias("slope"),
        F.when(F.max("value") > F.min("value"), F.regr_intercept(y, F.col("value"))).alias("intercept"),
    )


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns holding exactly the values 0 and 1."""
    return (
        long_form(df, columns)
        .groupBy("column")
        .agg(
            F.min("value").alias("lo"), F.max("value").alias("hi"),
            F.max(F.when(F.col("value").isin(0.0, 1.0), 0).otherwise(1)).alias("other"),
        )
        .where((F.col("lo") == 0.0) & (F.col("hi") == 1.0) & (F.col("other") == 0))
        .select("column")
    )


def column_subsample(names: Sequence[str], m: int, seed: int) -> list[str]:
    """First ``m`` column names in a reproducible random order."""
    import hashlib

    order = sorted(names, key=lambda c: (hashlib.md5(f"{seed}|{c}".encode()).hexdigest(), c))
    return order[:m]
