"""Panel cleaning: tokens, casts, recodes, flags, imputation, capping, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.functions import scalars as S
from panelrec.operators.scale import (
    bounded_table,
    group_quantiles,
    join_lookup,
    medians_and_overall,
    newest,
)


def clean_tokens(df: DataFrame, tokens: Sequence[str] = C.NULL_TOKENS) -> DataFrame:
    """Trim every string column and turn null tokens into null."""
    return df.select(
        *[
            S.blank_to_null(F.col(c), tokens).alias(c) if kind == "string" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def group_medians(df: DataFrame, group: str, value: str, mode: str = "exact") -> DataFrame:
    """Median per group, null groups included. ``approx`` allows 1/10000 rank error."""
    if mode == "approx":
        known = df.where(F.col(value).isNotNull())
        return known.groupBy(group).agg(
            F.percentile_approx(F.col(value).cast("double"), 0.5, 10_000).alias("median")
        )
    return group_quantiles(df, [group], value, {"median": 0.5})


def impute_by_group(
    df: DataFrame, value: str, group: str, medians: DataFrame | None = None, overall: float | None = None
) -> DataFrame:
    """Fill ``value`` with its group's median, else with the overall median.

    Fitted ``medians`` come with the ``overall`` median of the same fit; without it a group the fit has not seen
    keeps its nulls, so nothing is taken from the rows that are served.
    """
    if medians is None:
        medians, overall = medians_and_overall(df, group, value)
    filled = join_lookup(df, medians.withColumnRenamed("median", "_median"), [group])
    best = F.coalesce(
        F.col(value).cast("double"), F.col("_median"), F.lit(overall).cast("double")
    )
    return filled.select(*[best.alias(c) if c == value else F.col(c) for c in df.columns])


def clean_panel(df: DataFrame, items: Sequence[str] = C.TARGET_ITEMS + C.OTHER_ITEMS) -> DataFrame:
    """Clean a raw all-string customer panel with the catalog's column names.

    One projection does tokens, casts and recodes; income is imputed by province;
    rows without a readable join date are dropped.
    """
    raw = clean_tokens(df)
    col = F.col
    fixed: dict[str, Column] = {
        "gender": S.recoded(col("gender"), {"H": "F", "V": "M"}, "Unknown"),
        "age": S.safe_int(col("age")),
        "seniority_months": S.floor_zero(col("seniority_months")),
        "customer_type_month_start": S.code_text(col("customer_type_month_start"), "UNKNOWN"),
        "relation_type_month_start": F.coalesce(col("relation_type_month_start"), F.lit("I")),
        "customer_segment": F.coalesce(col("customer_segment"), F.lit("UNKNOWN")),
        "employee_index": F.coalesce(col("employee_index"), F.lit("N")),
        "gross_household_income": S.safe_double(col("gross_household_income")),
    }
    for name in ("snapshot_date", "join_date", "last_date_primary_customer"):
        fixed[name] = S.safe_date(col(name))
    for name in ("residence_status", "is_foreigner", "is_deceased", "spouse_employee_index"):
        fixed[name] = S.yes_flag(col(name))
    for name in ("is_new_customer", "customer_relation_primary", "is_active"):
        fixed[name] = S.flag_or_zero(col(name))
    for name in items:
        fixed[name] = S.flag_or_zero(col(name), "tinyint")
    typed = raw.select(*[fixed.get(c, col(c)).alias(c) for c in raw.columns])
    imputed = impute_by_group(typed, "gross_household_income", "province_code")
    return imputed.where(col("join_date").isNotNull())


def temporal_split(df: DataFrame, time: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff date, and rows on it."""
    day = F.lit(cutoff).cast("date")
    return df.where(F.col(time) < day), df.where(F.col(time) == day)


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column)
        .limit(n)
    )


def cap_categories(
    df: DataFrame, tops: dict[str, DataFrame], fill: Sequence[str] = (), other: str = "OTHER"
) -> DataFrame:
    """Keep the fitted top values of each column, ``other`` for the rest.

    ``fill`` columns get UNKNOWN for null. Short top lists are carried as literals, longer ones are joined.
    """
    out = {}
    names = df.columns
    for i, (column, top) in enumerate(tops.items()):
        short = bounded_table(top.select(column), 10_000)
        if short is not None:
            found = F.col(column).isin([r[0] for r in short.collect()])
        else:
            mark = f"_top{i}"
            known = top.where(F.col(column).isNotNull()).select(column).distinct().withColumn(mark, F.lit(True))
            df = join_lookup(df, known, [column])
            found = F.coalesce(F.col(mark), F.lit(False))
        out[column] = F.when(found, F.col(column)).otherwise(F.lit(other))
    for column in fill:
        out[column] = F.coalesce(F.col(column), F.lit("UNKNOWN"))
    return df.select(*[out.get(c, F.col(c)).alias(c) for c in names])


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def last_n_history(df: DataFrame, key: str, time: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows of every entity."""
    window = Window.partitionBy(key).orderBy(F.desc(time), *ties)
    return (
        df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
    )


def latest_snapshot(df: DataFrame, key: str, time: str, unique: bool = False) -> DataFrame:
    """Rows on each entity's newest date; ties stay unless dates are ``unique``."""
    if unique:
        return newest(df, [key], [time])
    last = df.groupBy(key).agg(F.max(time).alias("_last"))
    return join_lookup(df, last, [key], "inner").where(F.col(time) == F.col("_last")).drop("_last")


def drop_first_snapshot(df: DataFrame, key: str, time: str) -> DataFrame:
    previous = F.lag(time).over(Window.partitionBy(key).orderBy(time))
    return df.withColumn("_prev", previous).where(F.col("_prev").isNotNull()).drop("_prev")


def class_limit(df: DataFrame, column: str, value, n: int, order: Sequence[str]) -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).orderBy(*order).limit(n)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def feature_columns(df: DataFrame, excluded: Sequence[str] = C.NON_FEATURE_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in excluded]


def column_roles(
    df: DataFrame,
    explicit: Sequence[str] = C.EXPLICIT_CATEGORICALS,
    excluded: Sequence[str] = C.NON_FEATURE_COLUMNS,
) -> dict[str, list[str]]:
    """Categorical and numeric feature columns, by type and the explicit list."""
    roles: dict[str, list[str]] = {"categorical": [], "numeric": []}
    for name, kind in df.dtypes:
        if name not in excluded:
            roles["categorical" if kind == "string" or name in explicit else "numeric"].append(name)
    return roles
