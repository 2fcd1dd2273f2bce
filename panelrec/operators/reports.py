"""Report tables over metric results: IQM, pivots, bootstrap, best-of-column flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelrec.functions.scalars import draw_unit
from panelrec.operators.scale import join_lookup, ranked_table, running_totals


def iqm(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of the middle half: floor(n/4) values leave at each end, nulls ignored.

    Equal values are counted together before their places are summed up.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    placed = join_lookup(running_totals(counts, "_v", ["_c"], by, buckets=64), sizes, by, "inner")
    cut = F.floor(F.col("_n") * 0.25)
    end = F.col("cum__c")
    kept = F.greatest(
        F.least(end, F.col("_n") - cut) - F.greatest(end - F.col("_c"), cut), F.lit(0)
    )
    summed = placed.select(*by, "_v", kept.alias("_k"))
    return summed.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_k")) / F.sum("_k")).alias("iqm"))


def pivot_fill(df: DataFrame, row: str, column: str, value: str, names: Sequence[str] | None = None) -> DataFrame:
    """One column per name, those of the table unless given; a missing cell gets its row's mean.

    Cells are added as decimals of 12 places, so that the mean does not depend on their order; rows with a cell
    that has no such decimal (not finite, or 1e16 and more) are added as doubles.
    """
    if names is None:  # names become columns, so there are few
        names = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column).collect()]
    wide = df.groupBy(row).pivot(column, list(names)).agg(F.avg(value))
    cells = F.array_compact(F.array(*[F.col(f"`{n}`").cast("double") for n in names]))
    exact = F.aggregate(
        cells, F.lit(0).cast("decimal(38,12)"), lambda acc, x: (acc + x.try_cast("decimal(28,12)")).cast("decimal(38,12)")
    )
    plain = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.coalesce(exact.cast("double"), plain) / F.size(cells)
    filled = wide.withColumn("_mean", F.when(F.size(cells) > 0, mean))
    return filled.select(row, *[F.coalesce(F.col(f"`{n}`"), F.col("_mean")).alias(n) for n in names])


def iqm_bootstrap(
    df: DataFrame, by: Sequence[str], fold: str, value: str, key: str, reps: int = 20_000, seed: int = 42
) -> DataFrame:
    """Percentile interval of the IQM over resamples of each group's scores by fold.

    In every repetition each row's slot draws one score of its (group, fold), with
    replacement, by the hash of seed, repetition and row key; drawn places are
    resolved by a join.
    """
    by = list(by)
    cell = [*by, fold]
    known = df.where(F.col(value).isNotNull()).select(*cell, key, F.col(value).cast("double").alias("_x"))
    placed = ranked_table(known, cell, [F.asc("_x"), F.asc(key)], "_at")
    sizes = known.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    slots = join_lookup(known, sizes, cell, "inner").select(
        *cell, key, "_n", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")
    )
    unit = draw_unit(seed, F.col("rep"), F.col(key))
    wanted = slots.select(*cell, "rep", F.floor(unit * F.col("_n")).cast("int").alias("_at"))
    drawn = join_lookup(wanted, placed.select(*cell, "_at", "_x"), [*cell, "_at"], "inner")
    each = iqm(drawn, [*by, "rep"], "_x")
    return each.groupBy(*by).agg(
        F.percentile("iqm", F.lit(0.025)).alias("low"),
        F.percentile("iqm", F.lit(0.975)).alias("high"),
        F.avg("iqm").alias("mean"),
    )


def best_flags(df: DataFrame, highest: Sequence[str], lowest: Sequence[str]) -> DataFrame:
    """Mark per metric whether a configuration holds the best value of its column."""
    whole = Window.partitionBy(F.lit(0))
    return df.select(
        "*",
        *[(F.col(c) == F.max(c).over(whole)).alias(f"best_{c}") for c in highest],
        *[(F.col(c) == F.min(c).over(whole)).alias(f"best_{c}") for c in lowest],
    )


def merge_reports(*reports: DataFrame) -> DataFrame:
    """Stack metric tables; missing columns become null."""
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report, allowMissingColumns=True)
    return out


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("overwrite").option("header", True).format(kind).save(path)
