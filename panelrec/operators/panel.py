"""Panel features and labels: lags, changes, acquisitions, bundles, ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrec.config import PanelSpec
from panelrec.functions import scalars as S
from panelrec.functions.arrays import first_or
from panelrec.operators.clean import group_medians
from panelrec.operators.scale import join_lookup


def _as_int(name: str) -> Column:
    return F.col(name).cast("int")


def with_lags(df: DataFrame, spec: PanelSpec, max_gap_months: int | None = None) -> DataFrame:
    """Add previous and second-previous holdings, activity lags and neighbouring dates.

    All lags share one window, hence one exchange and one sort. A lag is the
    previous row; with ``max_gap_months`` an older previous row counts as absent.
    """
    window = Window.partitionBy(spec.entity).orderBy(spec.time)
    previous = F.lag(spec.time, 1).over(window)

    def gap(days: Column) -> Column:
        return (F.year(spec.time) - F.year(days)) * 12 + F.month(spec.time) - F.month(days)

    def lagged(column: str, steps: int) -> Column:
        value = F.lag(column, steps).over(window)
        if max_gap_months is not None:
            value = F.when(gap(F.lag(spec.time, steps).over(window)) <= max_gap_months * steps, value)
        return F.coalesce(value, F.lit(0)).cast("int")

    lags = [lagged(i, 1).alias(f"has_{i}_lag1") for i in spec.items]
    lags += [lagged(i, 2).alias(f"has_{i}_lag2") for i in spec.lag2]
    if spec.activity:
        lags += [lagged(spec.activity, s).alias(f"{spec.activity}_lag{s}") for s in (1, 2)]
    following = F.lead(spec.time, 1).over(window)
    return df.select(
        "*", *lags, previous.alias("prev_snapshot"), following.alias("next_snapshot")
    )


def acquired(item: str) -> Column:
    """Held now and not at the previous snapshot; needs ``with_lags``."""
    return (F.col(item) == 1) & (F.col(f"has_{item}_lag1") == 0)


def added_classes(spec: PanelSpec) -> Column:
    return F.array_compact(
        F.array(*[F.when(acquired(item), F.lit(n)) for n, item in enumerate(spec.targets, 1)])
    )


def added_names(spec: PanelSpec) -> Column:
    return F.array_compact(F.array(*[F.when(acquired(i), F.lit(i)) for i in spec.targets]))


def velocity(spec: PanelSpec) -> dict[str, Column]:
    return {
        f"delta_{i}": _as_int(f"has_{i}_lag1") - _as_int(f"has_{i}_lag2") for i in spec.deltas
    }


def portfolio(spec: PanelSpec) -> dict[str, Column]:
    """Totals of previous holdings over all items and of the tracked ones before that."""
    now = sum((_as_int(f"has_{i}_lag1") for i in spec.items), F.lit(0))
    before = sum((_as_int(f"has_{i}_lag2") for i in spec.lag2), F.lit(0))
    return {
        "total_products_lag1": now,
        "total_products_lag2": before,
        "delta_total_products": now - before,
        "has_any_product_lag1": F.when(now > 0, 1).otherwise(0),
    }


def bundles(spec: PanelSpec) -> dict[str, Column]:
    return {
        name: sum((F.col(f"has_{i}_lag1").cast("double") for i in parts), F.lit(0.0)) / float(len(parts))
        for name, parts in spec.bundles.items()
    }


def eligibility(spec: PanelSpec) -> dict[str, Column]:
    return {
        name: F.when(
            (F.col(f"has_{held}_lag1") == 1) & (F.col(f"has_{missing}_lag1") == 0), 1
        ).otherwise(0)
        for name, (held, missing) in spec.eligibility.items()
    }


def money(spec: PanelSpec, median: Column) -> dict[str, Column]:
    """Amount, tenure and age features; ``median`` is the row's group median."""
    out: dict[str, Column] = {}
    if spec.amount:
        out["log_income"] = F.log1p(spec.amount)
        out["income_to_province_ratio"] = S.ratio_or_one(F.col(spec.amount), median)
    if spec.joined:
        out["months_as_customer"] = S.months_since(F.col(spec.time), F.col(spec.joined))
    if spec.age and spec.tenure:
        out["age_at_join"] = S.age_at_join(F.col(spec.age), F.col(spec.tenure))
    return out


def panel_features(
    df: DataFrame,
    spec: PanelSpec,
    explode: bool = True,
    require_history: bool = True,
    max_gap_months: int | None = None,
    medians: DataFrame | None = None,
    newest_only: bool = False,
) -> DataFrame:
    """All features and the ``target_class`` label of a clean panel.

    Windows run on the panel before labels are exploded, so a row with two
    acquisitions does not shift anybody's lags. ``medians`` is the fitted
    (group, median) table; without it one is fitted on ``df``.
    """
    table = with_lags(df, spec, max_gap_months)
    median = F.lit(None).cast("double")
    if spec.amount and spec.group:
        fitted = group_medians(df, spec.group, spec.amount) if medians is None else medians
        table = join_lookup(table, fitted.withColumnRenamed("median", "_median"), [spec.group])
        median = F.col("_median")
    features = {
        **velocity(spec), **portfolio(spec), **bundles(spec), **eligibility(spec),
        **money(spec, median), **S.calendar(F.col(spec.time)),
    }
    if spec.activity:
        features["activity_delta"] = _as_int(f"{spec.activity}_lag1") - _as_int(f"{spec.activity}_lag2")
    removed = {*spec.items, *spec.drop, "_median", "prev_snapshot", "next_snapshot"}
    kept = [c for c in table.columns if c not in removed]
    if require_history:
        table = table.where(F.col("prev_snapshot").isNotNull())
    if newest_only:
        table = table.where(F.col("next_snapshot").isNull())
    label = added_classes(spec)
    if explode:
        label = F.explode(F.when(F.size(label) == 0, F.array(F.lit(0))).otherwise(label))
    else:
        label = first_or(label, F.lit(0))
    return table.select(
        *kept, *[value.alias(name) for name, value in features.items()], label.alias("target_class")
    )


def holdout_targets(holdout: DataFrame, previous: DataFrame, spec: PanelSpec) -> DataFrame:
    """Label table of the newest snapshot against the one before it."""
    columns = [spec.entity, spec.time, *spec.targets]
    slim = PanelSpec(entity=spec.entity, time=spec.time, targets=spec.targets)
    both = holdout.select(*columns, F.lit(1).alias("_new")).unionByName(
        previous.select(*columns, F.lit(0).alias("_new"))
    )
    table = with_lags(both, slim).where(F.col("_new") == 1)
    classes = added_classes(spec)
    return table.select(
        spec.entity,
        spec.time,
        first_or(classes, F.lit(0)).alias("target_class"),
        classes.alias("target_classes"),
        added_names(spec).alias("added_products"),
        *[F.when(acquired(i), 1).otherwise(0).cast("tinyint").alias(f"added_{i}") for i in spec.targets],
    )


def serving_features(df: DataFrame, spec: PanelSpec, medians: DataFrame | None = None) -> DataFrame:
    """Feature row of every entity's newest snapshot, from the batch code path.

    The newest row is the one without a successor in the lag window, so it costs no
    further shuffle.
    """
    return panel_features(
        df, spec, explode=False, require_history=False, medians=medians, newest_only=True
    )
