"""Threshold sweeps in one pass, and threshold fitting.

A row fires for a threshold exactly when it fires for every looser one, so rows are
counted by how many thresholds of each axis they pass. All configurations are then
sums over that small table: rows are never multiplied by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.config import ASCENT_THETAS, NOISY_CLASSES, PRECISION_TIERS
from panelrec.functions.scalars import draw_key
from panelrec.operators.metrics import with_row_scores
from panelrec.operators.scale import bounded_table


@dataclass(frozen=True)
class Axis:
    """One swept parameter: a row passes when ``value`` compares so with the threshold."""

    name: str
    value: Column
    thresholds: tuple[float, ...]
    rule: str = ">"

    def ordered(self) -> list[float]:
        return sorted(self.thresholds, reverse=self.rule == "<=")

    def passed(self) -> Column:
        """Number of thresholds passed, loosest first."""
        tests = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t}
        test = tests[self.rule]
        return sum(
            (F.when(test(self.value, F.lit(float(t))), 1).otherwise(0) for t in self.ordered()), F.lit(0)
        )


SUMS = (
    "n", "buyers", "non_buyers", "buyer_hits", "quiet_fired", "with_truth", "cold_truth", "warm_truth",
    "ap", "cold_ap", "warm_ap", "ndcg", "rr", "hit", "recall", "alerted_truth",
)


def _row_sums() -> list[Column]:
    y, cold = F.col("y"), F.col("is_cold")
    truth = F.col("ap").isNotNull()

    def count(flag: Column) -> Column:
        return F.sum(flag.cast("int"))

    def score(name: str, flag: Column | None = None) -> Column:
        return F.sum(F.when(truth if flag is None else truth & flag, F.col(name)).otherwise(0.0))

    return [
        F.count(F.lit(1)).alias("n"), count(y > 0).alias("buyers"), count(y == 0).alias("non_buyers"),
        count((y > 0) & (F.col("cand") == y)).alias("buyer_hits"),
        count(y == 0).alias("quiet_fired"),
        count(truth).alias("with_truth"), count(truth & cold).alias("cold_truth"),
        count(truth & ~cold).alias("warm_truth"),
        score("ap").alias("ap"), score("ap", cold).alias("cold_ap"), score("ap", ~cold).alias("warm_ap"),
        score("ndcg").alias("ndcg"), score("rr").alias("rr"), score("hit").alias("hit"),
        score("recall").alias("recall"),
        count((y > 0) & truth & (F.size("base_recs") > 0)).alias("alerted_truth"),
    ]


def bundle_from_sums(fired: str = "f_", whole: str = "t_") -> list[Column]:
    """Decision metrics from fired sums and whole-table sums."""
    def f(name: str) -> Column:
        return F.col(f"{fired}{name}")

    def t(name: str) -> Column:
        return F.col(f"{whole}{name}")

    def share(part: Column, among: Column, scale: float = 1.0) -> Column:
        return F.when(among > 0, part / among * scale).otherwise(0.0)

    held = t("non_buyers") - f("quiet_fired")
    return [
        share(f("buyer_hits"), t("buyers"), 100.0).alias("buyer_top1"),
        share(held, t("non_buyers"), 100.0).alias("non_buyer_top1"),
        share(f("buyer_hits") + held, t("n"), 100.0).alias("overall_top1"),
        share(f("n"), t("n"), 100.0).alias("alert_pct"),
        share(f("ap"), t("with_truth")).alias("map7"),
        share(f("cold_ap"), t("cold_truth")).alias("cold_map7"),
        share(f("warm_ap"), t("warm_truth")).alias("warm_map7"),
        share(f("ndcg"), t("with_truth")).alias("ndcg7"),
        share(f("rr"), t("with_truth")).alias("mrr"),
        share(f("hit"), t("with_truth"), 100.0).alias("hit7"),
        share(f("recall"), t("with_truth")).alias("recall7"),
        share(f("ap"), f("alerted_truth")).alias("conditional_map7"),
    ]


def sweep(df: DataFrame, axes: Sequence[Axis], k: int = 7) -> DataFrame:
    """Decision metrics for every combination of the axes' thresholds, in one pass.

    ``df`` comes from ``with_candidates`` and carries y, actual and is_cold.
    """
    scored = with_row_scores(df, "base_recs", "actual", k)
    places = [f"_p{i}" for i in range(len(axes))]
    parts = (
        scored.select("*", *[a.passed().alias(p) for a, p in zip(axes, places)])
        .groupBy(*places)
        .agg(*_row_sums())
    )
    # From here on at most prod(len(thresholds) + 1) rows exist: run the pass once.
    local = bounded_table(parts)
    parts = parts if local is None else local
    spread = parts
    for p in places:
        spread = spread.withColumn(p, F.explode(F.sequence(F.lit(0), F.col(p))))
    fired = spread.groupBy(*places).agg(*[F.sum(s).alias(f"f_{s}") for s in SUMS])
    whole = parts.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(f"t_{s}") for s in SUMS]).first().asDict()
    grid = _grid(df, axes, places)
    out = F.broadcast(grid).join(fired, places, "left").na.fill(0)
    out = out.select("*", *[F.lit(v).alias(name) for name, v in whole.items()])
    return out.select(*[a.name for a in axes], *bundle_from_sums())


def _grid(df: DataFrame, axes: Sequence[Axis], places: Sequence[str]) -> DataFrame:
    rows: list[tuple] = [()]
    for axis in axes:
        rows = [(*r, i, float(t)) for r in rows for i, t in enumerate(axis.ordered(), 1)]
    schema = ", ".join(f"{p} int, {a.name} double" for a, p in zip(axes, places))
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass(frozen=True)
class GateConfig:
    """A named pipeline setting: propensity gate (or none) and two odds thresholds."""

    name: str
    gamma: float | None
    theta_noisy: float
    theta_clean: float


def sweep_configs(
    df: DataFrame, configs: Sequence[GateConfig], noisy: Sequence[int] = NOISY_CLASSES, k: int = 7
) -> DataFrame:
    """Metrics and saved scoring share of each named configuration, in one pass."""
    gammas = Axis("g", F.col("p_buy"), tuple(sorted({c.gamma for c in configs if c.gamma is not None})), ">=")
    thetas = Axis(
        "t", F.col("odds"), tuple(sorted({t for c in configs for t in (c.theta_noisy, c.theta_clean)}))
    )
    scored = with_row_scores(df, "base_recs", "actual", k)
    parts = (
        scored.select(
            "*", gammas.passed().alias("_g"), thetas.passed().alias("_t"),
            F.col("cand").isin(*noisy).alias("_noisy"),
        )
        .groupBy("_g", "_t", "_noisy")
        .agg(*_row_sums())
    )
    g_at = {g: i for i, g in enumerate(gammas.ordered(), 1)}
    t_at = {t: i for i, t in enumerate(thetas.ordered(), 1)}
    settings = F.array(*[
        F.struct(
            F.lit(c.name).alias("config"), F.lit(c.gamma).cast("double").alias("gamma"),
            F.lit(c.theta_noisy).alias("theta_noisy"), F.lit(c.theta_clean).alias("theta_clean"),
            F.lit(0 if c.gamma is None else g_at[c.gamma]).alias("g_need"),
            F.lit(t_at[c.theta_noisy]).alias("n_need"), F.lit(t_at[c.theta_clean]).alias("c_need"),
        )
        for c in configs
    ])
    # ``parts`` is bounded by the number of distinct thresholds, so this stays small.
    each = parts.select("*", F.explode(settings).alias("_c")).select("*", "_c.*")
    awake = F.col("_g") >= F.col("g_need")
    fired = awake & (F.col("_t") >= F.when(F.col("_noisy"), F.col("n_need")).otherwise(F.col("c_need")))
    summed = each.groupBy("config", "gamma", "theta_noisy", "theta_clean").agg(
        *[F.sum(F.when(fired, F.col(s)).otherwise(0)).alias(f"f_{s}") for s in SUMS],
        *[F.sum(s).alias(f"t_{s}") for s in SUMS],
        F.sum(F.when(awake, 0).otherwise(F.col("n"))).alias("_saved"),
    )
    return summed.select(
        "config", "gamma", "theta_noisy", "theta_clean", *bundle_from_sums(),
        (F.col("_saved") / F.col("t_n") * 100.0).alias("saved_pct"),
    )


def pareto_pick(results: DataFrame, floor: str, at_least: float, best: str, ties: Sequence[str]) -> DataFrame:
    """The result row with the largest ``best`` among those reaching the floor."""
    return results.where(F.col(floor) >= at_least).orderBy(F.desc(best), *ties).limit(1)


def verdict(results: DataFrame, key: str, baseline: str) -> DataFrame:
    """Configurations better than the baseline row by the set margins; none without a baseline row."""
    base = results.where(F.col(key) == baseline).select("map7", "cold_map7", "buyer_top1").first()
    gain = {c: F.col(c) - F.lit(base[c] if base else None).cast("double") for c in ("map7", "cold_map7", "buyer_top1")}
    better = (gain["map7"] > 0.005) | (gain["cold_map7"] > 0.02) | (
        (gain["buyer_top1"] > 2.0) & (gain["map7"] >= -0.01)
    )
    return results.where((F.col(key) != baseline) & better).select(
        key, gain["map7"].alias("map_delta"), gain["cold_map7"].alias("cold_delta"),
        gain["buyer_top1"].alias("buyer_delta"),
    )


# ------------------------------------------------------------------- fitting

def fit_tier_thresholds(breakdown: DataFrame, tiers: str = "moderate") -> DataFrame:
    """(cls, theta) from each class's precision against non-buyers."""
    value = None
    for floor, theta in PRECISION_TIERS[tiers]:
        if floor is None:
            value = value.otherwise(theta)
        else:
            value = (F if value is None else value).when(F.col("prec_vs_nb") >= floor, theta)
    return breakdown.select("cls", value.alias("theta"))


def fit_coordinate_ascent(
    df: DataFrame,
    keys: Sequence[str],
    n_classes: int = 16,
    thetas: Sequence[float] = ASCENT_THETAS,
    floor: float = 45.0,
    start: float = 1.5,
    passes: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Per-class thresholds maximising held non-buyers above a buyer accuracy floor.

    Fitted on the half of the rows drawn by hash. The table is reduced to hits and non-buyers' firings per (class, number
    of thresholds passed). A class's threshold moves only its own hits and firings, so with running sums over its axis all
    its thresholds are scored at once against the fixed sums of the other classes. A class moves to its best threshold (the
    loosest of equals) only where that beats the present one; the ascent ends with the first pass that moves no class, or
    after ``passes``. Falling short of the floor costs ten points of hold for each point of accuracy.
    """
    axis = Axis("t", F.col("odds"), tuple(thetas))
    half = F.substring(draw_key(seed, *[F.col(k) for k in keys]), 1, 1) < "8"
    hit = (F.col("y") > 0) & (F.col("y") == F.col("cand"))
    cells = (
        df.select("cand", "y", axis.passed().alias("place"), half.alias("fit"))
        .groupBy("fit", "cand", "place")
        .agg(*[F.sum(flag.cast("int")).alias(name) for name, flag in (("hit", hit), ("buyer", F.col("y") > 0), ("quiet", F.col("y") == 0))])
        .collect()  # classes times thresholds
    )
    table = np.zeros((2, 3, n_classes, len(thetas) + 1))
    for r in cells:
        table[int(r["fit"]), :, r["cand"], r["place"]] = r["hit"], r["buyer"], r["quiet"]
    fired = table[:, :, :, ::-1].cumsum(-1)[:, :, :, ::-1][..., 1:]  # rows of a class that pass a threshold of the axis
    every = table.sum((2, 3))

    def points(side: int, hits: np.ndarray, quiet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buyer accuracy and held non-buyers, in percent, from summed hits and firings."""
        return 100.0 * hits / max(every[side, 1], 1), 100.0 * (every[side, 2] - quiet) / max(every[side, 2], 1)

    levels, classes = axis.ordered(), np.arange(1, n_classes)
    chosen = np.full(n_classes, levels.index(start))
    for _ in range(passes):
        before = chosen.copy()
        for c in classes:
            others = classes[classes != c]
            rest = fired[1][:, others, chosen[others]].sum(-1)
            accuracy, hold = points(1, rest[0] + fired[1, 0, c], rest[2] + fired[1, 2, c])
            score = hold - 10.0 * np.maximum(floor - accuracy, 0.0)
            if score.max() > score[chosen[c]]:
                chosen[c] = score.argmax()
        if (chosen == before).all():
            break
    held_out = fired[0][:, classes, chosen[classes]].sum(-1)
    accuracy, hold = points(0, held_out[0], held_out[2])
    rows = [(int(c), float(levels[chosen[c]]), round(float(accuracy), 2), round(float(hold), 2)) for c in classes]
    return df.sparkSession.createDataFrame(rows, "cls int, theta double, val_buyer_top1 double, val_hold double")
