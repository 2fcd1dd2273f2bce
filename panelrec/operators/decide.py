"""Gates, cascade routing and decision payloads over per-row class probabilities.

Input rows carry ``probs`` (class 0 is hold), ``p_buy`` and ``held``. Everything is
a projection; the same functions run on tables and on micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.config import REGIMES, CascadeSpec
from panelrec.functions import arrays as A
from panelrec.functions import scalars as S


def with_candidates(df: DataFrame, top_k: int = 7, eps_mode: str = "add") -> DataFrame:
    """Add candidate class, its probability, the runner-up, odds and unheld top-k.

    Depends on ``probs`` and ``held`` only, so it can run per entity before a join
    spreads them over events.
    """
    base = df.select("*", A.ranked_classes(F.col("probs")).alias("ranked"))
    base = base.select(
        "*",
        F.get("ranked", F.lit(0)).alias("cand"),
        F.get("probs", F.lit(0)).alias("p0"),
        F.get("probs", F.get("ranked", F.lit(0))).alias("p_top"),
        F.get("probs", F.get("ranked", F.lit(1))).alias("p_second"),
        A.unheld_topk(F.col("ranked"), F.col("held"), top_k).alias("base_recs"),
    )
    return base.withColumn("odds", S.odds(F.col("p_top"), F.col("p0"), eps_mode))


CANDIDATE_COLUMNS = ("ranked", "cand", "p0", "p_top", "p_second", "base_recs", "odds")


# --------------------------------------------------------------------- gates

def gate_propensity(gamma: float) -> Column:
    return F.col("p_buy") >= gamma


def gate_odds(theta: float, strict: bool = True) -> Column:
    return S.fires(F.col("odds"), F.lit(theta), strict)


def gate_margin(theta: float, delta: float) -> Column:
    return gate_odds(theta) & (F.col("p_top") - F.col("p_second") > delta)


def gate_entropy(theta: float, tau: float, n_items: int = 15) -> Column:
    return gate_odds(theta) & (A.entropy_share(F.col("probs"), n_items) <= tau)


def theta_of(thetas: dict[int, float], default: float = 1.5) -> Column:
    """Per-class threshold of the candidate; at most one entry per catalog item."""
    value = F.lit(float(default))
    for cls, theta in thetas.items():
        value = F.when(F.col("cand") == cls, float(theta)).otherwise(value)
    return value


def gate_per_class(thetas: dict[int, float], default: float = 1.5) -> Column:
    return F.col("odds") > theta_of(thetas, default)


def gate_hybrid(thetas: dict[int, float], delta: float, default: float = 1.5) -> Column:
    return gate_per_class(thetas, default) & (F.col("p_top") - F.col("p_second") > delta)


def gate_prob_margin(delta: float) -> Column:
    return F.col("p_top") - F.col("p0") >= delta


def two_tier_theta(spec: CascadeSpec) -> Column:
    return F.when(F.col("cand").isin(*spec.noisy), spec.theta_noisy).otherwise(spec.theta_clean)


def gate_two_tier(spec: CascadeSpec, gamma: float | None = None) -> Column:
    fire = F.col("odds") > two_tier_theta(spec)
    return fire if gamma is None else gate_propensity(gamma) & fire


def shifted_probs(logits: Column, shift: float) -> Column:
    """Softmax after adding ``shift`` to the hold logit."""
    return A.softmax(F.transform(logits, lambda z, i: F.when(i == 0, z + F.lit(shift)).otherwise(z)))


def apply_gate(df: DataFrame, fire: Column) -> DataFrame:
    """Add ``pred`` and ``recs``: the candidate and its list when fired, else hold."""
    empty = F.array().cast("array<int>")
    return df.select(
        "*",
        F.when(fire, F.col("cand")).otherwise(0).alias("pred"),
        F.when(fire, F.col("base_recs")).otherwise(empty).alias("recs"),
    )


# ------------------------------------------------------------------- cascade

def relevant(action: Column, item: Column, relevance: dict[str, Sequence[int]]) -> Column:
    """Whether the item is listed for the action; unknown actions have no items."""
    test = F.lit(False)
    for name, items in relevance.items():
        if items:
            test = F.when(action == name, item.isin(*items)).otherwise(test)
    return F.coalesce(test, F.lit(False))


def route(df: DataFrame, relevance: dict[str, Sequence[int]], spec: CascadeSpec = CascadeSpec()) -> DataFrame:
    """Decide every row: regime, prediction, top list, live flag.

    The gate is tested on the best class even when it is held (``gate_on`` =
    'candidate'), or on the class that is recommended ('recommended').
    """
    known = set(CANDIDATE_COLUMNS) <= set(df.columns)
    table = df if known else with_candidates(df, spec.top_k)
    table = table.withColumn("odds", S.odds(F.col("p_top"), F.col("p0"), "floor"))
    empty = F.array().cast("array<int>")
    skipped = F.coalesce(F.col("p_buy") < spec.gamma_cache, F.lit(False))
    choice = A.first_or(F.col("base_recs"), F.col("cand"))
    if spec.gate_on == "recommended":
        tested = choice
        ratio = S.odds(F.get("probs", choice), F.col("p0"), "floor")
    else:
        tested, ratio = F.col("cand"), F.col("odds")
    theta = F.when(tested.isin(*spec.noisy), spec.theta_noisy).otherwise(spec.theta_clean)
    table = table.withColumn("_ratio", ratio).withColumn("_held_back", F.col("_ratio") <= theta)
    table = table.withColumn("_choice", choice)
    live = F.coalesce(F.col("p_buy") >= spec.gamma_live, F.lit(False)) & relevant(F.col("action"), F.col("_choice"), relevance)
    silent_hold = skipped | F.col("_held_back")
    regime = (
        F.when(skipped, REGIMES[0]).when(F.col("_held_back"), REGIMES[1])
        .when(live, REGIMES[3]).otherwise(REGIMES[2])
    )
    return table.select(
        *[c for c in df.columns if c not in ("probs", *CANDIDATE_COLUMNS)],
        F.when(silent_hold, 0).otherwise(F.col("_choice")).alias("prediction"),
        F.when(skipped, empty).otherwise(F.col("base_recs")).alias("recs"),
        (~silent_hold & live).alias("is_active"),
        skipped.alias("skipped"),
        F.when(skipped, 0.0).otherwise(F.col("_ratio")).alias("odds_ratio"),
        regime.alias("regime"),
    )


def cascade(
    df: DataFrame,
    relevance: dict[str, Sequence[int]],
    scorer: Callable[[DataFrame], DataFrame],
    spec: CascadeSpec = CascadeSpec(),
) -> DataFrame:
    """``route`` with the costly scorer run only on rows the first gate lets through.

    The filter stands before the scorer by hand: the planner does not push a
    condition through Python code. Rows held back carry null probabilities.
    """
    low = F.coalesce(F.col("p_buy") < spec.gamma_cache, F.lit(False))
    held_back, scored = df.where(low), scorer(df.where(~low))
    empty = F.array().cast("array<double>")
    both = scored.unionByName(held_back.withColumn("probs", empty))
    return route(both, relevance, spec)


def payload(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Text record of each decision; an empty list falls back to the top product."""
    labels = F.array(*[F.lit(n) for n in names])
    top = F.get(labels, F.col("prediction"))
    listed = F.transform("recs", lambda c: F.get(labels, c))
    listed = F.when(F.size("recs") > 0, listed).otherwise(F.array(top))
    return df.select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.coalesce(F.col("action"), F.lit("unknown")).alias("action"),
        F.col("prediction").cast("string").alias("prediction"),
        top.alias("top_product"),
        F.to_json(listed).alias("recommendations"),
        F.col("is_active").cast("string").alias("is_active_trigger"),
        F.col("skipped").cast("string").alias("gpu_skipped"),
        F.format_string("%.4f", "p_buy").alias("p_buy"),
        F.format_string("%.4f", "odds_ratio").alias("odds_ratio"),
        F.col("regime"),
        F.format_string("%.2f", "latency_ms").alias("latency_ms"),
    )


def replay_report(df: DataFrame) -> DataFrame:
    """Regime counts and accuracies of routed rows with truth ``y``, one row."""
    def pct(flag: Column, among: Column) -> Column:
        return F.coalesce(F.avg(F.when(among, flag.cast("int"))) * 100.0, F.lit(0.0))

    every, non_buyer, buyer = F.lit(True), F.col("y") == 0, F.col("y") > 0
    return df.agg(
        *[F.sum((F.col("regime") == r).cast("int")).alias(r) for r in REGIMES],
        F.count(F.lit(1)).alias("n_events"),
        pct(F.col("prediction") == 0, non_buyer).alias("non_buyer_hold"),
        pct(F.col("prediction") == F.col("y"), buyer).alias("buyer_top1"),
        pct(F.col("prediction") == F.col("y"), every).alias("overall"),
        pct(~F.col("is_active"), non_buyer).alias("non_buyer_live_hold"),
        pct(~F.col("is_active"), every).alias("live_suppressed"),
    )


def audit_matches(df: DataFrame) -> DataFrame:
    """Top-1 and top-k match of each decision, and the place of the true item."""
    top1 = F.coalesce(((F.col("y") == 0) & (F.col("prediction") == 0)) | F.array_contains("actual", F.col("prediction")) | (
        (F.col("prediction") == F.col("y"))
    ), F.lit(False))
    wanted = F.array_distinct(F.array_compact(F.concat("actual", F.array("y"))))
    present = F.filter(wanted, lambda c: F.array_contains(F.col("recs"), c))
    place = F.when(
        top1, F.when(F.col("y") != 0, 1).otherwise(0)
    ).otherwise(
        F.when(F.size(present) > 0, F.array_position("recs", F.get(present, F.lit(0)))).otherwise(-1)
    )
    return df.select(
        "*",
        top1.alias("top1_match"),
        (top1 | F.arrays_overlap("recs", wanted)).alias("topk_match"),
        place.cast("int").alias("target_rank"),
    )
