"""Exact, reproducible samplers.

All of them rank rows by md5 of seed and row key, so a sample depends neither on
partitioning nor on the order of the input. Quotas are tables of (stratum, quota).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrec.config import SIX_STRATA_QUOTAS
from panelrec.operators.scale import hash_segments, hash_take, quota_samples


def sample_per_group(df: DataFrame, group: Sequence[str], keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    return hash_take(df, group, keys, F.lit(n), seed)


def random_n(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    return hash_take(df, [], keys, F.lit(n), seed)


def six_strata(label: Column, active: Column, recent: Column) -> Column:
    """Stratum name from label, activity and recency flags."""
    age = F.when(recent, "recent").otherwise("old")
    kind = F.when(label != 0, "buyer").when(active, "active").otherwise("inactive")
    return F.concat_ws("_", kind, age)


def six_strata_sample(
    df: DataFrame,
    label: str,
    active: str,
    time: str,
    keys: Sequence[str],
    months: int = 6,
    quotas: dict[str, int] = SIX_STRATA_QUOTAS,
    seed: int = 42,
) -> DataFrame:
    """Six strata in one pass; buyers have their quota per class.

    Active means the flag equals its maximum over the whole table; recent means at
    most ``months`` before the newest date.
    """
    newest, most, least = df.agg(F.max(time), F.max(active), F.min(active)).first()
    recent = F.col(time) >= F.add_months(F.lit(newest), -months)
    on, off = F.col(active) == F.lit(most), F.col(active) == F.lit(least)
    table = df.where((F.col(label) != 0) | on | off).withColumn(
        "stratum", six_strata(F.col(label), on, recent)
    )
    limit = F.lit(0)
    for name, quota in quotas.items():
        limit = F.when(F.col("stratum") == name, quota).otherwise(limit)
    return hash_take(table, ["stratum", label], keys, limit, seed)


def stratified_split(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], ratio: float = 0.8, seed: int = 42
) -> DataFrame:
    """Add ``split``: train for the first floor(n * ratio) rows of each group."""
    def bounds(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("bounds", F.array(F.floor(F.col("n") * F.lit(ratio)).cast("bigint")))

    cut = hash_segments(df, group, keys, bounds, seed)
    return cut.withColumn("split", F.when(F.col("segment") == 0, "train").otherwise("test")).drop("segment")


def three_way_split(
    df: DataFrame, keys: Sequence[str], shares: tuple[float, float] = (0.70, 0.85), seed: int = 42
) -> DataFrame:
    def bounds(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn(
            "bounds", F.array(*[F.floor(F.col("n") * F.lit(s)).cast("bigint") for s in shares])
        )

    cut = hash_segments(df, [], keys, bounds, seed)
    names = F.when(F.col("segment") == 0, "train").when(F.col("segment") == 1, "val").otherwise("test")
    return cut.withColumn("split", names).drop("segment")


def quota_then_total(
    df: DataFrame,
    strata: Sequence[str],
    keys: Sequence[str],
    quota: Column | Callable[[DataFrame], DataFrame],
    n: int,
    seed: int = 42,
) -> DataFrame:
    """Exactly ``n`` rows: rows within their stratum's quota first, then filled or cut."""
    return quota_samples(df, {"only": (strata, quota)}, keys, n, seed).drop("sample")


def proportional_sample(
    df: DataFrame, group: str, keys: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """``n`` rows in the groups' own shares, at least one per group."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))
    quota = F.greatest(F.lit(1), F.bround(F.lit(n) * share, 0))
    return quota_then_total(df, [group], keys, quota, n, seed)


def composition_strata(name: str, n: int, n_classes: int, common: Sequence[int]) -> tuple[list[str], Column]:
    """Strata columns and quota of a named composition of ``n`` rows.

    Works over the columns ``cls``, ``is_buyer``, ``is_recent`` and ``is_cold``.
    """
    items = n_classes - 1
    cls = F.col("cls")

    def even(buyers: int) -> Column:
        return F.when(cls == 0, n - buyers).otherwise(max(1, buyers // items))

    if name == "balanced_60_40":
        return ["cls"], even(int(0.60 * n))
    if name == "natural_3_97":
        buyers = max(items, int(0.03 * n))
        return ["is_buyer"], F.when(F.col("is_buyer") == 1, buyers).otherwise(n - buyers)
    if name == "hybrid_20_80":
        return ["cls"], even(int(0.20 * n))
    if name == "uniform":
        return ["cls"], F.lit(max(1, n // n_classes))
    if name == "tail_boosted":
        hold, often = int(0.40 * n), int(0.20 * n)
        rare = n - hold - often
        return ["cls"], (
            F.when(cls == 0, hold)
            .when(cls.isin(*common), max(1, often // len(common)))
            .otherwise(max(1, rare // (items - len(common))))
        )
    if name == "most_recent":
        return ["is_recent"], F.when(F.col("is_recent") == 1, n).otherwise(0)
    if name == "cold_warm":
        return ["is_cold"], F.when(F.col("is_cold") == 1, int(0.5 * n)).otherwise(n - int(0.5 * n))
    raise ValueError(f"unknown composition {name}")


COMPOSITIONS = (
    "balanced_60_40", "natural_3_97", "hybrid_20_80", "uniform", "tail_boosted",
    "most_recent", "cold_warm",
)


def split_compositions(
    pool: DataFrame, names: Sequence[str], keys: Sequence[str], n: int, n_classes: int,
    common: Sequence[int], seed: int = 42,
) -> DataFrame:
    """Exactly ``n`` rows of the pool for each named composition, in shared passes."""
    specs = {name: composition_strata(name, n, n_classes, common) for name in names}
    return quota_samples(pool, specs, keys, n, seed, into="composition")


def _borrowing(sizes: DataFrame, wanted: Column, recent_share: float) -> DataFrame:
    """Quotas of (cls, is_recent): recent share first, shortfall from the other stratum."""
    per_class = Window.partitionBy("cls")

    def count(flag: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("is_recent") == flag, F.col("n"))).over(per_class), F.lit(0))

    sized = sizes.withColumn("_want", wanted).withColumn("_r", count(1)).withColumn("_h", count(0))
    goal = F.bround(F.col("_want") * F.lit(recent_share), 0).cast("bigint")
    sized = sized.withColumn("_r0", F.least(F.col("_r"), goal)).withColumn(
        "_h0", F.least(F.col("_h"), F.col("_want") - goal)
    )
    short = F.col("_want") - F.col("_r0") - F.col("_h0")
    from_old = F.col("_h") - F.col("_h0") >= short
    return sized.withColumn(
        "quota",
        F.when(F.col("is_recent") == 1, F.when(from_old, F.col("_r0")).otherwise(F.col("_r0") + short))
        .otherwise(F.when(from_old, F.col("_h0") + short).otherwise(F.col("_h0"))),
    )


def anchored_sample(
    pool: DataFrame,
    keys: Sequence[str],
    n: int,
    hold_share: float,
    n_classes: int,
    recent_share: float = 0.70,
    seed: int = 42,
) -> DataFrame:
    """Class 0 anchored at a share, active rows only; other classes equal, 70/30 recent/old."""
    hold = int(round(hold_share * n))
    base, extra = divmod(n - hold, n_classes - 1)
    wanted = F.when(F.col("cls") == 0, hold).otherwise(
        base + F.when(F.col("cls") <= extra, 1).otherwise(0)
    )
    live = pool.where((F.col("cls") != 0) | (F.col("is_active") == 1))
    return hash_take(live, ["cls", "is_recent"], keys, lambda s: _borrowing(s, wanted, recent_share), seed)


def equal_share_sample(
    pool: DataFrame, keys: Sequence[str], n: int, n_classes: int, recent_share: float = 0.70, seed: int = 42
) -> DataFrame:
    """Equal share of all classes, the remainder to the first ones, 70/30 recent/old."""
    base, extra = divmod(n, n_classes)
    wanted = base + F.when(F.col("cls") < extra, 1).otherwise(0)
    live = pool.where((F.col("cls") != 0) | (F.col("is_active") == 1))
    return hash_take(live, ["cls", "is_recent"], keys, lambda s: _borrowing(s, wanted, recent_share), seed)


def balanced_n(df: DataFrame, group: str, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, equal per class present, filled from the rest when classes are short."""
    def quota(sizes: DataFrame) -> DataFrame:
        classes = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(group))
        more = F.when(place <= F.lit(n) % classes, 1).otherwise(0)
        return sizes.withColumn("quota", F.floor(F.lit(n) / classes) + more)

    return quota_then_total(df, [group], keys, quota, n, seed)


def uniform_context(df: DataFrame, group: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """As many rows of every class as the rarest class has."""
    smallest = F.min("n").over(Window.partitionBy(F.lit(0)))
    return hash_take(df, [group], keys, smallest, seed)


def eval_cohort(
    df: DataFrame, label: str, keys: Sequence[str], n: int, buyer_share: float = 0.562, seed: int = 42
) -> DataFrame:
    """Evaluation rows: a fixed share of buyers in their class shares, the rest non-buyers."""
    target = int(round(n * buyer_share))
    buyers = proportional_sample(df.where(F.col(label) > 0), label, keys, target, seed)
    others = random_n(df.where(F.col(label) == 0), keys, n - target, seed)
    return buyers.unionByName(others)


def sample_audit(sampled: DataFrame, group: str, stratum: str, strata: Sequence[str]) -> DataFrame:
    """Rows per class and stratum, one column per stratum."""
    return (
        sampled.groupBy(group)
        .agg(
            *[F.sum(F.when(F.col(stratum) == s, 1).otherwise(0)).alias(f"n_{s}") for s in strata],
            F.count(F.lit(1)).alias("n_total"),
        )
    )
