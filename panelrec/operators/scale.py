"""Building blocks that keep joins, ranks and quantiles safe under skew.

* ``join_lookup``: a lazy null-safe join with a keyed table; size and skew are settled at run time.
* ``hash_segments``: exact rank cuts of a reproducible random order, without a sort.
* ``running_totals``: exact prefix sums over an ordered column, by value buckets.
* ``group_quantiles``: exact interpolated quantiles of groups of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrec.functions.scalars import draw_key

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SORT_ROWS = 1_000_000


def _row_bytes(kind: T.DataType) -> int:
    """Rough bytes of one value, arrays taken as 32 elements long."""
    if isinstance(kind, T.StructType):
        return sum(_row_bytes(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return 32 * _row_bytes(kind.elementType)
    return 8 if isinstance(kind, (T.NumericType, T.DateType, T.BooleanType)) else 32


def bounded_table(df: DataFrame, max_rows: int | None = None) -> DataFrame | None:
    """``df`` as a local table when it is small enough to broadcast, else None.

    Without ``max_rows`` the limit is 64 MB over the row width, at most a million
    rows; never more than one row beyond the limit reaches the driver.
    """
    if max_rows is None:
        max_rows = min(BROADCAST_ROWS, BROADCAST_BYTES // max(_row_bytes(df.schema), 1))
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > BROADCAST_BYTES:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def join_lookup(fact: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a large table with a keyed one; null keys match null keys.

    ``lookup`` holds one row per key and no other column of ``fact``'s. Nothing runs while the plan is built: the planner
    broadcasts the lookup where it, or at run time its real size, is within ``spark.sql.autoBroadcastJoinThreshold``;
    beyond that adaptive execution splits the parts of a hot key by the blocks they were written in, so rows of one key, even
    equal rows, spread over tasks (``build_session`` lets it do so where a later step shuffles again).
    """
    keys = list(keys)
    values = [c for c in lookup.columns if c not in keys]
    right = lookup.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *values)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return fact.join(right, same, how).select(*fact.columns, *values)


# --------------------------------------------------------------------------
# Exact cuts of a random order
# --------------------------------------------------------------------------

def prefix_length(df: DataFrame, rows_per_prefix: int = 20_000) -> int:
    """Hash digits that leave about ``rows_per_prefix`` rows per prefix, between 1 and 5.

    More digits mean fewer rows to rank around a limit and a longer count table; both
    stay small at any size.
    """
    n, digits = df.count(), 1
    while digits < 5 and n > rows_per_prefix * 16**digits:
        digits += 1
    return digits


def hash_segments(
    df: DataFrame,
    strata: Sequence[str],
    keys: Sequence[str],
    bounds: Callable[[DataFrame], DataFrame],
    seed: int = 42,
    prefix: int | None = None,
    into: str = "segment",
) -> DataFrame:
    """Number each row by the rank interval it falls in within its stratum.

    Rows of a stratum are ordered by md5 of seed and key. ``bounds`` receives the
    table (strata, n) and adds an array column ``bounds`` of rank limits; a row's
    segment is the number of limits below its rank. Instead of sorting strata, one
    pass counts rows per hash prefix, which fixes the prefix every limit falls in,
    and only rows sharing such a prefix (1/16**prefix of a stratum) are ranked. ``df``
    is read about three times, so pass a stored table rather than a long plan.
    """
    prefix = prefix or prefix_length(df)
    strata = list(strata) or ["_all"]
    base = df if strata != ["_all"] else df.withColumn("_all", F.lit(0))
    hashed = base.withColumn("_h", draw_key(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, prefix))

    hist = hashed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = bounds(hist.groupBy(*strata).agg(F.sum("_c").alias("n")))
    limits = sizes.select(*strata, "n", F.posexplode("bounds").alias("_i", "_q")).select(
        *strata, "_i", F.least("_q", "n").alias("_q")
    )
    steps = hist.withColumn(
        "_end", F.sum("_c").over(Window.partitionBy(*strata).orderBy("_b"))
    )
    first = (
        limits.join(steps, strata)
        .where(F.col("_end") >= F.col("_q"))
        .groupBy(*strata, "_i")
        .agg(F.min(F.struct("_b", "_end", "_c", "_q")).alias("_m"))
    )
    cuts = first.groupBy(*strata).agg(
        F.collect_list(
            F.struct(
                F.col("_m._b").alias("b"),
                (F.col("_m._q") - F.col("_m._end") + F.col("_m._c")).alias("need"),
                (F.col("_m._q") == F.col("_m._end")).alias("whole"),
            )
        ).alias("_cuts")
    )
    if strata == ["_all"]:
        # One stratum has one row of cuts, so it travels as literals.
        row = cuts.first()
        given = [F.struct(*[F.lit(c[k]).alias(k) for k in ("b", "need", "whole")]) for c in row["_cuts"]] if row else []
        placed = hashed.withColumn("_cuts", F.array(*given) if given else F.lit(None).cast(cuts.schema["_cuts"].dataType))
    else:
        placed = join_lookup(hashed, cuts, strata)
    placed = placed.withColumn(
        "_base", F.size(F.filter("_cuts", lambda c: F.col("_b") > c["b"]))
    ).withColumn(
        "_touch", F.filter("_cuts", lambda c: (F.col("_b") == c["b"]) & ~c["whole"])
    )

    settled = placed.where(F.size("_touch") == 0).withColumn(into, F.col("_base"))
    order = Window.partitionBy(*strata, "_b").orderBy("_h", *keys)
    edge = (
        placed.where(F.size("_touch") > 0)
        .withColumn("_rank", F.row_number().over(order))
        .withColumn(
            into,
            F.col("_base") + F.size(F.filter("_touch", lambda c: F.col("_rank") > c["need"])),
        )
    )
    columns = [*df.columns, into]
    return settled.select(*columns).unionByName(edge.select(*columns))


def hash_take(
    df: DataFrame,
    strata: Sequence[str],
    keys: Sequence[str],
    quota: Column | Callable[[DataFrame], DataFrame],
    seed: int = 42,
) -> DataFrame:
    """Exactly min(quota, size) rows per stratum in the reproducible random order.

    ``quota`` is a Column over (strata, n) or a function adding a column ``quota``.
    """
    def bounds(sizes: DataFrame) -> DataFrame:
        sized = quota(sizes) if callable(quota) else sizes.withColumn("quota", quota)
        return sized.withColumn("bounds", F.array(F.col("quota").cast("bigint")))

    taken = hash_segments(df, strata, keys, bounds, seed, into="_segment")
    return taken.where(F.col("_segment") == 0).drop("_segment")


def quota_samples(
    df: DataFrame,
    specs: dict[str, tuple[Sequence[str], Column | Callable[[DataFrame], DataFrame]]],
    keys: Sequence[str],
    n: int,
    seed: int = 42,
    prefix: int | None = None,
    into: str = "sample",
) -> DataFrame:
    """Several samples of exactly ``n`` rows each, stacked under their names.

    A spec names its strata and quota. Rows within the quota of their stratum go
    first; a longer pick is cut and a shorter one filled from the other rows, both in
    random order. One count per hash prefix serves all specs; then one pass keeps
    rows that are certain and one ranks the few that share a prefix with a limit.
    """
    prefix = prefix or prefix_length(df)
    hashed = df.withColumn("_h", draw_key(seed, *[F.col(k) for k in keys]))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, prefix))
    columns = sorted({c for strata, _ in specs.values() for c in strata})
    fine = hashed.groupBy(*columns, "_b").agg(F.count(F.lit(1)).alias("_c"))
    cuts, totals = _quota_cuts(fine, columns, specs, n)
    limits = F.lit(None)
    for row in totals:
        here = F.struct(*[F.lit(row[k]).alias(k) for k in ("b1", "n1", "b0", "n0")])
        limits = F.when(F.col(into) == row["_spec"], here).otherwise(limits)

    asked = F.array(*[
        F.struct(F.lit(name).alias(into), _label(strata).alias("_stratum"))
        for name, (strata, _) in specs.items()
    ])
    spread = hashed.select(*df.columns, "_h", "_b", F.explode(asked).alias("_a")).select(
        *df.columns, "_h", "_b", "_a.*"
    )
    placed = join_lookup(spread, cuts.withColumnRenamed("_spec", into), [into, "_stratum"], "inner")
    placed = placed.select("*", limits.alias("_l")).select("*", "_l.*").drop("_l")
    b, cut = F.col("_b"), F.col("_cut")
    edge = (b == cut) | (b == F.col("b1")) | (b == F.col("b0"))
    keep = F.when(b < cut, b < F.col("b1")).otherwise(b < F.col("b0"))

    settled = placed.where(~edge & keep)
    in_stratum = Window.partitionBy(into, "_stratum", "_b").orderBy("_h", *keys)
    ranked = placed.where(edge).withColumn("_r", F.row_number().over(in_stratum)).withColumn(
        "_picked", (b < cut) | ((b == cut) & (F.col("_r") <= F.col("_need")))
    )
    overall = Window.partitionBy(into, "_picked", "_b").orderBy("_h", *keys)
    last = F.when(F.col("_picked"), F.col("b1")).otherwise(F.col("b0"))
    need = F.when(F.col("_picked"), F.col("n1")).otherwise(F.col("n0"))
    ranked = ranked.withColumn("_r", F.row_number().over(overall)).where(
        (b < last) | ((b == last) & (F.col("_r") <= need))
    )
    return settled.select(*df.columns, into).unionByName(ranked.select(*df.columns, into))


def _label(strata: Sequence[str]) -> Column:
    """One text per stratum."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in strata])


def _quota_cuts(
    fine: DataFrame, columns: Sequence[str], specs: dict[str, tuple[Sequence[str], Column | Callable[[DataFrame], DataFrame]]], n: int
) -> tuple[DataFrame, list]:
    """Cut prefix and rest per (spec, stratum), and per spec the cuts of picked and unpicked rows."""
    fine = fine.persist()
    combos = fine.groupBy(*columns).agg(F.sum("_c").alias("_c"))
    combos = _small_or_same(combos)
    quotas = []
    for name, (strata, quota) in specs.items():
        strata = list(strata)
        sizes = combos.groupBy(*strata).agg(F.sum("_c").alias("n"))
        sized = quota(sizes) if callable(quota) else sizes.withColumn("quota", quota)
        clamped = F.least(F.greatest("quota", F.lit(0)), "n").cast("bigint").alias("_q")
        quotas.append(sized.select(F.lit(name).alias("_spec"), _label(strata).alias("_stratum"), clamped))
    keyed = ["_spec", "_stratum"]
    limits = _small_or_same(reduce(DataFrame.unionByName, quotas))
    asked = F.array(*[
        F.struct(F.lit(name).alias("_spec"), _label(strata).alias("_stratum"))
        for name, (strata, _) in specs.items()
    ])
    hist = (
        fine.select("_b", "_c", F.explode(asked).alias("_a"))
        .groupBy("_a._spec", "_a._stratum", "_b")
        .agg(F.sum("_c").alias("_c"))
    )
    steps = hist.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keyed).orderBy("_b")))
    both = steps.join(limits, keyed).persist()
    rest = F.col("_q") - F.col("_end") + F.col("_c")
    cuts = (
        both.where(F.col("_end") >= F.col("_q"))
        .groupBy(*keyed)
        .agg(F.min(F.struct("_b", rest.alias("need"))).alias("_m"))
        .select(*keyed, F.col("_m._b").alias("_cut"), F.col("_m.need").alias("_need"))
    )
    inside = F.greatest(F.least(F.col("_c"), rest), F.lit(0))
    by_prefix = both.groupBy("_spec", "_b").agg(
        F.sum(inside).alias("_p1"), F.sum(F.col("_c") - inside).alias("_p0")
    )
    # At most 16**prefix rows per spec.
    whole = Window.partitionBy("_spec")
    ends = by_prefix.select(
        "*", *[F.sum(f"_p{p}").over(whole.orderBy("_b")).alias(f"_e{p}") for p in (1, 0)],
        *[F.sum(f"_p{p}").over(whole).alias(f"_t{p}") for p in (1, 0)],
    )
    takes = {1: F.least(F.lit(n), "_t1"), 0: F.least(F.greatest(F.lit(n) - F.col("_t1"), F.lit(0)), F.col("_t0"))}

    def cut(p: int) -> Column:
        reached = (F.col(f"_e{p}") >= takes[p]) & (takes[p] > 0)
        return F.min(F.when(reached, F.struct("_b", (takes[p] - F.col(f"_e{p}") + F.col(f"_p{p}")).alias("need"))))

    found = ends.groupBy("_spec").agg(cut(1).alias("c1"), cut(0).alias("c0"))
    totals = found.select(
        "_spec",
        *[F.coalesce(F.col(f"c{p}._b"), F.lit("")).alias(f"b{p}") for p in (1, 0)],
        *[F.coalesce(F.col(f"c{p}.need"), F.lit(0)).alias(f"n{p}") for p in (1, 0)],
    ).collect()
    cuts = _small_or_same(cuts)
    both.unpersist()
    fine.unpersist()
    return cuts, totals


def _small_or_same(df: DataFrame) -> DataFrame:
    small = bounded_table(df)
    return df if small is None else small


# --------------------------------------------------------------------------
# Prefix sums and quantiles
# --------------------------------------------------------------------------

def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = 256,
) -> DataFrame:
    """Add ``cum_<x>``, the inclusive prefix sum of every ``x`` by ``order``.

    ``df`` is already aggregated to one row per (by, order). The order column is cut
    at approximate quantiles into buckets; sums run inside a bucket and start from
    the total of the buckets before it, so no single task sees all rows.
    """
    by = list(by)
    grid = [i / buckets for i in range(1, buckets)]
    inner = sorted(set(df.approxQuantile(order, grid, 0.5 / buckets)))
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(
        df.withColumn(order, F.col(order).cast("double"))
    )
    way = F.desc if descending else F.asc
    parts = cut.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(s) for s in sums])
    before = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy(way("_bucket"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = parts.select(
        *by, "_bucket", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_s_{s}") for s in sums]
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(way(order))
    run = cut.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    out = join_lookup(run, starts, [*by, "_bucket"], "inner")
    return out.select(
        *df.columns, *[(F.col(f"_s_{s}") + F.col(f"_in_{s}")).alias(f"cum_{s}") for s in sums]
    )


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    levels: dict[str, float],
    accuracy: int = 10_000,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation per group; nulls are ignored.

    Groups up to ``sort_rows`` values use the built-in exact aggregate, which holds
    a group's values in memory. When a larger group exists, a sketch brackets every
    level and only values inside a bracket are counted and ranked.
    """
    by = list(by)
    base = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if _largest(base, by) > sort_rows:
        return _bracketed_quantiles(base, by, levels, accuracy)
    points = F.percentile("_v", F.array(*[F.lit(p) for p in levels.values()]))
    return base.groupBy(*by).agg(points.alias("_p")).select(
        *by, *[F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(levels)]
    )


def medians_and_overall(
    df: DataFrame, by: str, value: str, sort_rows: int = SORT_ROWS
) -> tuple[DataFrame, float | None]:
    """(group, median) table and the overall median, in one pass when sizes allow."""
    base = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    if _largest(base, []) > sort_rows:
        overall = group_quantiles(base, [], "_v", {"m": 0.5}, sort_rows=sort_rows).first()
        return group_quantiles(base, [by], "_v", {"median": 0.5}, sort_rows=sort_rows), overall[0]
    both = base.rollup(by).agg(F.percentile("_v", F.lit(0.5)).alias("median"), F.grouping(by).alias("_all"))
    table = bounded_table(both)
    if table is None:
        return both.where("_all = 0").drop("_all"), both.where("_all = 1").first()["median"]
    overall = table.where("_all = 1").first()
    return table.where("_all = 0").drop("_all"), overall["median"] if overall else None


def column_quantiles(
    df: DataFrame, columns: Sequence[str], levels: dict[str, float], sort_rows: int = SORT_ROWS
) -> dict[str, dict[str, float]]:
    """Exact quantiles of whole columns, in one pass when the table is small enough."""
    if df.count() <= sort_rows:
        points = F.array(*[F.lit(p) for p in levels.values()])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), points).alias(c) for c in columns]).first()
        return {c: dict(zip(levels, row[c] or [None] * len(levels))) for c in columns}
    return {
        c: group_quantiles(df, [], c, levels, sort_rows=sort_rows).first().asDict() for c in columns
    }


def _largest(base: DataFrame, by: list[str]) -> int:
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.max("_n")).first()[0] or 0


def _bracketed_quantiles(
    base: DataFrame, by: list[str], levels: dict[str, float], accuracy: int
) -> DataFrame:
    slack = 4.0 / accuracy
    tables = []
    for name, p in levels.items():
        low, high = max(p - slack, 0.0), min(p + slack, 1.0)
        sketch = base.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_v", F.array(F.lit(low), F.lit(high)), accuracy).alias("_br"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
        # A sketch of few values is not tight, so small groups keep every value.
        loose = F.col("_n") < 50 * accuracy
        bracket = sketch.select(
            *by,
            "_n",
            F.when(loose, F.col("_min")).otherwise(F.col("_br")[0]).alias("_lo"),
            F.when(loose, F.col("_max")).otherwise(F.col("_br")[1]).alias("_hi"),
        )
        keyed = by or ["_all"]
        if not by:
            bracket = bracket.withColumn("_all", F.lit(0))
        rows = base if by else base.withColumn("_all", F.lit(0))
        near = join_lookup(rows, bracket, keyed, "inner")
        below = near.groupBy(*keyed).agg(
            F.sum(F.when(F.col("_v") < F.col("_lo"), 1).otherwise(0)).alias("_below"),
            F.first("_n").alias("_n"),
        )
        counted = (
            near.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
            .groupBy(*keyed, "_v")
            .agg(F.count(F.lit(1)).alias("_c"))
        )
        ranked = running_totals(counted, "_v", ["_c"], keyed)
        at = F.lit(p) * (F.col("_n") - 1)
        reach = F.col("_below") + F.col("cum__c")
        picked = join_lookup(ranked, below, keyed, "inner").groupBy(*keyed).agg(
            F.min(F.when(reach > F.floor(at), F.col("_v"))).alias("_a"),
            F.min(F.when(reach > F.ceil(at), F.col("_v"))).alias("_z"),
            F.first(at - F.floor(at)).alias("_w"),
        )
        tables.append(
            picked.select(
                *keyed, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_w")).alias(name)
            )
        )
    keyed = by or ["_all"]
    out = reduce(lambda a, b: join_lookup(a, b, keyed, "inner"), tables)
    return out if by else out.drop("_all")


# --------------------------------------------------------------------------
# Ranks of distinct values
# --------------------------------------------------------------------------

def ranked_table(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], into: str, sort_rows: int = 200_000
) -> DataFrame:
    """Zero-based position of each row inside its ``by`` group.

    A table of at most ``sort_rows`` rows is ranked by a window. A larger one is
    range-sorted over the cluster, written to the checkpoint folder so that its
    parts stay fixed, and numbered from each part's start.
    """
    by = list(by)
    small = bounded_table(df, sort_rows)
    if small is not None:
        window = Window.partitionBy(*by).orderBy(*order)
        return small.withColumn(into, (F.row_number().over(window) - 1).cast("int"))

    from panelrec.session import checkpoint_root

    checkpoint_root(df.sparkSession)
    keys = [*[F.col(c) for c in by], *order]
    fixed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()
    numbered = fixed.withColumn("_id", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_id", 33)
    )
    # Group starts: parts are ordered, so a group's first row is its smallest id.
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(
                Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_start"),
    )
    placed = join_lookup(numbered, starts, ["_part"], "inner").withColumn(
        "_pos", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    firsts = placed.groupBy(*by).agg(F.min("_pos").alias("_first"))
    return join_lookup(placed, firsts, by, "inner").select(
        *df.columns, (F.col("_pos") - F.col("_first")).cast("int").alias(into)
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key by ``order``, aggregated before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
