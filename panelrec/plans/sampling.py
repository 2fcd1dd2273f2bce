"""Queries: samplers and splits over the user-day pool."""

from pyspark.sql import functions as F

from panelrec.operators import sample as M
from panelrec.operators.encode import column_subsample as pick_columns
from panelrec.plans import views as V
from panelrec.plans.registry import query
from panelrec.plans.views import ITEMS, with_views
from panelrec.session import staged

N_CLASSES = 6
COMMON = (1, 2)
N = 200
STRATA = ("buyer_recent", "buyer_old", "active_recent", "active_old", "inactive_recent", "inactive_old")
QUOTAS = {"buyer_recent": 30, "buyer_old": 10, "active_recent": 210, "active_old": 90, "inactive_recent": 70, "inactive_old": 30}


def hash_sql(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


RANK = f"order by {hash_sql('rid')}, rid"


def _pool(spark, sf):
    """The pool as a staged table: samplers pass over it several times."""
    return staged(V.pool_ud(spark, sf))


def topped(strata: str, quota: str, n: int, source: str = "pool_ud") -> str:
    """SQL of quota picks per stratum, topped up or cut to n rows."""
    return f"""select rid, cls from (select *, row_number() over (order by picked desc, {hash_sql('rid')}, rid) as place
      from (select *, case when row_number() over (partition by {strata} {RANK}) <= {quota} then 1 else 0 end as picked from {source}))
      where place <= {n}"""


@query("sample_per_group", with_views("pool_ud", f"select rid, cls from pool_ud qualify row_number() over (partition by cls {RANK}) <= 40"))
def sample_per_group(spark, sf):
    return M.sample_per_group(_pool(spark, sf), ["cls"], ["rid"], 40).select("rid", "cls")


_pool_cm = f"""(select cast(c_custkey as varchar) || '|' || cast(m as varchar) as rid, m, coalesce(added[1], 0) as cls, p5_lag1 as active from labels_cm)"""


@query("six_strata_sample", with_views("labels_cm", f"""select rid, cls, stratum from (select *,
      case when cls <> 0 then 'buyer' when active = (select max(active) from {_pool_cm}) then 'active' else 'inactive' end || '_' ||
      case when m >= (select max(m) from {_pool_cm}) - interval 6 month then 'recent' else 'old' end as stratum from {_pool_cm})
    qualify row_number() over (partition by stratum, cls {RANK}) <= case stratum {' '.join(f"when '{k}' then {v}" for k, v in QUOTAS.items())} end"""))
def six_strata_sample(spark, sf):
    from panelrec.functions.arrays import first_or
    from panelrec.operators.panel import added_classes, with_lags

    t = with_lags(V.panel_cm(spark, sf), V.CM_SPEC).select(
        F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("m").cast("string")).alias("rid"), "m",
        first_or(added_classes(V.CM_SPEC), F.lit(0)).alias("cls"), F.col("p5_lag1").alias("active"))
    return M.six_strata_sample(staged(t), "cls", "active", "m", ["rid"], quotas=QUOTAS).select("rid", "cls", "stratum")


@query("stratified_split", with_views("pool_ud", f"""select rid, cls, case when row_number() over (partition by cls {RANK})
    <= floor(count(*) over (partition by cls) * 0.8) then 'train' else 'test' end as split from pool_ud"""))
def stratified_split(spark, sf):
    return M.stratified_split(_pool(spark, sf), ["cls"], ["rid"]).select("rid", "cls", "split")


@query("three_way_split", with_views("pool_ud", f"""select rid, case when r <= floor(n * 0.70) then 'train' when r <= floor(n * 0.85) then 'val'
    else 'test' end as split from (select rid, row_number() over ({RANK}) as r, count(*) over () as n from pool_ud)"""))
def three_way_split(spark, sf):
    return M.three_way_split(_pool(spark, sf), ["rid"]).select("rid", "split")


@query("proportional_sample", with_views("pool_ud", topped(
    "cls", f"greatest(1, round_even({N} * (cast(count(*) over (partition by cls) as double) / count(*) over ()), 0))", N)))
def proportional_sample(spark, sf):
    return M.proportional_sample(_pool(spark, sf), "cls", ["rid"], N).select("rid", "cls")


@query("topup_sample", with_views("pool_ud", topped("cls", "25", 180)))
def topup_sample(spark, sf):
    return M.quota_then_total(_pool(spark, sf), ["cls"], ["rid"], F.lit(25), 180).select("rid", "cls")


def _composition_sql(name):
    items = N_CLASSES - 1
    even = lambda buyers: ("cls", f"(case when cls = 0 then {N - buyers} else {max(1, buyers // items)} end)")
    buyers3 = max(items, int(0.03 * N))
    hold, often = int(0.40 * N), int(0.20 * N)
    rare = (N - hold - often) // (items - len(COMMON))
    return {
        "balanced_60_40": even(int(0.60 * N)),
        "natural_3_97": ("is_buyer", f"(case when is_buyer = 1 then {buyers3} else {N - buyers3} end)"),
        "hybrid_20_80": even(int(0.20 * N)),
        "uniform": ("cls", str(N // N_CLASSES)),
        "tail_boosted": ("cls", f"(case when cls = 0 then {hold} when cls in (1, 2) then {often // 2} else {rare} end)"),
        "most_recent": ("is_recent", f"(case when is_recent = 1 then {N} else 0 end)"),
        "cold_warm": ("is_cold", f"(case when is_cold = 1 then {N // 2} else {N - N // 2} end)"),
    }[name]


@query("split_compositions", with_views("pool_ud", "\nunion all\n".join(
    f"(select '{c}' as composition, rid, cls from ({topped(*_composition_sql(c), N)}))" for c in M.COMPOSITIONS)))
def split_compositions(spark, sf):
    out = M.split_compositions(_pool(spark, sf), M.COMPOSITIONS, ["rid"], N, N_CLASSES, COMMON)
    return out.select("composition", "rid", "cls")


def _borrow_sql(want):
    return f"""select rid, cls, is_recent from (select *, row_number() over (partition by cls, is_recent {RANK}) as r,
        count(*) filter (is_recent = 1) over (partition by cls) as nr, count(*) filter (is_recent = 0) over (partition by cls) as nh,
        {want} as want from pool_ud where cls <> 0 or is_active = 1)
      where r <= case
        when is_recent = 1 then least(nr, round_even(0.7 * want, 0)) + case when nh - least(nh, want - round_even(0.7 * want, 0))
          >= want - least(nr, round_even(0.7 * want, 0)) - least(nh, want - round_even(0.7 * want, 0)) then 0
          else want - least(nr, round_even(0.7 * want, 0)) - least(nh, want - round_even(0.7 * want, 0)) end
        else least(nh, want - round_even(0.7 * want, 0)) + case when nh - least(nh, want - round_even(0.7 * want, 0))
          >= want - least(nr, round_even(0.7 * want, 0)) - least(nh, want - round_even(0.7 * want, 0))
          then want - least(nr, round_even(0.7 * want, 0)) - least(nh, want - round_even(0.7 * want, 0)) else 0 end end"""


_hold = int(round(0.15 * N))
_base, _extra = divmod(N - _hold, N_CLASSES - 1)


@query("anchored_sample", with_views("pool_ud", _borrow_sql(
    f"(case when cls = 0 then {_hold} else {_base} + case when cls <= {_extra} then 1 else 0 end end)")))
def anchored_sample(spark, sf):
    return M.anchored_sample(_pool(spark, sf), ["rid"], N, 0.15, N_CLASSES).select("rid", "cls", "is_recent")


@query("equal_share_sample", with_views("pool_ud", _borrow_sql(
    f"({N // N_CLASSES} + case when cls < {N % N_CLASSES} then 1 else 0 end)")))
def equal_share_sample(spark, sf):
    return M.equal_share_sample(_pool(spark, sf), ["rid"], N, N_CLASSES).select("rid", "cls", "is_recent")


_tb = int(round(N * 0.562))


@query("eval_cohort", with_views("pool_ud", f"""(select rid, cls from ({topped("cls",
    f"greatest(1, round_even({_tb} * (cast(count(*) over (partition by cls) as double) / count(*) over ()), 0))", _tb,
    "(select * from pool_ud where cls > 0)")}))
    union all (select rid, cls from pool_ud where cls = 0 qualify row_number() over ({RANK}) <= {N - _tb})"""))
def eval_cohort(spark, sf):
    return M.eval_cohort(_pool(spark, sf), "cls", ["rid"], N).select("rid", "cls")


@query("uniform_context", with_views("pool_ud", f"""select rid, cls from pool_ud qualify row_number() over (partition by cls {RANK})
    <= (select min(n) from (select count(*) as n from pool_ud group by cls))"""))
def uniform_context(spark, sf):
    return M.uniform_context(_pool(spark, sf), "cls", ["rid"]).select("rid", "cls")


@query("random_n", with_views("pool_ud", f"select rid, cls from pool_ud qualify row_number() over ({RANK}) <= 150"))
def random_n(spark, sf):
    return M.random_n(_pool(spark, sf), ["rid"], 150).select("rid", "cls")


@query("balanced_n", with_views("pool_ud", topped(
    "cls", f"({N} // (select count(distinct cls) from pool_ud) + case when (select count(distinct p.cls) from pool_ud p where p.cls < pool_ud.cls)"
    f" < {N} % (select count(distinct cls) from pool_ud) then 1 else 0 end)", N)))
def balanced_n(spark, sf):
    return M.balanced_n(_pool(spark, sf), "cls", ["rid"], N).select("rid", "cls")


@query("column_subsample", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, {', '.join(pick_columns(ITEMS, 3, 42))} from panel_ud"""))
def column_subsample(spark, sf):
    return V.panel_ud(spark, sf).select("user_id", F.col("d").cast("string").alias("d"), *pick_columns(ITEMS, 3, 42))


@query("sample_audit", with_views("pool_ud", f"""select cls, count(*) filter (is_recent = 1) as n_recent, count(*) filter (is_recent = 0) as n_old,
    count(*) as n_total from (select * from pool_ud qualify row_number() over (partition by cls {RANK}) <= 40) group by 1"""))
def sample_audit(spark, sf):
    taken = M.sample_per_group(_pool(spark, sf), ["cls"], ["rid"], 40)
    named = taken.withColumn("age", F.when(F.col("is_recent") == 1, "recent").otherwise("old"))
    return M.sample_audit(named, "cls", "age", ["recent", "old"])


@query("sample_means", with_views("pool_ud", f"""select sample, cls, round(avg(amt), 6) as amt, round(avg(is_active), 6) as is_active,
    round(avg(is_cold), 6) as is_cold from (
      select 'per_group' as sample, * from (select * from pool_ud qualify row_number() over (partition by cls {RANK}) <= 40)
      union all select 'random' as sample, * from (select * from pool_ud qualify row_number() over ({RANK}) <= 150)) group by 1, 2"""))
def sample_means(spark, sf):
    pool = _pool(spark, sf)
    both = M.sample_per_group(pool, ["cls"], ["rid"], 40).withColumn("sample", F.lit("per_group")).unionByName(
        M.random_n(pool, ["rid"], 150).withColumn("sample", F.lit("random")))
    return both.groupBy("sample", "cls").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("amt", "is_active", "is_cold")])
