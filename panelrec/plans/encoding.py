"""Queries: encoders, scalers and column statistics."""

from pyspark.sql import functions as F

from panelrec.operators import encode as E
from panelrec.operators import fitted as Q
from panelrec.operators.models import target_stats
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import ITEMS, r6, with_views

CATS = ("seg", "province", "kind")
CM_KEY = "c_custkey, cast(m as varchar) as m"

_long = "(" + " union all ".join(f"select '{c}' as \"column\", cast({c} as varchar) as \"value\" from cats" for c in CATS) + ")"
_cats = """cats as (select c_custkey, cast(m as varchar) as m, seg, cast(province as varchar) as province,
    case when p3 = 1 then 'A' when p4 = 1 then 'B' when p5 = 1 then 'UNKNOWN' end as kind, m < date '1997-01-01' as is_fit from panel_cm)"""


def _cats_sql(body):
    head = with_views("panel_cm", "")
    return f"{head.rstrip()},\n{_cats}\n{body}"


def _cats_df(spark, sf):
    return V.panel_cm(spark, sf).select(
        "c_custkey", F.col("m").cast("string").alias("m"), "seg", F.col("province").cast("string").alias("province"),
        F.when(F.col("p3") == 1, "A").when(F.col("p4") == 1, "B").when(F.col("p5") == 1, "UNKNOWN").alias("kind"),
        (F.col("m") < F.lit("1997-01-01").cast("date")).alias("is_fit"))


_codes = f"""(select "column", "value", row_number() over (partition by "column" order by count(*) desc, "value" nulls first) - 1 as code
    from {_long} group by 1, 2)"""


@query("fit_frequency_codes", _cats_sql(f"""select "column", "value", cast(code as integer) as code from {_codes}"""))
def fit_frequency_codes(spark, sf):
    return E.fit_frequency_codes(_cats_df(spark, sf), CATS)


_fit_codes = _codes.replace("from cats", "from cats where is_fit")


def _apply_col(c):
    fall = f"""(select coalesce(max(case when "value" = 'UNKNOWN' then code end), max(case when "value" = 'OTHER' then code end), max(code) + 1) from codes where "column" = '{c}')"""
    return f"""cast(coalesce((select code from codes where "column" = '{c}' and "value" is not distinct from cats.{c}), {fall}) as integer) as {c}"""


@query("apply_frequency_codes", _cats_sql("x") [:-1].rstrip() + f""", codes as materialized (select * from {_fit_codes})
    select c_custkey, m, {_apply_col('seg')}, {_apply_col('kind')},
      case province when '1' then 0 when '20' then 1 when '0' then 2 else 3 end as province from cats""")
def apply_frequency_codes(spark, sf):
    cats = _cats_df(spark, sf)
    codes = E.fit_frequency_codes(cats.where("is_fit"), CATS)
    out = E.apply_frequency_codes(cats, codes, CATS, {"province": {"1": 0, "20": 1, "0": 2}})
    return out.select("c_custkey", "m", "seg", "kind", F.col("province").cast("int").alias("province"))


@query("ordinal_encode", _cats_sql(f"""select "column", "value", cast(dense_rank() over (partition by "column" order by "value") - 1 as integer) as code
    from (select distinct "column", "value" from {_long} where "value" is not null)"""))
def ordinal_encode(spark, sf):
    return E.ordinal_codes(_cats_df(spark, sf), CATS)


CELLS = (*ITEMS, "amt")
_cells = "(" + " union all ".join(f"select cast({c} as double) as x from panel_ud" for c in CELLS) + ")"


@query("global_mean_std", with_views("panel_ud", f"""select round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std,
    count(*) - count(x) as nulls from {_cells}"""))
def global_mean_std(spark, sf):
    return rounded(E.global_stats(V.panel_ud(spark, sf), CELLS))


@query("global_zscore", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, """ + ", ".join(
    f"round(({c} - (select avg(x) from {_cells})) / (select stddev_pop(x) from {_cells}), 5) + 0.0 as {c}" for c in ("click", "amt")) + " from panel_ud"))
def global_zscore(spark, sf):
    panel = V.panel_ud(spark, sf)
    stats = E.global_stats(panel, CELLS).first()
    out = E.apply_zscore(panel, list(CELLS), stats["mean"], stats["std"])
    return out.select("user_id", F.col("d").cast("string").alias("d"), *[F.round(c, 5).alias(c) for c in ("click", "amt")])


@query("unscale_threshold", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, click > 0.5 as held, amt < 3 as is_cold from panel_ud"""))
def unscale_threshold(spark, sf):
    panel = V.panel_ud(spark, sf)
    stats = E.global_stats(panel, CELLS).first()
    mean, std = stats["mean"], stats["std"]
    z = E.apply_zscore(panel, list(CELLS), mean, std)
    return z.select(
        "user_id", F.col("d").cast("string").alias("d"), (F.col("click") > E.scaled_threshold(0.5, mean, std)).alias("held"),
        (F.col("amt") < E.scaled_threshold(3.0, mean, std)).alias("is_cold"))


PAIR = ("l_quantity", "l_extendedprice")
_li = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _lineitem(spark, sf):
    return V.read(spark, sf, "lineitem").select(*_li.split(", "), *PAIR)


def _per_column(template):
    return f"select {_li}, " + ", ".join(template.format(c=c) + f" as {c}" for c in PAIR) + " from lineitem"


@query("scale_standard", _per_column("round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 6) + 0.0"))
def scale_standard(spark, sf):
    return rounded(E.scale_standard(_lineitem(spark, sf), PAIR))


@query("scale_minmax", _per_column("round(({c} - (select min({c}) from lineitem)) / (select max({c}) - min({c}) from lineitem) * 2.0 - 1.0, 6) + 0.0"))
def scale_minmax(spark, sf):
    return rounded(E.scale_minmax(_lineitem(spark, sf), PAIR))


@query("scale_robust", _per_column("""round(({c} - (select median({c}) from lineitem))
    / (select quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) from lineitem), 6) + 0.0"""))
def scale_robust(spark, sf):
    return rounded(E.scale_robust(_lineitem(spark, sf), PAIR))


_rank_u = """(select o_orderkey, o_totalprice, (below + (ties - 1) / 2.0) / (n - 1) as u from (select o_orderkey, o_totalprice,
    rank() over (order by o_totalprice) - 1 as below, count(*) over (partition by o_totalprice) as ties, count(*) over () as n from orders))"""


@query("scale_quantile", f"select o_orderkey, round(2.0 * u - 1.0, 6) + 0.0 as o_totalprice from {_rank_u}")
def scale_quantile(spark, sf):
    return rounded(Q.scale_quantile(V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


def _place_sql(fit):
    """(o_orderkey, u): places of all prices on a map of 1,000 points fitted on the orders of ``fit``."""
    lower, rest = "(k * (n - 1)) // (p - 1) + 1", "(k * (n - 1)) % (p - 1)"
    return f"""(with a as (select list(o_totalprice order by o_totalprice) as v, count(*) as n, least(1000, count(*)) as p from orders {fit}),
      m as materialized (select p, list_transform(range(p), lambda k: v[{lower}] + case when {rest} > 0 then (v[{lower} + 1] - v[{lower}]) * (({rest}) / (p - 1)) else 0 end) as q from a),
      c as (select o_orderkey, o_totalprice as x, q, p, len(list_filter(q, lambda z: z < o_totalprice)) as l, len(list_filter(q, lambda z: z <= o_totalprice)) as r from orders, m)
      select o_orderkey, case when l < r then (l + r - 1) / 2 when l = 0 then 0 when l = p then p - 1 else l - 1 + (x - q[l]) / (q[l + 1] - q[l]) end / (p - 1) as u from c)"""


@query("scale_quantile_fitted", f"select o_orderkey, round(2.0 * u - 1.0, 6) + 0.0 as o_totalprice from {_place_sql(chr(39).join(['where o_orderdate < date ', '1998-01-01', '']))}")
def scale_quantile_fitted(spark, sf):
    """The map is fitted on earlier orders and applied to all."""
    t = V.read(spark, sf, "orders")
    fit = t.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("date"))
    return rounded(Q.scale_quantile(t.select("o_orderkey", "o_totalprice"), ["o_totalprice"], fit=fit))


@query("fit_quantiles", """with a as (select list(c_acctbal order by c_acctbal) as v, count(*) as n from customer)
    select 'c_acctbal' as "column", cast(k as bigint) as k, round(v[(k * (n - 1)) // 20 + 1] + case when (k * (n - 1)) % 20 > 0 then
      (v[(k * (n - 1)) // 20 + 2] - v[(k * (n - 1)) // 20 + 1]) * (((k * (n - 1)) % 20) / 20) else 0 end, 6) + 0.0 as point from a, range(21) r(k)""")
def fit_quantiles(spark, sf):
    fitted = Q.fit_quantiles(V.read(spark, sf, "customer"), ["c_acctbal"], 21)
    return rounded(fitted.select("column", F.posexplode("points").alias("k", "point"))).withColumn("k", F.col("k").cast("long"))


def _normal_sql():
    """The rational approximation of the normal quantile, in SQL."""
    a = "(((((-3.969683028665376e01 * r + 2.209460984245205e02) * r - 2.759285104469687e02) * r + 1.383577518672690e02) * r - 3.066479806614716e01) * r + 2.506628277459239e00) * q"
    b = "((((((-5.447609879822406e01 * r + 1.615858368580409e02) * r - 1.556989798598866e02) * r + 6.680131188771972e01) * r - 1.328068155288572e01) * r) + 1.0)"
    c = "(((((-7.784894002430293e-03 * {t} - 3.223964580411365e-01) * {t} - 2.400758277161838e00) * {t} - 2.549732539343734e00) * {t} + 4.374664141464968e00) * {t} + 2.938163982698783e00)"
    d = "((((7.784695709041462e-03 * {t} + 3.224671290700398e-01) * {t} + 2.445134137142996e00) * {t} + 3.754408661907416e00) * {t} + 1.0)"
    low, high = (f"{c.format(t=t)} / {d.format(t=t)}" for t in ("sqrt(-2.0 * ln(p))", "sqrt(-2.0 * ln(1.0 - p))"))
    return f"case when p < 0.02425 then {low} when p > 1 - 0.02425 then -({high}) else {a} / {b} end"


@query("scale_quantile_normal", f"""select o_orderkey, round({_normal_sql()}, 6) + 0.0 as o_totalprice from (select *, p - 0.5 as q, (p - 0.5) * (p - 0.5) as r
    from (select o_orderkey, least(greatest(u, 1e-7), 1 - 1e-7) as p from {_rank_u}))""")
def scale_quantile_normal(spark, sf):
    return rounded(Q.scale_quantile(V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "normal"))


_yj = """case when c_acctbal >= 0 then case when abs(p) < 1e-12 then ln(1 + c_acctbal) else (pow(c_acctbal + 1.0, p) - 1.0) / p end
    else case when abs(p - 2.0) < 1e-12 then -ln(1 - c_acctbal) else -(pow(1.0 - c_acctbal, 2.0 - p) - 1.0) / (2.0 - p) end end"""


@query("fit_power", f"""with g as (select cast(round(-3.0 + 0.1 * i, 10) as double) as p from range(0, 61) r(i)),
    m as (select p, count(*) as n, var_pop({_yj}) as v, sum(sign(c_acctbal) * ln(1 + abs(c_acctbal))) as j from customer, g group by 1),
    s as (select p, -n / 2.0 * ln(v) + (p - 1.0) * j as ll from m where v > 0)
    select 'c_acctbal' as "column", round(arg_max(p, ll), 6) + 0.0 as power, round(max(ll), 2) as loglik from s""")
def fit_power(spark, sf):
    out = E.fit_power(V.read(spark, sf, "customer"), ["c_acctbal"])
    return out.select("column", F.round("power", 6).alias("power"), F.round("loglik", 2).alias("loglik"))


_yj1 = _yj.replace("p - 2.0", "POWER - 2.0").replace("2.0 - p", "2.0 - POWER").replace("abs(p)", "abs(POWER)").replace(", p)", ", POWER)").replace("/ p ", "/ POWER ").replace("POWER", "best.p")


@query("scale_power", f"""with g as (select cast(round(-3.0 + 0.1 * i, 10) as double) as p from range(0, 61) r(i)),
    m as (select p, count(*) as n, var_pop({_yj}) as v, sum(sign(c_acctbal) * ln(1 + abs(c_acctbal))) as j from customer, g group by 1),
    best as (select arg_max(p, -n / 2.0 * ln(v) + (p - 1.0) * j) as p from m where v > 0),
    t as (select c_custkey, {_yj1} as x from customer, best)
    select c_custkey, round((x - (select avg(x) from t)) / (select stddev_pop(x) from t), 6) + 0.0 as c_acctbal from t""")
def scale_power(spark, sf):
    return rounded(E.scale_power(V.read(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


_gap = "select c_custkey, case when c_acctbal >= 0 then c_acctbal end as bal, case when c_nationkey > 4 then c_nationkey end as nation, c_custkey as full_key from customer"


def _gaps(spark, sf):
    return V.read(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"),
        F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"), F.col("c_custkey").alias("full_key"))


@query("impute_mean", f"""with t as ({_gap}) select c_custkey, {r6('coalesce(bal, (select avg(bal) from t))')} as bal,
    {r6('coalesce(nation, (select avg(nation) from t))')} as nation, full_key from t""")
def impute_mean(spark, sf):
    return rounded(E.impute_mean(_gaps(spark, sf), ["bal", "nation"]))


@query("missing_indicators", f"""with t as ({_gap}) select c_custkey, {r6('bal')} as bal, nation, full_key,
    case when bal is null then 1 else 0 end as bal_missing, case when nation is null then 1 else 0 end as nation_missing from t""")
def missing_indicators(spark, sf):
    return rounded(E.missing_indicators(_gaps(spark, sf), ["bal", "nation", "full_key"]))


@query("pca_reduce")
def pca_reduce(spark, sf):
    """Scores of all rows on the four directions of largest variance, signs fixed by rule."""
    v = V.vectors(spark, sf)
    out = Q.project(v, "vector", Q.fit_pca(v, "vector", 4))
    return rounded(out.select("row_id", F.posexplode("components").alias("pos", "x")))


_dim = "select i, j, sum(e[i] * e[j]) - count(*) * avg(e[i]) * avg(e[j]) as g from emb, range(1, 65) a(i), range(1, 65) b(j) group by 1, 2"


@query("pca_variance", with_views("emb", f"select round(sum(g) filter (i = j) / ((select count(*) from emb) - 1), 6) as total, round(sqrt(sum(g * g)) / ((select count(*) from emb) - 1), 6) as size from ({_dim})"))
def pca_variance(spark, sf):
    """What all directions have in common with the covariances they come from: sum and root of the sum of squares of their variances."""
    fitted = Q.fit_pca(V.vectors(spark, sf), "vector", 64)
    return rounded(fitted.agg(F.sum("variance").alias("total"), F.sqrt(F.sum(F.col("variance") * F.col("variance"))).alias("size")))


@query("normalize_masked", f"""with c as (select * from customer where c_mktsegment <> 'BUILDING')
    select c_custkey, round((c_acctbal - (select avg(c_acctbal) from c)) / ((select stddev_samp(c_acctbal) from c) + 1e-6), 6) + 0.0 as c_acctbal from customer""")
def normalize_masked(spark, sf):
    t = V.read(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return rounded(E.normalize_masked(t, ["c_acctbal"], F.col("c_mktsegment") != "BUILDING").drop("c_mktsegment"))


@query("sigma_clip", """with a as (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as s from lineitem),
    b as (select m, (select stddev_samp(l_extendedprice) from lineitem where abs(l_extendedprice - m) <= 1.5 * s) as s2 from a)
    select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(greatest(l_extendedprice, m - 1.5 * s2), m + 1.5 * s2), 6) + 0.0 as l_extendedprice
    from lineitem, b""")
def sigma_clip(spark, sf):
    t = V.read(spark, sf, "lineitem").select(*_li.split(", "), "l_extendedprice")
    return rounded(E.sigma_clip(t, ["l_extendedprice"], 1.5))


@query("target_scaling", """with f as (select * from orders where o_orderdate < date '1998-01-01'), z as (select o_orderkey, o_totalprice,
      (o_totalprice - (select avg(o_totalprice) from f)) / (select stddev_pop(o_totalprice) from f) as z from orders)
    select o_orderkey, round(z, 6) + 0.0 as scaled,
      round(z * (select stddev_pop(o_totalprice) from f) + (select avg(o_totalprice) from f), 4) + 0.0 as restored from z""")
def target_scaling(spark, sf):
    t = V.read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    mean, std = target_stats(t.where(F.col("o_orderdate") < F.lit("1998-01-01").cast("date")), "o_totalprice")
    z = (F.col("o_totalprice") - F.lit(mean)) / F.lit(std)
    return t.select("o_orderkey", F.round(z, 6).alias("scaled"), F.round(E.unscaled(z, mean, std), 4).alias("restored"))


@query("column_profile", with_views("panel_ud", " union all ".join(f"""select '{c}' as "column", round(avg({c}), 6) as mean, round(var_pop({c}), 6) as variance,
    case when max({c}) > min({c}) then round(regr_slope(amt, {c}), 6) + 0.0 end as slope,
    case when max({c}) > min({c}) then round(regr_intercept(amt, {c}), 6) + 0.0 end as intercept from (select *, 1 as one from panel_ud)"""
    for c in (*ITEMS, "one"))))
def column_profile(spark, sf):
    return rounded(E.column_profile(V.panel_ud(spark, sf).withColumn("one", F.lit(1)), [*ITEMS, "one"], "amt"))


@query("binary_columns", with_views("panel_ud", " union all ".join(f"""select "column" from (select '{c}' as "column", min({c}) as lo, max({c}) as hi,
    count(*) filter ({c} not in (0, 1)) as other from (select *, 1 as one from panel_ud)) where lo = 0 and hi = 1 and other = 0""" for c in (*ITEMS, "amt", "one"))))
def binary_columns(spark, sf):
    return E.binary_columns(V.panel_ud(spark, sf).withColumn("one", F.lit(1)), [*ITEMS, "amt", "one"])
