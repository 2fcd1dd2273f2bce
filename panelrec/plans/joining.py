"""Queries: joins, set operations, counts, percentiles and report tables."""

from pyspark.sql import functions as F

from panelrec.operators import decide as D
from panelrec.operators import metrics as M
from panelrec.operators import reports as R
from panelrec.operators.knn import knn_class_probs as vote
from panelrec.operators.knn import nearest
from panelrec.operators.scale import join_lookup
from panelrec.operators.sweeps import Axis, sweep
from panelrec.plans import views as V
from panelrec.plans.gating import T1, grid_sql, sweep_sql
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import r6, with_views
from panelrec.session import staged

K = 10


@query("join_targets", with_views("pool_ud", f"""select p.user_id, cast(p.d as varchar) as d, {r6('p.amt')} as amt, t.total_added
    from pool_ud p join (select user_id, count(*) filter (cls > 0) as total_added from pool_ud where d >= date '2024-01-20' group by 1) t on p.user_id = t.user_id
    where p.d < date '2024-01-20'"""))
def join_targets(spark, sf):
    pool = V.pool_ud(spark, sf)
    cut = F.lit("2024-01-20").cast("date")
    target = pool.where(F.col("d") >= cut).groupBy("user_id").agg(F.sum(F.when(F.col("cls") > 0, 1).otherwise(0)).alias("total_added"))
    return rounded(pool.where(F.col("d") < cut).select("user_id", "d", "amt").join(target, "user_id"))


@query("semi_join_ids", """select event_id, user_id from events where user_id in (select user_id from events where event_type = 'purchase' group by 1
    having sum(value) > (select avg(s) from (select sum(value) as s from events where event_type = 'purchase' group by user_id)))""")
def semi_join_ids(spark, sf):
    ev = V.read(spark, sf, "events")
    spend = ev.where(F.col("event_type") == "purchase").groupBy("user_id").agg(F.sum("value").alias("s"))
    bar = spend.agg(F.avg("s")).first()[0]
    return ev.select("event_id", "user_id").join(spend.where(F.col("s") > F.lit(bar)).select("user_id"), "user_id", "left_semi").select("event_id", "user_id")


@query("label_lookup", """select event_id, case event_type when 'purchase' then 'Bought' when 'view' then 'Looked' else event_type end as label from events""")
def label_lookup(spark, sf):
    ev = V.read(spark, sf, "events").select("event_id", F.col("event_type").alias("code"))
    names = spark.createDataFrame([("purchase", "Bought"), ("view", "Looked")], "code string, label string")
    return join_lookup(ev, names, ["code"]).select("event_id", F.coalesce("label", "code").alias("label"))


def _knn_sql(score, distance="round(distance, 6) + 0.0"):
    return with_views("emb", f"""select row_id, cast(rank as integer) as rank, context_id, {distance} as distance from (
      select q.row_id, c.row_id as context_id, {score} as distance, row_number() over (partition by q.row_id order by {score}, c.row_id) - 1 as rank
      from emb q join emb c on q.row_id <> c.row_id) where rank < {K}""")


L2 = "list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))"
IP = "(-list_sum(list_transform(range(1, 65), lambda i: q.e[i] * c.e[i])))"


@query("knn_l2", _knn_sql(L2))
def knn_l2(spark, sf):
    v = V.vectors(spark, sf)
    return rounded(nearest(v, v, K, exclude_self=True))


@query("knn_ip", _knn_sql(IP))
def knn_ip(spark, sf):
    v = V.vectors(spark, sf)
    return rounded(nearest(v, v, K, metric="ip", exclude_self=True))


@query("knn_class_probs", f"""with knn as ({_knn_sql(L2, 'distance')}), w as (select row_id, c.cls, sum(case when label = c.cls then exp(-distance) else 0 end) + 1e-3 as w
      from knn join embeddings on vec_id = context_id, (select unnest(range(0, 16)) as cls) c group by 1, 2)
    select row_id, cast(cls as integer) as cls, round(w / sum(w) over (partition by row_id), 6) as p from w""")
def knn_class_probs(spark, sf):
    v = V.vectors(spark, sf)
    labels = v.select(F.col("row_id").alias("context_id"), "label")
    probs = vote(nearest(v, v, K, exclude_self=True), labels, 16)
    return probs.select("row_id", F.posexplode("probs").alias("cls", "p")).withColumn("p", F.round("p", 6))


# ------------------------------------------------------------------ set algebra

_ud = {"click": "(select user_id, d from panel_ud where click = 1)", "buy": "(select user_id, d from panel_ud where purchase = 1)"}


def _days(spark, sf):
    panel = V.panel_ud(spark, sf)
    return [panel.where(F.col(c) == 1).select("user_id", F.col("d").cast("string").alias("d")) for c in ("click", "purchase")]


@query("union_all", with_views("panel_ud", f"select user_id, cast(d as varchar) as d from ({_ud['click']} union all {_ud['buy']})"))
def union_all(spark, sf):
    a, b = _days(spark, sf)
    return a.unionByName(b)


@query("except_rows", with_views("panel_ud", f"select user_id, cast(d as varchar) as d from ({_ud['click']} except all {_ud['buy']})"))
def except_rows(spark, sf):
    a, b = _days(spark, sf)
    return a.exceptAll(b)


@query("intersect_rows", with_views("panel_ud", f"select user_id, cast(d as varchar) as d from ({_ud['click']} intersect {_ud['buy']})"))
def intersect_rows(spark, sf):
    a, b = _days(spark, sf)
    return a.intersect(b)


@query("distinct_rows", "select distinct user_id, event_type from events")
def distinct_rows(spark, sf):
    return V.read(spark, sf, "events").select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


@query("distinct_ids", "select distinct user_id from events")
def distinct_ids(spark, sf):
    return V.read(spark, sf, "events").select("user_id").distinct()


# --------------------------------------------------------------- aggregations

@query("group_median", with_views("panel_cm", f"select province, {r6('median(income_pos)')} as median, {r6('(select median(income_pos) from panel_cm)')} as overall from panel_cm group by 1"))
def group_median(spark, sf):
    from panelrec.operators.scale import medians_and_overall

    medians, overall = medians_and_overall(staged(V.panel_cm(spark, sf).select("province", "income_pos")), "province", "income_pos")
    return rounded(medians.withColumn("overall", F.lit(overall)))


@query("latency_percentiles", with_views("decisions", """select regime, round(avg(latency_ms), 6) as mean, round(quantile_cont(latency_ms, 0.5), 6) as p50,
    round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99 from decisions group by 1"""))
def latency_percentiles(spark, sf):
    return rounded(M.latency_summary(staged(V.decisions(spark, sf).select("regime", "latency_ms")), "latency_ms", ["regime"]))


def _mix(df, by):
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return counts.select(by, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * 100, 6).alias("pct"))


@query("action_mix", "select event_type as action, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 6) as pct from events group by 1")
def action_mix(spark, sf):
    return _mix(V.read(spark, sf, "events").withColumnRenamed("event_type", "action"), "action")


@query("regime_mix", with_views("decisions", "select regime, count(*) as n, round(count(*) / sum(count(*)) over () * 100, 6) as pct from decisions group by 1"))
def regime_mix(spark, sf):
    return _mix(V.decisions(spark, sf), "regime")


# -------------------------------------------------------------------- reports

@query("iqm", with_views("results", """select suite, round(avg(metric), 6) as iqm from (select *, row_number() over (partition by suite order by metric) - 1 as i,
    count(*) over (partition by suite) as n from results) where i >= floor(n * 0.25) and i < n - floor(n * 0.25) group by 1"""))
def iqm(spark, sf):
    return rounded(R.iqm(V.results(spark, sf), ["suite"], "metric"))


_brands = [f"Brand#{i}" for i in range(1, 26)]


@query("pivot_fill", with_views("results", "select suite_fold, " + ", ".join(
    f"round(coalesce(\"{b}\", rm), 6) as \"{b}\"" for b in _brands) + """ from (select suite || '/' || cast(fold as varchar) as suite_fold, """ + ", ".join(
    f"avg(metric) filter (name = '{b}') as \"{b}\"" for b in _brands) + ", (select cast(sum(cast(m as decimal(28,12))) as double) / count(m) from (select avg(r2.metric) as m from results r2 where r2.suite = results.suite and r2.fold = results.fold and r2.name in (" + ", ".join(
    f"'{b}'" for b in _brands) + ") group by r2.name)) as rm from results group by suite, fold)"))
def pivot_fill(spark, sf):
    t = V.results(spark, sf).withColumn("suite_fold", F.concat_ws("/", "suite", F.col("fold").cast("string")))
    return rounded(R.pivot_fill(t, "suite_fold", "name", "metric"))


REPS = 200


@query("iqm_bootstrap", with_views("results", f"""
    , keyed as materialized (select *, suite || '/' || name || '/' || fold as k, row_number() over (partition by suite, fold order by metric, suite || '/' || name || '/' || fold) - 1 as slot,
      count(*) over (partition by suite, fold) as n from results where metric is not null),
    slots as (select suite, fold, rep, cast(floor(('0x' || md5('42|' || rep || '|' || k)[1:13])::bigint / 4503599627370496.0 * n) as bigint) as slot from keyed, range(1, {REPS + 1}) r(rep)),
    drawn as (select s.suite, s.rep, k.metric from slots s join keyed k using (suite, fold, slot)),
    each_rep as (select suite, rep, avg(metric) as iqm from (select *, row_number() over (partition by suite, rep order by metric) - 1 as i, count(*) over (partition by suite, rep) as n from drawn)
      where i >= floor(n * 0.25) and i < n - floor(n * 0.25) group by 1, 2)
    select suite, round(quantile_cont(iqm, 0.025), 6) as low, round(quantile_cont(iqm, 0.975), 6) as high, round(avg(iqm), 6) as mean from each_rep group by 1""").replace(")\n\n    , keyed", "),\n keyed", 1))
def iqm_bootstrap(spark, sf):
    t = V.results(spark, sf).withColumn("k", F.concat_ws("/", "suite", "name", F.col("fold").cast("string")))
    return rounded(R.iqm_bootstrap(t, ["suite"], "fold", "metric", "k", reps=REPS))


@query("metrics_report", "select *, map7 = max(map7) over () as best_map7, buyer_top1 = max(buyer_top1) over () as best_buyer_top1, alert_pct = min(alert_pct) over () as best_alert_pct from ("
       + sweep_sql(grid_sql(theta=T1), "theta", "odds > theta") + ")")
def metrics_report(spark, sf):
    swept = rounded(sweep(D.with_candidates(V.scores(spark, sf)), [Axis("theta", F.col("odds"), T1)]))
    return R.best_flags(swept, ["map7", "buyer_top1"], ["alert_pct"])
