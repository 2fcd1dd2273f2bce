"""Queries: ranking, calibration, drift, accuracy and fusion."""

from pyspark.sql import functions as F

from panelrec.config import CascadeSpec
from panelrec.functions import arrays as A
from panelrec.operators import decide as D
from panelrec.operators import fusion as U
from panelrec.operators import metrics as M
from panelrec.plans import views as V
from panelrec.plans.gating import NOISY, ROW_SCORES, ap_sql, hits_sql, ndcg_sql, rr_sql
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import r6, with_views

CATALOG = tuple(range(1, 16))


def _cands(spark, sf):
    return D.with_candidates(V.scores(spark, sf))


def _pred(spark, sf):
    return V.scores(spark, sf).withColumn("pred", A.argmax(F.col("probs")))


def _agg(*cols):
    return with_views("cands", f"select {', '.join(cols)} from cands where len(actual) > 0")


def _mean(expr, name, scale=""):
    return f"round(coalesce(avg({expr}), 0){scale}, 6) as {name}"


@query("map_at_k", _agg(*[_mean(f"coalesce({ap_sql('base_recs', k=k)}, 0)", f"map_{k}") for k in (1, 4, 7)]))
def map_at_k(spark, sf):
    return rounded(M.map_at_k(_cands(spark, sf), "base_recs", "actual", (1, 4, 7)))


@query("ndcg_at_k", _agg(*[_mean(ndcg_sql('base_recs', k=k), f"ndcg_{k}") for k in (4, 5, 7)]))
def ndcg_at_k(spark, sf):
    return rounded(M.ndcg_at_k(_cands(spark, sf), "base_recs", "actual", (4, 5, 7)))


@query("mrr", _agg(_mean(rr_sql('base_recs'), "mrr")))
def mrr(spark, sf):
    return rounded(M.mrr(_cands(spark, sf), "base_recs", "actual"))


@query("recall_hit_at_k", _agg(*[c for k in (3, 4, 7) for c in (
    _mean(f"cast({hits_sql('base_recs', k=k)} as double) / len(actual)", f"recall_{k}"),
    _mean(f"cast({hits_sql('base_recs', k=k)} > 0 as int)", f"hit_{k}"))]))
def recall_hit_at_k(spark, sf):
    return rounded(M.recall_hit_at_k(_cands(spark, sf), "base_recs", "actual", (3, 4, 7)))


_h = hits_sql("base_recs", "held2", 1000000)


@query("customer_eval", with_views("cands", f"""select row_id, {_h} as hits,
    case when len(held2) > 0 and len(base_recs) > 0 then round({_h} / len(base_recs), 4) else 0.0 end as precision,
    case when len(held2) > 0 then round({_h} / len(held2), 4) else 1.0 end as recall,
    case when len(held2) = 0 then case when len(base_recs) = 0 then 1.0 else 0.0 end when len(base_recs) = 0 then 0.0 else
      round(list_sum(list_transform(range(1, len(base_recs) + 1), lambda i: case when list_contains(held2, base_recs[i])
      then cast(len(list_filter(base_recs[1:i], lambda c: list_contains(held2, c))) as double) / i else 0.0 end)) / least(len(held2), len(base_recs)), 4) end as average_precision
    from (select *, case when is_cold then actual else list_filter({V.ranked_sql('probs2')}[1:4], lambda c: c <> 1) end as held2 from cands)"""))
def customer_eval(spark, sf):
    t = _cands(spark, sf)
    several = F.filter(F.slice(A.ranked_classes(F.col("probs2")), 1, 4), lambda c: c != 1)
    t = t.withColumn("truth", F.when(F.col("is_cold"), F.col("actual")).otherwise(several))
    return M.customer_eval(t, "base_recs", "truth").select("row_id", F.col("hits").cast("bigint").alias("hits"), "precision", "recall", "average_precision")


@query("ece", with_views("scores", """select round(sum(n * abs(acc - conf)) / sum(n), 6) as ece from (
    select ceil(list_max(probs) * 10) as bin, count(*) as n, avg(cast(list_position(probs, list_max(probs)) - 1 = y as int)) as acc,
      avg(list_max(probs)) as conf from scores group by 1)"""))
def ece(spark, sf):
    return rounded(M.ece(V.scores(spark, sf), "probs", "y"))


_classes = "(select cast(unnest(range(0, 16)) as integer) as cls)"
_dist = f"""dist as materialized (select cls, coalesce(ny, 0) as ny, coalesce(np, 0) as np, coalesce(ny, 0) / (sum(coalesce(ny, 0)) over ()) as q0,
    coalesce(np, 0) / (sum(coalesce(np, 0)) over ()) as p0 from {_classes} left join (select y as cls, count(*) as ny from scores group by 1) using (cls)
    left join (select cast(list_position(probs, list_max(probs)) - 1 as integer) as cls, count(*) as np from scores group by 1) using (cls))"""


def _with_dist(body):
    return f"{with_views('scores', '').rstrip()},\n{_dist}\n{body}"


@query("class_distribution", _with_dist("select cls, ny as n, round(q0, 6) as share from dist"))
def class_distribution(spark, sf):
    return rounded(M.class_distribution(V.scores(spark, sf), "y", 16))


@query("psi", _with_dist("""select round(sum((q - p) * ln(q / p)), 6) as psi from (select greatest(q0, 1e-4) / sum(greatest(q0, 1e-4)) over () as p,
    greatest(p0, 1e-4) / sum(greatest(p0, 1e-4)) over () as q from dist)"""))
def psi(spark, sf):
    t = _pred(spark, sf)
    return rounded(M.psi(M.class_distribution(t, "y", 16), M.class_distribution(t, "pred", 16)))


@query("js_divergence", _with_dist("""select round(js, 4) as js_divergence, round(sqrt(js), 4) as js_distance from (select sum(
    (case when q0 > 0 then q0 * log2(q0 / ((p0 + q0) / 2)) else 0 end + case when p0 > 0 then p0 * log2(p0 / ((p0 + q0) / 2)) else 0 end) / 2) as js from dist)"""))
def js_divergence(spark, sf):
    t = _pred(spark, sf)
    return M.js_divergence(M.class_distribution(t, "y", 16), M.class_distribution(t, "pred", 16))


_gini = """round(2.0 * sum(i * n) / (15 * sum(n)) - 16.0 / 15, 4)"""


@query("catalog_gini", with_views("cands", f"""select {_gini} as gini from (select n, row_number() over (order by n) as i from (
    select c.cls, count(x.cls) as n from (select cast(unnest(range(1, 16)) as integer) as cls) c left join (select unnest(base_recs) as cls from cands) x using (cls) group by 1))"""))
def catalog_gini(spark, sf):
    return M.catalog_gini(_cands(spark, sf), "base_recs", CATALOG)


_acc = "cast(list_position(probs, list_max(probs)) - 1 = y as int)"


@query("buyer_accuracy", with_views("scores", f"""select round(coalesce(avg(case when y <> 0 then {_acc} end), 0) * 100, 2) as buyer_top1,
    round(coalesce(avg(case when y = 0 then {_acc} end), 0) * 100, 2) as non_buyer, round(avg({_acc}) * 100, 2) as overall from scores"""))
def buyer_accuracy(spark, sf):
    return M.buyer_accuracy(_pred(spark, sf), "pred", "y")


@query("buyer_top1_filtered", with_views("cands", """select round(avg(cast(coalesce(list_contains(actual, base_recs[1]), false) as int)) * 100, 6) as buyer_top1
    from cands where len(actual) > 0"""))
def buyer_top1_filtered(spark, sf):
    return rounded(M.buyer_top1_filtered(_cands(spark, sf), "base_recs", "actual"))


@query("alert_distribution", with_views("scores", """select round(100.0 * count(*) filter (probs[1] < list_max(probs)) / count(*), 2) as active_pct,
    round(100.0 * count(*) filter (probs[1] = list_max(probs)) / count(*), 2) as silent_pct from scores"""))
def alert_distribution(spark, sf):
    return M.alert_distribution(_pred(spark, sf), "pred")


def _scored_sql(body):
    return f"{with_views('cands', '').rstrip()},\n{ROW_SCORES}\n{body}"


_fire = f"(p_buy >= 0.2 and odds > case when cand in {NOISY} then 6.0 else 1.8 end)"


@query("decision_bundle", _scored_sql(f"""select is_cold, round(coalesce(avg(case when y > 0 then cast(pred = y as int) end), 0) * 100, 6) as buyer_top1,
    round(coalesce(avg(case when y = 0 then cast(pred = 0 as int) end), 0) * 100, 6) as non_buyer_top1, round(avg(cast(pred = y as int)) * 100, 6) as overall_top1,
    round(avg(cast(pred > 0 as int)) * 100, 6) as alert_pct, round(coalesce(avg(ap * f), 0), 6) as map7, round(coalesce(avg(case when is_cold then ap * f end), 0), 6) as cold_map7,
    round(coalesce(avg(case when not is_cold then ap * f end), 0), 6) as warm_map7, round(coalesce(avg(ndcg * f), 0), 6) as ndcg7, round(coalesce(avg(rr * f), 0), 6) as mrr,
    round(coalesce(avg(hit * f), 0) * 100, 6) as hit7, round(coalesce(avg(recall * f), 0), 6) as recall7
    from (select *, case when {_fire} then cand else 0 end as pred, case when {_fire} then 1.0 else 0.0 end as f from row_scores) group by 1"""))
def decision_bundle(spark, sf):
    gated = D.apply_gate(_cands(spark, sf), D.gate_two_tier(CascadeSpec(), 0.2))
    return rounded(M.decision_bundle(gated, ["is_cold"]))


@query("three_tier_map", _scored_sql(f"""select round(coalesce(avg(case when fire and len(base_recs) > 0 then ap end), 0), 6) as conditional_map7,
    round(coalesce(avg(case when fire and len(base_recs) > 0 then hit end), 0) * 100, 6) as conditional_hit7,
    round(coalesce(avg(ap), 0), 6) as unconditional_map7, round(coalesce(avg(hit), 0) * 100, 6) as unconditional_hit7,
    round(coalesce(avg(case when ap is not null then case when fire then ap else 0 end end), 0), 6) as coverage_map7,
    round(coalesce(avg(case when ap is not null then case when fire then hit else 0 end end), 0) * 100, 6) as coverage_hit7,
    round(avg(cast(fire as int)) * 100, 6) as alert_pct from (select *, {_fire} as fire from row_scores)"""))
def three_tier_map(spark, sf):
    return rounded(M.three_tier_map(D.apply_gate(_cands(spark, sf), D.gate_two_tier(CascadeSpec(), 0.2))))


@query("metrics_cold_warm", _scored_sql("""select coalesce(cohort, 'all') as cohort, round(coalesce(avg(ap), 0), 6) as map7, round(coalesce(avg(ndcg), 0), 6) as ndcg7,
    round(coalesce(avg(hit), 0), 6) as hit7, count(ap) as n_rows from (select *, case when is_cold then 'cold' else 'warm' end as cohort from row_scores) group by cube (cohort)"""))
def metrics_cold_warm(spark, sf):
    return rounded(M.metrics_by_cohort(_cands(spark, sf), "base_recs", "actual", "is_cold"))


def _auc_sql(rows):
    """Pairwise-rank AUC of rows (s, pos)."""
    return f"""(select (sum(case when pos then r end) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0)
      / (count(*) filter (pos) * count(*) filter (not pos)) from (select pos, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from {rows}))"""


@query("roc_auc", with_views("scores", f"""select round({_auc_sql('(select p_buy as s, y > 0 as pos from scores)')}, 6) as auc_buy,
    round({_auc_sql('(select round(p_buy, 1) as s, y > 0 as pos from scores)')}, 6) as auc_tied"""))
def roc_auc(spark, sf):
    t = V.scores(spark, sf).withColumn("tied", F.round("p_buy", 1))
    a, b = M.roc_auc(t, "p_buy", F.col("y") > 0), M.roc_auc(t, "tied", F.col("y") > 0)
    return rounded(a.select(F.col("auc").alias("auc_buy")).withColumn("auc_tied", F.lit(b.first()[0])))


@query("roc_auc_ovo", with_views("scores", """select round(avg(auc), 6) as auc_ovo from (select a, b, p, (sum(case when pos then r end) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0)
      / (count(*) filter (pos) * count(*) filter (not pos)) as auc from (select a, b, p, y = p as pos,
      rank() over (partition by a, b, p order by probs[p + 1]) + (count(*) over (partition by a, b, p, probs[p + 1]) - 1) / 2.0 as r
      from scores, (select a, b, p from range(0, 16) x(a), range(0, 16) z(b), range(0, 16) w(p) where a < b and p in (a, b)) where y in (a, b))
    group by 1, 2, 3 having count(*) filter (pos) > 0 and count(*) filter (not pos) > 0)"""))
def roc_auc_ovo(spark, sf):
    return rounded(M.roc_auc_ovo(V.scores(spark, sf), "probs", "y", 16))


@query("average_precision", with_views("scores", """select round(sum(pos * cp / (cp + cn)) / sum(pos), 6) as average_precision from (
    select pos, sum(pos) over (order by s desc) as cp, sum(neg) over (order by s desc) as cn from (
      select round(p_buy, 3) as s, count(*) filter (y > 0) as pos, count(*) filter (y = 0) as neg from scores group by 1))"""))
def average_precision(spark, sf):
    t = V.scores(spark, sf).withColumn("s", F.round("p_buy", 3))
    return rounded(M.average_precision_score(t, "s", F.col("y") > 0))


@query("f1_logloss", with_views("scores", """select round(sum(tp) / sum(nt), 6) as accuracy, round(sum(2.0 * tp / (np + nt) * nt) / sum(nt), 6) as f1_weighted,
    round((select avg(-ln(least(greatest(probs[y + 1], 2.220446049250313e-16), 1 - 2.220446049250313e-16))) from scores), 6) as log_loss from (
    select cls, count(*) filter (p = cls and y = cls) as tp, count(*) filter (p = cls) as np, count(*) filter (y = cls) as nt
    from (select y, list_position(probs, list_max(probs)) - 1 as p from scores), (select unnest(range(0, 16)) as cls) group by 1) where np + nt > 0"""))
def f1_logloss(spark, sf):
    return rounded(M.f1_logloss(_pred(spark, sf), "pred", "y", "probs"))


@query("regression_metrics", """with t as (select l_extendedprice as t, l_quantity * (select avg(l_extendedprice / l_quantity) from lineitem) as p from lineitem)
    select round(avg((t - p) * (t - p)), 2) as mse, round(corr(t, p), 6) as corr, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) as r2 from t""")
def regression_metrics(spark, sf):
    t = V.read(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    rate = t.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).first()[0]
    out = M.regression_metrics(t.withColumn("p", F.col("l_quantity") * F.lit(rate)), "l_extendedprice", "p")
    return out.select(F.round("mse", 2).alias("mse"), F.round("corr", 6).alias("corr"), F.round("r2", 6).alias("r2"))


_p2 = "cast(list_position(probs2, list_max(probs2)) - 1 as integer)"
_p1 = "cast(list_position(probs, list_max(probs)) - 1 as integer)"


@query("compare_predictions", with_views("scores", f"""select count(*) filter (y = 0) as n_non_buyers, count(*) filter (y <> 0) as n_buyers,
    round(coalesce(avg(case when y = 0 then cast(pa = 0 as int) end), 0) * 100, 6) as hold_a, round(coalesce(avg(case when y = 0 then cast(pb = 0 as int) end), 0) * 100, 6) as hold_b,
    round(coalesce(avg(case when y <> 0 then cast(pa = y as int) end), 0) * 100, 6) as top1_a, round(coalesce(avg(case when y <> 0 then cast(pb = y as int) end), 0) * 100, 6) as top1_b,
    round(coalesce(avg(case when y = 0 then probs[1] end), 0), 6) as mean_p0_a, round(coalesce(avg(case when y = 0 then probs2[1] end), 0), 6) as mean_p0_b,
    count(*) filter (y = 0 and pa = 0 and pb > 0) as a_held_b_fired, count(*) filter (y = 0 and pb = 0 and pa > 0) as b_held_a_fired
    from (select *, {_p1} as pa, {_p2} as pb from scores)"""))
def compare_predictions(spark, sf):
    return rounded(M.compare_predictions(*_two_sets(spark, sf)))


def _two_sets(spark, sf):
    t = V.scores(spark, sf)
    return tuple(
        t.select("row_id", "y", A.argmax(F.col(p)).alias("pred"), F.get(p, F.lit(0)).alias("p0")) for p in ("probs", "probs2"))


@query("disagreement_top", with_views("scores", f"""select cls, count(*) as n from (select y, {_p1} as pa, {_p2} as cls from scores)
    where y = 0 and pa = 0 and cls > 0 group by 1 order by n desc, cls limit 5"""))
def disagreement_top(spark, sf):
    return M.disagreement_top(*_two_sets(spark, sf))


@query("hold_by_stratum", with_views("scores", f"""select case when is_cold then 'dormant' else 'active' end as stratum, count(*) as n,
    round(avg(cast({_p1} = 0 as int)) * 100, 6) as hold_a, round(avg(cast({_p2} = 0 as int)) * 100, 6) as hold_b from scores where y = 0 group by 1"""))
def hold_by_stratum(spark, sf):
    t = V.scores(spark, sf).where(F.col("y") == 0)
    return rounded(t.groupBy(F.when(F.col("is_cold"), "dormant").otherwise("active").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), M.pct_of(A.argmax(F.col("probs")) == 0).alias("hold_a"), M.pct_of(A.argmax(F.col("probs2")) == 0).alias("hold_b")))


def _record_sql():
    def m(expr, name, cond="", scale="", nd=4):
        inner = f"case when {cond} then {expr} end" if cond else expr
        return f"round(coalesce(avg({inner}), 0){scale}, {nd}) as {name}"

    t = "len(actual) > 0"
    cols = []
    for k in (4, 7):
        ap = f"coalesce({ap_sql('base_recs', k=k)}, 0)"
        cols += [m(ap, f"map{k}", t), m(ap, f"warm_map{k}", f"{t} and not is_cold"), m(ap, f"cold_map{k}", f"{t} and is_cold")]
    cols += [m(ndcg_sql('base_recs', k=k), f"ndcg{k}", t) for k in (4, 5, 7)]
    cols.append(m(rr_sql('base_recs'), "mrr", t))
    for k in (3, 4, 7):
        cols += [m(f"cast({hits_sql('base_recs', k=k)} as double) / len(actual)", f"recall{k}", t),
                 m(f"cast({hits_sql('base_recs', k=k)} > 0 as int)", f"hit_rate{k}", t, " * 100", 2)]
    p = _p1
    cols += [m(f"cast({p} > 0 as int)", "active_alerts_pct", "", " * 100", 2), m(f"cast({p} = 0 as int)", "silent_alerts_pct", "", " * 100", 2),
             m(f"cast({p} = y as int)", "buyer_top1_acc", "y <> 0", " * 100", 2), m(f"cast({p} = y as int)", "non_buyer_acc", "y = 0", " * 100", 2),
             m(f"cast({p} = y as int)", "overall_top1_acc", "", " * 100", 2), "'softmax_a' as model_name"]
    tail = with_views("cands", "").rstrip()
    return f"""{tail}, {_dist}, parts as (select
      (select round(sum(n * abs(acc - conf)) / sum(n), 4) from (select ceil(list_max(probs) * 10) as bin, count(*) as n, avg({_acc}) as acc, avg(list_max(probs)) as conf from scores group by 1)) as ece,
      (select round(sum((q - p) * ln(q / p)), 4) from (select greatest(q0, 1e-4) / sum(greatest(q0, 1e-4)) over () as p, greatest(p0, 1e-4) / sum(greatest(p0, 1e-4)) over () as q from dist)) as psi,
      (select round(sum((case when q0 > 0 then q0 * log2(q0 / ((p0 + q0) / 2)) else 0 end + case when p0 > 0 then p0 * log2(p0 / ((p0 + q0) / 2)) else 0 end) / 2), 4) from dist) as js_divergence,
      (select round(sqrt(sum((case when q0 > 0 then q0 * log2(q0 / ((p0 + q0) / 2)) else 0 end + case when p0 > 0 then p0 * log2(p0 / ((p0 + q0) / 2)) else 0 end) / 2)), 4) from dist) as js_distance,
      (select {_gini} from (select n, row_number() over (order by n) as i from (select c.cls, count(x.cls) as n from (select cast(unnest(range(1, 16)) as integer) as cls) c
        left join (select unnest(base_recs) as cls from cands) x using (cls) group by 1))) as catalog_gini)
    select * from (select {', '.join(cols)} from cands), parts"""


@query("model_record", _record_sql())
def model_record(spark, sf):
    t = _cands(spark, sf)
    return M.model_record(t, "softmax_a", M.class_distribution(t, "y", 16), CATALOG, 16)


# -------------------------------------------------------------------- fusion

def _fused(expr):
    return with_views("scores", f"select row_id, array_to_string({expr}, ',') as recs from scores")


_blend = "list_transform(range(1, 17), lambda i: 0.5 * probs2[i] + 0.5 * probs[i])"


@query("fuse_linear", with_views("scores", f"select row_id, array_to_string({V.unheld_sql(V.ranked_sql('f'))}, ',') as recs from (select *, {_blend} as f from scores)"))
def fuse_linear(spark, sf):
    recs = U.fuse_linear(F.col("probs"), F.col("probs2"), F.col("held"), 0.5)
    return V.scores(spark, sf).select("row_id", A.joined(recs).alias("recs"))


@query("fuse_logodds", with_views("scores", f"""select row_id, array_to_string({V.unheld_sql(V.ranked_sql('f'))}, ',') as recs from (
    select *, list_transform(range(1, 17), lambda i: ln(probs2[i] + 1e-6) + 0.25 * ln(probs[i] + 1e-6)) as f from scores)"""))
def fuse_logodds(spark, sf):
    recs = U.fuse_logodds(F.col("probs"), F.col("probs2"), F.col("held"), 0.25)
    return V.scores(spark, sf).select("row_id", A.joined(recs).alias("recs"))


@query("fuse_rrf", with_views("scores", f"""select row_id, array_to_string({V.unheld_sql('o')}, ',') as recs from (select row_id, held,
    list_transform(list_sort(list_transform(range(1, 16), lambda c: {{'n': -(1.0 / (60 + list_position(a, c)) + 1.0 / (60 + list_position(b, c))), 'c': cast(c as integer)}})), lambda s: s.c) as o
    from (select row_id, held, {V.ranked_sql('probs')} as a, {V.ranked_sql('probs2')} as b from scores))"""))
def fuse_rrf(spark, sf):
    recs = U.fuse_rrf(F.col("probs"), F.col("probs2"), F.col("held"))
    return V.scores(spark, sf).select("row_id", A.joined(recs).alias("recs"))


@query("fuse_two_stage", with_views("scores", f"""select row_id, array_to_string(list_concat(list_filter(rest, lambda c: list_contains(picked, c)),
    list_filter(rest, lambda c: not list_contains(picked, c)))[1:7], ',') as recs from (select row_id,
    {V.unheld_sql(V.ranked_sql('probs'), k=5)} as picked, {V.unheld_sql(V.ranked_sql('probs2'), k=15)} as rest from scores)"""))
def fuse_two_stage(spark, sf):
    recs = U.fuse_two_stage(F.col("probs"), F.col("probs2"), F.col("held"), m=5)
    return V.scores(spark, sf).select("row_id", A.joined(recs).alias("recs"))
