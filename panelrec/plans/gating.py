"""Queries: gates, cascade, sweeps and threshold fits."""

from pyspark.sql import functions as F

from panelrec.config import CascadeSpec
from panelrec.functions import arrays as A
from panelrec.operators import decide as D
from panelrec.operators import metrics as M
from panelrec.operators import sweeps as W
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import r6, with_views

NOISY = "(1, 7, 9, 14, 15)"
THETAS = {1: 6.0, 2: 1.5, 3: 1.0, 4: 2.5, 5: 1.8, 6: 3.5, 7: 6.0, 8: 1.2, 9: 6.0, 10: 1.5, 11: 1.8, 12: 2.0, 13: 2.5, 14: 6.0, 15: 6.0}
THETA_SQL = "(case cand " + " ".join(f"when {c} then {t}" for c, t in THETAS.items()) + " else 1.5 end)"
ENTROPY_SQL = """(-list_sum(list_transform(probs[2:16], lambda p: p / (list_sum(probs[2:16]) + 1e-12)
    * ln(p / (list_sum(probs[2:16]) + 1e-12) + 1e-12))) / ln(15.0))"""


def _cands(spark, sf):
    return D.with_candidates(V.scores(spark, sf))


def _gated(fire_sql):
    return with_views("cands", f"""select row_id, case when {fire_sql} then cand else 0 end as pred,
      case when {fire_sql} then array_to_string(base_recs, ',') else '' end as recs from cands""")


def _out(df):
    return df.select("row_id", "pred", A.joined(F.col("recs")).alias("recs"))




@query("gate_propensity", _gated("p_buy >= 0.2"))
def gate_propensity(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_propensity(0.2)))


@query("gate_odds", _gated("odds > 3.0"))
def gate_odds(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_odds(3.0)))


@query("gate_margin", _gated("odds > 1.5 and p_top - p_second > 0.04"))
def gate_margin(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_margin(1.5, 0.04)))


@query("gate_entropy", _gated(f"odds > 1.5 and {ENTROPY_SQL} <= 0.85"))
def gate_entropy(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_entropy(1.5, 0.85)))


@query("gate_per_class", _gated(f"odds > {THETA_SQL}"))
def gate_per_class(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_per_class(THETAS)))


@query("gate_hybrid", _gated(f"odds > {THETA_SQL} and p_top - p_second > 0.02"))
def gate_hybrid(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_hybrid(THETAS, 0.02)))


@query("gate_prob_margin", _gated("p_top - p0 >= 0.1"))
def gate_prob_margin(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_prob_margin(0.1)))


@query("gate_two_tier", _gated(f"p_buy >= 0.2 and odds > case when cand in {NOISY} then 6.0 else 1.8 end"))
def gate_two_tier(spark, sf):
    return _out(D.apply_gate(_cands(spark, sf), D.gate_two_tier(CascadeSpec(), 0.2)))


_shift = "list_concat([logits[1] + 1.5], logits[2:16])"


@query("gate_logit_shift", with_views("scores", f"""
    select row_id, pred, case when pred = 0 then '' else array_to_string({V.unheld_sql(V.ranked_sql('sp'))}, ',') end as recs
    from (select *, cast(list_position(sp, list_max(sp)) - 1 as integer) as pred from (select row_id, held, {V.softmax_sql('z')} as sp
      from (select row_id, held, {_shift} as z from scores)))"""))
def gate_logit_shift(spark, sf):
    shifted = V.scores(spark, sf).withColumn("probs", D.shifted_probs(F.col("logits"), 1.5))
    pred = A.argmax(F.col("probs"))
    recs = A.unheld_topk(A.ranked_classes(F.col("probs")), F.col("held"), 7)
    return shifted.select(
        "row_id", pred.alias("pred"), F.when(pred == 0, F.lit("")).otherwise(A.joined(recs)).alias("recs"))


# ------------------------------------------------------------------- cascade

@query("cascade_route", with_views("decisions", """select event_id, user_id, action, regime, prediction, array_to_string(recs, ',') as recs,
    is_active, skipped, round(odds_ratio, 6) as odds_ratio from decisions"""))
def cascade_route(spark, sf):
    out = V.decisions(spark, sf)
    return rounded(out.select(
        "event_id", "user_id", "action", "regime", "prediction", A.joined(F.col("recs")).alias("recs"), "is_active", "skipped", "odds_ratio"))


@query("cascade_on_events", with_views("decisions", """select regime, action, count(*) as n, round(avg(p_buy), 6) as avg_p_buy,
    count(*) filter (is_active) as n_live from decisions group by 1, 2"""))
def cascade_on_events(spark, sf):
    """The gated form: probabilities are looked up only for rows past the first gate."""
    events = V.actions(spark, sf)
    known = V.scores(spark, sf).select(F.col("row_id").alias("user_id"), "probs")

    def scorer(df):
        from panelrec.operators.scale import join_lookup

        uniform = F.array_repeat(F.lit(1.0 / 16), 16)  # unknown users: a vector of zeros
        return join_lookup(df, known, ["user_id"]).withColumn("probs", F.coalesce("probs", uniform))

    out = D.cascade(events.drop("probs"), V.RELEVANCE, scorer)
    return rounded(out.groupBy("regime", "action").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_buy").alias("avg_p_buy"), F.sum(F.col("is_active").cast("int")).alias("n_live")))


_names = "[" + ", ".join(f"'{n}'" for n in V.CLASS_NAMES) + "]"


@query("decision_payload", with_views("decisions", f"""select cast(user_id as varchar) as customer_id, action, cast(prediction as varchar) as prediction,
    ({_names})[prediction + 1] as top_product,
    cast(to_json(case when len(recs) > 0 then list_transform(recs, lambda c: ({_names})[c + 1]) else [({_names})[prediction + 1]] end) as varchar) as recommendations,
    cast(is_active as varchar) as is_active_trigger, cast(skipped as varchar) as gpu_skipped, printf('%.4f', p_buy) as p_buy,
    printf('%.4f', odds_ratio) as odds_ratio, regime, printf('%.2f', latency_ms) as latency_ms from decisions"""))
def decision_payload(spark, sf):
    return D.payload(V.decisions(spark, sf), V.CLASS_NAMES)


@query("replay_report", with_views("decisions", """select count(*) filter (regime = 'stage1_cpu_hold') as stage1_cpu_hold,
    count(*) filter (regime = 'stage2_gate1c_hold') as stage2_gate1c_hold, count(*) filter (regime = 'candidate_a_silent_cache') as candidate_a_silent_cache,
    count(*) filter (regime = 'candidate_c_live_push') as candidate_c_live_push, count(*) as n_events,
    round(avg(case when y = 0 then cast(prediction = 0 as int) end) * 100, 6) as non_buyer_hold,
    round(avg(case when y > 0 then cast(prediction = y as int) end) * 100, 6) as buyer_top1,
    round(avg(cast(prediction = y as int)) * 100, 6) as overall,
    round(avg(case when y = 0 then cast(not is_active as int) end) * 100, 6) as non_buyer_live_hold,
    round(avg(cast(not is_active as int)) * 100, 6) as live_suppressed from decisions"""))
def replay_report(spark, sf):
    return rounded(D.replay_report(V.decisions(spark, sf)))


@query("audit_matches", with_views("decisions", """select event_id, user_id, prediction, top1 as top1_match,
    top1 or len(present) > 0 as topk_match,
    cast(case when top1 then case when y <> 0 then 1 else 0 end when len(present) > 0 then list_position(recs, present[1]) else -1 end as integer) as target_rank
    from (select *, coalesce((y = 0 and prediction = 0) or list_contains(actual, prediction) or prediction = y, false) as top1,
      list_filter(list_concat(actual, case when y is null or list_contains(actual, y) then [] else [y] end), lambda c: list_contains(recs, c)) as present from decisions)"""))
def audit_matches(spark, sf):
    return D.audit_matches(V.decisions(spark, sf)).select("event_id", "user_id", "prediction", "top1_match", "topk_match", "target_rank")


# -------------------------------------------------------------------- sweeps

def ap_sql(recs, actual="actual", k=7):
    hits = f"len(list_filter(({recs})[1:i], lambda c: list_contains({actual}, c)))"
    return f"""(list_sum(list_transform(range(1, least(len({recs}), {k}) + 1), lambda i: case when list_contains({actual}, ({recs})[i])
      then cast({hits} as double) / i else 0.0 end)) / least(len({actual}), {k}))"""


def hits_sql(recs, actual="actual", k=7):
    return f"len(list_filter(({recs})[1:{k}], lambda c: list_contains({actual}, c)))"


def rr_sql(recs, actual="actual", k=7):
    place = f"list_position(list_transform(({recs})[1:{k}], lambda c: list_contains({actual}, c)), true)"
    return f"coalesce(1.0 / nullif({place}, 0), 0.0)"


def ndcg_sql(recs, actual="actual", k=7):
    gain = f"coalesce(list_sum(list_transform(range(1, least(len({recs}), {k}) + 1), lambda i: case when list_contains({actual}, ({recs})[i]) then 1.0 / log2(i + 1) else 0.0 end)), 0.0)"
    ideal = f"list_sum(list_transform(range(1, least(len({actual}), {k}) + 1), lambda i: 1.0 / log2(i + 1)))"
    return f"({gain} / {ideal})"


ROW_SCORES = f"""row_scores as materialized (select *, case when len(actual) > 0 then coalesce({ap_sql('base_recs')}, 0.0) end as ap,
    case when len(actual) > 0 then {ndcg_sql('base_recs')} end as ndcg, case when len(actual) > 0 then {rr_sql('base_recs')} end as rr,
    case when len(actual) > 0 then cast({hits_sql('base_recs')} > 0 as double) end as hit,
    case when len(actual) > 0 then cast({hits_sql('base_recs')} as double) / len(actual) end as recall from cands)"""

BUNDLE = """round(coalesce(avg(case when y > 0 then cast(case when fire then cand else 0 end = y as int) end), 0) * 100, 6) as buyer_top1,
    round(coalesce(avg(case when y = 0 then cast(not fire as int) end), 0) * 100, 6) as non_buyer_top1,
    round(avg(cast(case when fire then cand else 0 end = y as int)) * 100, 6) as overall_top1,
    round(avg(cast(fire as int)) * 100, 6) as alert_pct,
    round(coalesce(avg(case when ap is not null then case when fire then ap else 0 end end), 0), 6) as map7,
    round(coalesce(avg(case when ap is not null and is_cold then case when fire then ap else 0 end end), 0), 6) as cold_map7,
    round(coalesce(avg(case when ap is not null and not is_cold then case when fire then ap else 0 end end), 0), 6) as warm_map7,
    round(coalesce(avg(case when ap is not null then case when fire then ndcg else 0 end end), 0), 6) as ndcg7,
    round(coalesce(avg(case when ap is not null then case when fire then rr else 0 end end), 0), 6) as mrr,
    round(coalesce(avg(case when ap is not null then case when fire then hit else 0 end end), 0) * 100, 6) as hit7,
    round(coalesce(avg(case when ap is not null then case when fire then recall else 0 end end), 0), 6) as recall7"""
CONDITIONAL = "round(coalesce(avg(case when ap is not null and y > 0 and fire and len(base_recs) > 0 then ap end), 0), 6) as conditional_map7"


def sweep_sql(grid, params, fire, extra=f", {CONDITIONAL}"):
    head = with_views("cands", "").rstrip()
    return f"""{head},\n{ROW_SCORES}\nselect {params}, {BUNDLE}{extra} from (select *, {fire} as fire from row_scores, {grid}) group by all"""


def grid_sql(**axes):
    return ", ".join(f"(select unnest([{', '.join(map(str, v))}]::double[]) as {k})" for k, v in axes.items())


T1 = (1.0, 1.5, 2.0, 3.0, 6.0)
DELTAS = (0.02, 0.05, 0.1)
TAUS = (0.7, 0.8, 0.9)
GAMMAS = (0.1, 0.2, 0.3, 0.5, 0.7)


@query("sweep_theta", sweep_sql(grid_sql(theta=T1), "theta", "odds > theta"))
def sweep_theta(spark, sf):
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("theta", F.col("odds"), T1)]))


@query("sweep_margin", sweep_sql(grid_sql(theta=T1, delta=DELTAS), "theta, delta", "odds > theta and p_top - p_second > delta"))
def sweep_margin(spark, sf):
    margin = F.col("p_top") - F.col("p_second")
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("theta", F.col("odds"), T1), W.Axis("delta", margin, DELTAS)]))


@query("sweep_entropy", sweep_sql(grid_sql(theta=T1, tau=TAUS), "theta, tau", f"odds > theta and {ENTROPY_SQL} <= tau"))
def sweep_entropy(spark, sf):
    h = A.entropy_share(F.col("probs"), 15)
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("theta", F.col("odds"), T1), W.Axis("tau", h, TAUS, "<=")]))


@query("sweep_gamma", sweep_sql(grid_sql(gamma=GAMMAS), "gamma", "p_buy >= gamma"))
def sweep_gamma(spark, sf):
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("gamma", F.col("p_buy"), GAMMAS, ">=")]))


@query("sweep_prob_margin", sweep_sql(grid_sql(delta=DELTAS), "delta", "p_top - p0 >= delta"))
def sweep_prob_margin(spark, sf):
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("delta", F.col("p_top") - F.col("p0"), DELTAS, ">=")]))


LAMBDAS = (0.0, 0.5, 1.0, 2.0)


@query("sweep_logit_shift", sweep_sql(grid_sql(lambda_shift=LAMBDAS), "lambda_shift", "list_max(logits[2:16]) - logits[1] > lambda_shift"))
def sweep_logit_shift(spark, sf):
    """A shift lambda turns a row to hold when its best item logit leads by no more than it."""
    lead = F.array_max(A.item_probs(F.col("logits"))) - F.get("logits", F.lit(0))
    return rounded(W.sweep(_cands(spark, sf), [W.Axis("lambda_shift", lead, LAMBDAS)]))


CONFIGS = (
    W.GateConfig("argmax", None, 1.0, 1.0),
    W.GateConfig("relaxed", 0.2, 6.0, 1.8),
    W.GateConfig("tight", 0.3, 6.0, 1.8),
    W.GateConfig("strict", 0.5, 8.0, 3.0),
)
_cfg = "(select * from (values " + ", ".join(
    f"('{c.name}', cast({'null' if c.gamma is None else c.gamma} as double), cast({c.theta_noisy} as double), cast({c.theta_clean} as double))" for c in CONFIGS
) + ") t(config, gamma, theta_noisy, theta_clean))"
_cfg_fire = f"(gamma is null or p_buy >= gamma) and odds > case when cand in {NOISY} then theta_noisy else theta_clean end"
CONFIG_SQL = sweep_sql(_cfg, "config, gamma, theta_noisy, theta_clean", _cfg_fire,
                       f", {CONDITIONAL}, round(avg(cast(coalesce(p_buy < gamma, false) as int)) * 100, 6) as saved_pct")


@query("sweep_configs", CONFIG_SQL)
def sweep_configs(spark, sf):
    return rounded(W.sweep_configs(_cands(spark, sf), CONFIGS))


@query("pareto_pick", sweep_sql(grid_sql(theta=T1), "theta", "odds > theta") + " having non_buyer_top1 >= 50 order by buyer_top1 desc, theta limit 1")
def pareto_pick(spark, sf):
    swept = W.sweep(_cands(spark, sf), [W.Axis("theta", F.col("odds"), T1)])
    return rounded(W.pareto_pick(swept, "non_buyer_top1", 50.0, "buyer_top1", ["theta"]))


@query("verdict", f"""with r as ({CONFIG_SQL}), b as (select * from r where config = 'strict')
    select r.config, round(r.map7 - b.map7, 5) + 0.0 as map_delta, round(r.cold_map7 - b.cold_map7, 5) + 0.0 as cold_delta,
      round(r.buyer_top1 - b.buyer_top1, 4) + 0.0 as buyer_delta from r, b where r.config <> 'strict' and
      (r.map7 - b.map7 > 0.005 or r.cold_map7 - b.cold_map7 > 0.02 or (r.buyer_top1 - b.buyer_top1 > 2 and r.map7 - b.map7 >= -0.01))""")
def verdict(spark, sf):
    swept = rounded(W.sweep_configs(_cands(spark, sf), CONFIGS))
    out = W.verdict(swept, "config", "strict")
    return out.select("config", F.round("map_delta", 5).alias("map_delta"), F.round("cold_delta", 5).alias("cold_delta"), F.round("buyer_delta", 4).alias("buyer_delta"))


_fp = """select c.cls, coalesce(true_count, 0) as true_count, coalesce(tp, 0) as tp, coalesce(fp_nb, 0) as fp_nb,
    case when fired > 0 then round(cast(coalesce(fp_nb, 0) as double) / fired * 100, 1) else 0.0 end as fp_share_pct,
    round(coalesce(tp, 0) / (coalesce(tp, 0) + coalesce(fp_nb, 0) + 1e-9) * 100, 1) as prec_vs_nb
    from (select cast(unnest(range(1, 16)) as integer) as cls) c cross join (select count(*) as fired from pr where y = 0 and pred > 0)
    left join (select c2.cls, count(*) filter (y = c2.cls) as true_count, count(*) filter (y = c2.cls and pred = c2.cls) as tp,
      count(*) filter (y = 0 and pred = c2.cls) as fp_nb from pr, (select cast(unnest(range(1, 16)) as integer) as cls) c2 group by 1) using (cls)"""
_pr = "pr as materialized (select row_id, y, cast(list_position(probs, list_max(probs)) - 1 as integer) as pred from scores)"
FP_SQL = f"{with_views('scores', '').rstrip()},\n{_pr}\n{_fp}"


def _argmaxed(spark, sf):
    return V.scores(spark, sf).withColumn("pred", A.argmax(F.col("probs")))


@query("fp_breakdown", FP_SQL)
def fp_breakdown(spark, sf):
    return M.fp_breakdown(_argmaxed(spark, sf), "pred", "y", 16)


@query("fit_tier_thresholds", f"""{with_views('scores', '').rstrip()},\n{_pr},\nfp as ({_fp})
    select 'moderate' as tiers, cls, cast(case when prec_vs_nb >= 70 then 1.0 when prec_vs_nb >= 45 then 1.5 when prec_vs_nb >= 30 then 2.5 else 3.5 end as double) as theta from fp
    union all select 'strict', cls, cast(case when prec_vs_nb >= 70 then 1.0 when prec_vs_nb >= 45 then 1.5 when prec_vs_nb >= 30 then 3.0 else 4.5 end as double) from fp""")
def fit_tier_thresholds(spark, sf):
    table = M.fp_breakdown(_argmaxed(spark, sf), "pred", "y", 16)
    both = [W.fit_tier_thresholds(table, t).select(F.lit(t).alias("tiers"), "cls", "theta") for t in ("moderate", "strict")]
    return both[0].unionByName(both[1])


@query("fit_coordinate_ascent")
def fit_coordinate_ascent(spark, sf):
    return W.fit_coordinate_ascent(_cands(spark, sf), ["row_id"], floor=20.0)
