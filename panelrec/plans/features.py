"""Queries: lags, labels, feature expressions, lists and vectors."""

import math

from pyspark.sql import functions as F

from panelrec.functions import arrays as A
from panelrec.functions import scalars as S
from panelrec.operators import panel as P
from panelrec.operators.clean import group_medians, latest_snapshot
from panelrec.operators.scale import join_lookup
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import CM_ITEMS, CM_SPEC, ITEMS, UD_SPEC, r6, with_views
from panelrec.session import staged

KEY = "user_id, cast(d as varchar) as d"


def _lags(spark, sf):
    return P.with_lags(V.panel_ud(spark, sf), UD_SPEC)


@query("lag1_holdings", with_views("lags_ud", f"select {KEY}, {', '.join(f'has_{i}_lag1' for i in ITEMS)} from lags_ud"))
def lag1_holdings(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[f"has_{i}_lag1" for i in ITEMS]))


@query("lag2_holdings", with_views("lags_ud", f"select {KEY}, {', '.join(f'has_{i}_lag2' for i in ITEMS)} from lags_ud"))
def lag2_holdings(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[f"has_{i}_lag2" for i in ITEMS]))


@query("velocity_deltas", with_views("lags_ud", f"select {KEY}, " + ", ".join(
    f"has_{i}_lag1 - has_{i}_lag2 as delta_{i}" for i in UD_SPEC.deltas) + " from lags_ud"))
def velocity_deltas(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[v.alias(n) for n, v in P.velocity(UD_SPEC).items()]))


@query("activity_dynamics", with_views("lags_ud", f"select {KEY}, click_lag1, click_lag2, click_lag1 - click_lag2 as activity_delta from lags_ud"))
def activity_dynamics(spark, sf):
    return rounded(_lags(spark, sf).select(
        "user_id", "d", "click_lag1", "click_lag2", (F.col("click_lag1") - F.col("click_lag2")).alias("activity_delta")))


@query("acquisitions", with_views("lags_ud", f"select {KEY}, " + ", ".join(
    f"case when {i} = 1 and has_{i}_lag1 = 0 then 1 else 0 end as added_{i}" for i in ITEMS) + " from lags_ud"))
def acquisitions(spark, sf):
    return rounded(_lags(spark, sf).select(
        "user_id", "d", *[F.when(P.acquired(i), 1).otherwise(0).alias(f"added_{i}") for i in ITEMS]))


@query("added_products", with_views("labels_ud", f"""select {KEY}, array_to_string(added, ',') as classes,
    array_to_string(added_names, ',') as names from labels_ud"""))
def added_products(spark, sf):
    return rounded(_lags(spark, sf).select(
        "user_id", "d", A.joined(P.added_classes(UD_SPEC)).alias("classes"), A.joined(P.added_names(UD_SPEC)).alias("names")))


@query("primary_label", with_views("labels_ud", f"select {KEY}, coalesce(added[1], 0) as target_class from labels_ud"))
def primary_label(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", A.first_or(P.added_classes(UD_SPEC), F.lit(0)).alias("target_class")))


@query("explode_labels", with_views("labels_ud", f"""select {KEY}, unnest(case when len(added) = 0 then [0] else added end) as target_class
    from labels_ud"""))
def explode_labels(spark, sf):
    label = P.added_classes(UD_SPEC)
    label = F.when(F.size(label) == 0, F.array(F.lit(0))).otherwise(label)
    return rounded(_lags(spark, sf).select("user_id", "d", F.explode(label).alias("target_class")))


@query("holdout_targets", with_views("panel_ud", f"""
    select user_id, cast(d as varchar) as d, coalesce(added[1], 0) as target_class, array_to_string(added, ',') as target_classes,
      array_to_string(names, ',') as added_products, {', '.join(f'added_{i}' for i in ITEMS)}
    from (select *, {V.added_sql(ITEMS)} as added, {V.added_sql(ITEMS, True)} as names,
      {', '.join(f'case when {i} = 1 and has_{i}_lag1 = 0 then 1 else 0 end as added_{i}' for i in ITEMS)}
      from (select *, {V.lag_sql(ITEMS, 'user_id', 'd')} from panel_ud where d in (date '2024-01-20', date '2024-01-19')))
    where d = date '2024-01-20'"""))
def holdout_targets(spark, sf):
    panel = V.panel_ud(spark, sf)
    day = {n: panel.where(F.col("d") == F.lit(n).cast("date")) for n in ("2024-01-20", "2024-01-19")}
    out = P.holdout_targets(day["2024-01-20"], day["2024-01-19"], UD_SPEC)
    return rounded(out.select(
        "user_id", "d", "target_class", A.joined(F.col("target_classes")).alias("target_classes"),
        A.joined(F.col("added_products")).alias("added_products"),
        *[F.col(f"added_{i}").cast("int").alias(f"added_{i}") for i in ITEMS]))


def _calendar_sql(day):
    m = f"month({day})"
    angle = f"{2 * math.pi!r} * {m} / 12.0"
    seasons = {"is_tax_season": "(4, 5, 6)", "is_pension_season": "(11, 12)", "is_academic_season": "(9, 10)", "is_summer_season": "(6, 7)"}
    return ", ".join([
        f"cast({m} as integer) as snap_month", f"round(sin({angle}), 4) + 0.0 as sin_month", f"round(cos({angle}), 4) + 0.0 as cos_month",
        *[f"case when {m} in {v} then 1 else 0 end as {k}" for k, v in seasons.items()]])


def _features_sql(spec, items, table, money=""):
    lag1 = [f"has_{i}_lag1" for i in items]
    total1, total2 = " + ".join(lag1), " + ".join(f"has_{i}_lag2" for i in items)
    cols = [
        *lag1, *[f"has_{i}_lag2" for i in items], f"{spec.activity}_lag1", f"{spec.activity}_lag2",
        f"{spec.activity}_lag1 - {spec.activity}_lag2 as activity_delta",
        *[f"has_{i}_lag1 - has_{i}_lag2 as delta_{i}" for i in spec.deltas],
        f"{total1} as total_products_lag1", f"{total2} as total_products_lag2", f"({total1}) - ({total2}) as delta_total_products",
        f"case when {total1} > 0 then 1 else 0 end as has_any_product_lag1",
        *[f"round(cast({' + '.join(f'has_{i}_lag1' for i in p)} as double) / {len(p)}.0, 6) as {n}" for n, p in spec.bundles.items()],
        *[f"case when has_{h}_lag1 = 1 and has_{x}_lag1 = 0 then 1 else 0 end as {n}" for n, (h, x) in spec.eligibility.items()],
        _calendar_sql(spec.time),
    ]
    return ", ".join(cols) + money


@query("panel_features", with_views("labels_ud", f"""select {KEY}, {_features_sql(UD_SPEC, ITEMS, 'labels_ud')},
    unnest(case when len(added) = 0 then [0] else added end) as target_class from labels_ud where prev_snapshot is not null"""))
def panel_features(spark, sf):
    out = rounded(P.panel_features(V.panel_ud(spark, sf), UD_SPEC))
    return _plain_ints(out)


def _plain_ints(df):
    return df.select(*[F.col(c).cast("int").alias(c) if t == "tinyint" else F.col(c) for c, t in df.dtypes])


_money_sql = """, round(ln(1 + income_pos), 6) as log_income,
    round(case when med > 0 then income_pos / med else 1.0 end, 6) as income_to_province_ratio,
    round((year(m) - year(join_date)) * 12.0 + (month(m) - month(join_date)) + (day(m) - day(join_date)) / 31.0, 1) + 0.0 as months_as_customer"""


@query("serving_features", with_views("labels_cm medians_cm", f"""select c_custkey, cast(m as varchar) as m, labels_cm.province as province,
    {_features_sql(CM_SPEC, CM_ITEMS, 'labels_cm', _money_sql)}, coalesce(added[1], 0) as target_class
    from labels_cm left join medians_cm on labels_cm.province = medians_cm.province
    qualify m = max(m) over (partition by c_custkey)"""))
def serving_features(spark, sf):
    panel = staged(V.panel_cm(spark, sf))
    return _plain_ints(rounded(P.serving_features(panel, CM_SPEC)))


@query("portfolio_totals", with_views("lags_ud", f"""select {KEY}, {' + '.join(f'has_{i}_lag1' for i in ITEMS)} as total_products_lag1,
    {' + '.join(f'has_{i}_lag2' for i in ITEMS)} as total_products_lag2,
    ({' + '.join(f'has_{i}_lag1' for i in ITEMS)}) - ({' + '.join(f'has_{i}_lag2' for i in ITEMS)}) as delta_total_products,
    case when {' + '.join(f'has_{i}_lag1' for i in ITEMS)} > 0 then 1 else 0 end as has_any_product_lag1 from lags_ud"""))
def portfolio_totals(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[v.alias(n) for n, v in P.portfolio(UD_SPEC).items()]))


@query("bundle_scores", with_views("lags_ud", f"select {KEY}, " + ", ".join(
    f"round(cast({' + '.join(f'has_{i}_lag1' for i in p)} as double) / 3.0, 6) as {n}" for n, p in UD_SPEC.bundles.items()) + " from lags_ud"))
def bundle_scores(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[v.alias(n) for n, v in P.bundles(UD_SPEC).items()]))


@query("eligibility_flags", with_views("lags_ud", f"select {KEY}, " + ", ".join(
    f"case when has_{h}_lag1 = 1 and has_{x}_lag1 = 0 then 1 else 0 end as {n}" for n, (h, x) in UD_SPEC.eligibility.items()) + " from lags_ud"))
def eligibility_flags(spark, sf):
    return rounded(_lags(spark, sf).select("user_id", "d", *[v.alias(n) for n, v in P.eligibility(UD_SPEC).items()]))


@query("log_amount", "select c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) + 0.0 as log_amount from customer")
def log_amount(spark, sf):
    return rounded(V.read(spark, sf, "customer").select("c_custkey", F.log1p(F.greatest("c_acctbal", F.lit(0.0))).alias("log_amount")))


@query("ratio_to_group_median", with_views("panel_cm medians_cm", """select c_custkey, cast(m as varchar) as m,
    round(case when med > 0 then income_pos / med else 1.0 end, 6) as ratio
    from panel_cm left join medians_cm on panel_cm.province = medians_cm.province"""))
def ratio_to_group_median(spark, sf):
    panel = staged(V.panel_cm(spark, sf).select("c_custkey", "m", "province", "income_pos"))
    t = join_lookup(panel, group_medians(panel, "province", "income_pos"), ["province"])
    return rounded(t.select("c_custkey", "m", S.ratio_or_one(F.col("income_pos"), F.col("median")).alias("ratio")))


@query("months_as_customer", with_views("panel_cm", """select c_custkey, cast(m as varchar) as m,
    round((year(m) - year(join_date)) * 12.0 + (month(m) - month(join_date)) + (day(m) - day(join_date)) / 31.0, 1) + 0.0 as months
    from panel_cm"""))
def months_as_customer(spark, sf):
    return rounded(V.panel_cm(spark, sf).select("c_custkey", "m", S.months_since(F.col("m"), F.col("join_date")).alias("months")))


@query("age_at_join", with_views("panel_cm", """select c_custkey, cast(m as varchar) as m,
    round(cast(province + 20 as double) - (year(m) - 1990) / 12.0, 1) + 0.0 as age_at_join from panel_cm"""))
def age_at_join(spark, sf):
    return rounded(V.panel_cm(spark, sf).select(
        "c_custkey", "m", S.age_at_join(F.col("province") + 20, F.year("m") - 1990).alias("age_at_join")))


@query("calendar_features", with_views("panel_cm", f"select distinct cast(m as varchar) as m, {_calendar_sql('m')} from panel_cm"))
def calendar_features(spark, sf):
    months = V.panel_cm(spark, sf).select("m").distinct()
    return _plain_ints(rounded(months.select("m", *[v.alias(n) for n, v in S.calendar(F.col("m")).items()])))


@query("recent_flag", with_views("panel_cm", """select c_custkey, cast(m as varchar) as m,
    case when m >= (select max(m) from panel_cm) - interval 6 month then 1 else 0 end as is_recent from panel_cm"""))
def recent_flag(spark, sf):
    panel = V.panel_cm(spark, sf)
    newest = panel.agg(F.max("m")).first()[0]
    recent = F.col("m") >= F.add_months(F.lit(newest), -6)
    return rounded(panel.select("c_custkey", "m", F.when(recent, 1).otherwise(0).alias("is_recent")))


@query("clip_values", f"select c_custkey, {r6('least(greatest(c_acctbal, -10), 10)')} as clipped from customer")
def clip_values(spark, sf):
    return rounded(V.read(spark, sf, "customer").select("c_custkey", A.clipped(F.col("c_acctbal"), -10.0, 10.0).alias("clipped")))


@query("signed_log1p", f"select c_custkey, {r6('sign(c_acctbal) * ln(1 + abs(c_acctbal))')} as slog from customer")
def signed_log1p(spark, sf):
    return rounded(V.read(spark, sf, "customer").select("c_custkey", S.signed_log(F.col("c_acctbal")).alias("slog")))


@query("telemetry_parse", """select event_id, event_type = 'purchase' as is_active,
    case when event_type = 'error' then null else round(try_cast(printf('%.2f', value) as double), 6) end as latency_ms from events""")
def telemetry_parse(spark, sf):
    raw = V.read(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "purchase", "True").otherwise("false").alias("flag"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.format_string("%.2f", "value")).alias("lat"))
    return rounded(raw.select("event_id", S.truthy(F.col("flag")).alias("is_active"), S.safe_double(F.col("lat")).alias("latency_ms")))


# -------------------------------------------------------------- lists, vectors

@query("filter_held_topk", with_views("scores", f"select row_id, array_to_string({V.unheld_sql(V.ranked_sql('probs'))}, ',') as recs from scores"))
def filter_held_topk(spark, sf):
    recs = A.unheld_topk(A.ranked_classes(F.col("probs")), F.col("held"), 7)
    return V.scores(spark, sf).select("row_id", A.joined(recs).alias("recs"))


@query("topk_unheld", with_views("scores", f"""select row_id, unnest(range(1, len(recs) + 1)) as place, unnest(recs) as cls
    from (select row_id, {V.unheld_sql(V.ranked_sql('probs'))} as recs from scores)"""))
def topk_unheld(spark, sf):
    recs = A.unheld_topk(A.ranked_classes(F.col("probs")), F.col("held"), 7)
    out = V.scores(spark, sf).select("row_id", F.posexplode(recs).alias("place", "cls"))
    return out.select("row_id", (F.col("place") + 1).cast("bigint").alias("place"), "cls")


@query("array_union_ordered", with_views("scores", """select row_id, array_to_string(list_concat(held,
    list_filter(actual, lambda x: not list_contains(held, x))), ',') as items from scores"""))
def array_union_ordered(spark, sf):
    return V.scores(spark, sf).select("row_id", A.joined(A.ordered_union(F.col("held"), F.col("actual"))).alias("items"))


@query("held_append", with_views("scores", """select row_id, array_to_string(case when y = 0 or list_contains(held, y) then held
    else list_append(held, y) end, ',') as items from scores"""))
def held_append(spark, sf):
    return V.scores(spark, sf).select("row_id", A.joined(A.append_absent(F.col("held"), F.col("y"), F.lit(0))).alias("items"))


@query("held_list", with_views("panel_ud", f"""select {KEY}, array_to_string(list_filter([{', '.join(
    f"case when {i} > 0 then '{i}' end" for i in ITEMS)}], lambda x: x is not null), ',') as held from panel_ud"""))
def held_list(spark, sf):
    return rounded(V.panel_ud(spark, sf).select("user_id", "d", A.joined(A.flagged([(F.col(i), F.lit(i)) for i in ITEMS])).alias("held")))


@query("argmax_class", with_views("scores", f"""select row_id, cast(list_position(probs, list_max(probs)) - 1 as integer) as top_class,
    array_to_string({V.ranked_sql('probs')}, ',') as ranked from scores"""))
def argmax_class(spark, sf):
    return V.scores(spark, sf).select("row_id", A.argmax(F.col("probs")).alias("top_class"), A.joined(A.ranked_classes(F.col("probs"))).alias("ranked"))


@query("action_relevance", with_views("actions", f"""select event_id, action, y as item, {V.relevance_sql('action', 'y')} as relevant from actions"""))
def action_relevance(spark, sf):
    from panelrec.operators.decide import relevant

    return V.actions(spark, sf).select("event_id", "action", F.col("y").alias("item"), relevant(F.col("action"), F.col("y"), V.RELEVANCE).alias("relevant"))


@query("prob_map", with_views("scores", f"""select row_id, '{V.CLASS_NAMES[0]}' as name, {r6('probs[1]')} as p from scores
    union all select row_id, 'item_' || k, {r6('probs[k + 1]')} from scores, range(1, 16) r(k)"""))
def prob_map(spark, sf):
    names = F.array(*[F.lit(n) for n in V.CLASS_NAMES])
    mapped = F.coalesce(F.map_from_arrays(names, F.col("probs")), F.create_map(F.lit(V.CLASS_NAMES[0]), F.lit(1.0)))
    return rounded(V.scores(spark, sf).select("row_id", F.explode(mapped).alias("name", "p")))


@query("actual_list", with_views("scores", """select row_id, case when is_cold then (case when y > 0 then cast(y as varchar) else '' end)
    else array_to_string(list_filter(held, lambda x: x <= 10), ',') end as actual from scores"""))
def actual_list(spark, sf):
    catalog = F.array(*[F.lit(c) for c in range(1, 11)])
    known = F.when(~F.col("is_cold"), F.array_intersect("held", catalog))
    return V.scores(spark, sf).select("row_id", A.joined(F.coalesce(known, F.col("actual"))).alias("actual"))


@query("assemble_vector", with_views("panel_ud", f"select {KEY}, len(v) as width, {r6('list_sum(v)')} as total, {r6('v[6]')} as last from (select *, [{', '.join(f'cast({i} as double)' for i in ITEMS)}, amt] as v from panel_ud)"))
def assemble_vector(spark, sf):
    v = A.assemble([F.col(c) for c in (*ITEMS, "amt")])
    t = V.panel_ud(spark, sf).select("user_id", "d", v.alias("v"))
    return rounded(t.select("user_id", "d", F.size("v").cast("bigint").alias("width"), A.total(F.col("v")).alias("total"), F.get("v", F.lit(5)).alias("last")))


@query("pad_vector", with_views("emb", f"""select row_id, len(p) as width, {r6('list_sum(p)')} as total, {r6('p[64]')} as x64, {r6('p[128]')} as x128,
    {r6('list_sum(e[1:10])')} as head from (select row_id, e, list_resize(e, 128, 0.0) as p from emb)"""))
def pad_vector(spark, sf):
    t = V.vectors(spark, sf).select("row_id", A.pad(F.col("vector"), 128, strict=True).alias("p"), A.pad(F.col("vector"), 10).alias("h"))
    return rounded(t.select(
        "row_id", F.size("p").cast("bigint").alias("width"), A.total(F.col("p")).alias("total"), F.get("p", F.lit(63)).alias("x64"),
        F.get("p", F.lit(127)).alias("x128"), A.total(F.col("h")).alias("head")))


@query("vector_nonzero", with_views("panel_ud", f"select {KEY}, {' + '.join(ITEMS)} as nonzero from panel_ud"))
def vector_nonzero(spark, sf):
    return rounded(V.panel_ud(spark, sf).select("user_id", "d", A.nonzero_count(A.assemble([F.col(i) for i in ITEMS])).alias("nonzero")))


@query("context_vectors", with_views("labels_ud", f"""select user_id, cast(d as varchar) as d, target_class, pos, {r6('least(greatest(v[pos], -10), 10)')} as x
    from (select user_id, d, coalesce(added[1], 0) as target_class,
      list_resize([{', '.join(f'cast(has_{i}_lag1 as double)' for i in ITEMS)}, amt], 8, 0.0) as v from labels_ud), range(1, 9) r(pos)"""))
def context_vectors(spark, sf):
    t = _lags(spark, sf)
    v = A.pad(A.clip_vector(A.assemble([F.col(f"has_{i}_lag1") for i in ITEMS] + [F.col("amt")]), -10.0, 10.0), 8, strict=True)
    t = t.select("user_id", "d", A.first_or(P.added_classes(UD_SPEC), F.lit(0)).alias("target_class"), F.posexplode(v).alias("pos", "x"))
    return rounded(t.withColumn("pos", (F.col("pos") + 1).cast("bigint")))


@query("json_roundtrip", with_views("scores", """select row_id, cast(to_json(held) as varchar) as held_json, len(held) as n_held,
    cast(y as varchar) as y_text from scores"""))
def json_roundtrip(spark, sf):
    packed = V.scores(spark, sf).select(
        "row_id", F.to_json("held").alias("held_json"), F.to_json(F.struct("y", "is_cold")).alias("meta"))
    return packed.select(
        "row_id", "held_json", F.size(F.from_json("held_json", "array<int>")).cast("bigint").alias("n_held"),
        F.get_json_object("meta", "$.y").alias("y_text"))


@query("payload_format", with_views("cands", "select row_id, printf('%.4f', p_buy) as p_buy, printf('%.4f', odds) as odds from cands"))
def payload_format(spark, sf):
    from panelrec.operators.decide import with_candidates

    return with_candidates(V.scores(spark, sf)).select(
        "row_id", F.format_string("%.4f", "p_buy").alias("p_buy"), F.format_string("%.4f", "odds").alias("odds"))


@query("cold_flag", with_views("panel_cm", """select c_custkey, cast(m as varchar) as m,
    (year(m) - year(join_date)) * 12 + month(m) - month(join_date) < 3 as is_cold from panel_cm"""))
def cold_flag(spark, sf):
    months = (F.year("m") - F.year("join_date")) * 12 + F.month("m") - F.month("join_date")
    return rounded(V.panel_cm(spark, sf).select("c_custkey", "m", (months < 3).alias("is_cold")))
