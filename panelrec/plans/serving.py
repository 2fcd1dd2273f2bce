"""Queries: feature store, decision log, event state and telemetry (batch twins of the streams)."""

import uuid

from pyspark.sql import functions as F

from panelrec.functions import arrays as A
from panelrec.functions import scalars as S
from panelrec.operators import encode as E
from panelrec.operators import panel as P
from panelrec.operators import store as T
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import CM_ITEMS, ITEMS, r6, with_views
from panelrec.session import checkpoint_root, staged
from panelrec.streaming.jobs import current, recommendations, recs_table, telemetry_columns
from panelrec.streaming.state import sessions
from panelrec.streaming.telemetry import NEEDED, last_decisions, telemetry_of

_row = f"user_id, {r6('list_sum(vector)')} as total, array_to_string(held, ',') as held, cast(updated_at as varchar) as updated_at"
NOW = "2024-01-30 12:00:00"


def _show(df):
    return df.select(
        "user_id", F.round(A.total(F.col("vector")), 6).alias("total"), A.joined(F.col("held")).alias("held"),
        F.col("updated_at").cast("string").alias("updated_at"))


@query("feature_upsert", with_views("store_first store_batch", f"""select {_row} from (select * from (select *, 0 as f from store_first union all
    select *, 1 as f from store_batch) qualify row_number() over (partition by user_id order by updated_at desc, f desc) = 1)"""))
def feature_upsert(spark, sf):
    return _show(T.upsert(V.store_first(spark, sf), V.store_batch(spark, sf), ["user_id"]))


@query("feature_delete", with_views("store_all store_first", f"select {_row} from store_all where user_id not in (select user_id from store_first)"))
def feature_delete(spark, sf):
    return _show(T.delete_keys(V.store_all(spark, sf), V.store_first(spark, sf), "user_id"))


@query("ttl_filter", with_views("store_all", f"select {_row} from store_all where updated_at + interval 36 hour > timestamp '{NOW}'"))
def ttl_filter(spark, sf):
    now = F.lit(NOW).cast("timestamp_ntz")
    t = V.store_all(spark, sf).withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))
    return _show(T.alive(t, now, ttl=36 * 3600).withColumn("updated_at", F.to_date("updated_at")))


@query("store_stats", with_views("store_all", "select count(*) as n_keys, cast(max(updated_at) as varchar) as newest from store_all"))
def store_stats(spark, sf):
    return rounded(T.store_stats(V.store_all(spark, sf)))


@query("feature_lookup", with_views("store_first store_all", f"""select event_id, events.user_id, {r6('list_sum(coalesce(s.vector, b.vector))')} as total,
    array_to_string(coalesce(s.held, b.held), ',') as held, case when s.user_id is not null then 'store' else 'fallback' end as source
    from events left join store_first s on s.user_id = events.user_id left join store_all b on b.user_id = events.user_id"""))
def feature_lookup(spark, sf):
    ev = V.read(spark, sf, "events").select("event_id", "user_id")
    out = T.lookup(ev, V.store_first(spark, sf), "user_id", len(ITEMS), V.store_all(spark, sf))
    return out.select("event_id", "user_id", F.round(A.total(F.col("vector")), 6).alias("total"), A.joined(F.col("held")).alias("held"), "source")


@query("lookup_unknown", with_views("store_first", f"""select event_id, events.user_id, {r6('list_sum(coalesce(s.vector, [0.0]))')} as total,
    case when s.user_id is not null then 'store' else 'unknown' end as source from events left join store_first s on s.user_id = events.user_id"""))
def lookup_unknown(spark, sf):
    ev = V.read(spark, sf, "events").select("event_id", "user_id")
    out = T.lookup(ev, V.store_first(spark, sf), "user_id", len(ITEMS))
    return out.select("event_id", "user_id", F.round(A.total(F.col("vector")), 6).alias("total"), "source")


@query("lookup_writeback", with_views("store_first store_all", f"""select {_row} from store_all where user_id not in (select user_id from store_first)
    and user_id in (select user_id from events)"""))
def lookup_writeback(spark, sf):
    ev = V.read(spark, sf, "events").select("event_id", "user_id")
    return _show(T.missed(ev, V.store_first(spark, sf), V.store_all(spark, sf), "user_id"))


_cells = (*[f"has_{i}_lag1" for i in CM_ITEMS], "income_pos")
_cell_union = " union all ".join(f"select cast({c} as double) as x from lags_cm where prev_snapshot is not null" for c in _cells)


@query("materialize_features", f"""{with_views('lags_cm', '').rstrip()}, st as (select avg(x) as mu, stddev_pop(x) as sd from ({_cell_union}))
    select c_custkey, cast(m as varchar) as m, round(list_sum(list_transform([{', '.join(f'cast({c} as double)' for c in _cells)}],
      lambda x: least(greatest((x - mu) / sd, -10), 10))), 5) + 0.0 as total from (select * from lags_cm qualify m = max(m) over (partition by c_custkey)), st""")
def materialize_features(spark, sf):
    """Scaled, clipped, padded vectors of every customer's newest month in one job."""
    t = P.with_lags(V.panel_cm(spark, sf), V.CM_SPEC)
    t = staged(t.select("c_custkey", "m", *_cells, "prev_snapshot", "next_snapshot"))
    stats = E.global_stats(t.where(F.col("prev_snapshot").isNotNull()), _cells).first()
    newest = t.where(F.col("next_snapshot").isNull()).select("c_custkey", "m", *_cells)
    z = E.apply_zscore(newest, _cells, stats["mean"], stats["std"], clip=10.0)
    v = A.pad(A.assemble([F.col(c) for c in _cells]), 128, strict=True)
    return z.select("c_custkey", F.col("m").cast("string").alias("m"), F.round(A.total(v), 5).alias("total"))


@query("recs_latest", with_views("decisions", f"""select user_id, event_id, prediction, regime from (select * from decisions
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where ts + interval 12 hour > timestamp '{NOW}'"""))
def recs_latest(spark, sf):
    d = V.decisions(spark, sf).select("user_id", "event_id", "ts", "prediction", "regime")
    out = T.latest_recs(d, "user_id", "ts", "event_id", F.lit(NOW).cast("timestamp_ntz"), 12 * 3600)
    return out.select("user_id", "event_id", "prediction", "regime")


@query("dedup_events", "select event_id, user_id, event_type from events")
def dedup_events(spark, sf):
    """Replayed events count once: the log read twice equals the log."""
    ev = V.read(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.unionByName(ev).dropDuplicates(["event_id"])


@query("held_state", f"""select e.event_id, e.user_id, coalesce((select string_agg(item, ',' order by ts, event_id) from (
      select {V.CLAIM_SQL.replace('event_type', 'f.event_type')} as item, min(f.ts) as ts, min_by(f.event_id, (f.ts, f.event_id)) as event_id from events f
      where f.user_id = e.user_id and f.event_type in ('purchase', 'signup', 'view') and (f.ts, f.event_id) < (e.ts, e.event_id) group by 1)), '') as held from events e""")
def held_state(spark, sf):
    ev = V.claims(spark, sf)
    out = T.held_before(ev, "user_id", "item", ["ts", "event_id"])
    return out.select("event_id", "user_id", A.joined(F.col("held")).alias("held"))


@query("held_decisions", with_views("decisions_held", """select event_id, user_id, regime, prediction, array_to_string(recs, ',') as recs, is_active, is_unknown from decisions_held"""))
def held_decisions(spark, sf):
    """Batch twin of the decision stream with held items: what a user acquired is not recommended again."""
    return V.decisions_held(spark, sf).select("event_id", "user_id", "regime", "prediction", A.joined(F.col("recs")).alias("recs"), "is_active", "is_unknown")


@query("recs_stored", with_views("decisions", f"""select user_id, event_id, prediction, array_to_string(recs, ',') as recs, cast(ts + interval 1 hour as varchar) as expires_at
    from (select * from decisions qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where ts + interval 1 hour > timestamp '{NOW}'"""))
def recs_stored(spark, sf):
    """Two batches of decisions through the keyed table, compacted, read where they have not expired."""
    table = recs_table(f"{checkpoint_root(spark)}/recs/{uuid.uuid4().hex}", 8)
    d = staged(V.decisions(spark, sf))
    split = F.lit("2024-01-15").cast("timestamp_ntz")
    table.write(recommendations(d.where(F.col("ts") < split)), 0)
    table.write(recommendations(d.where(F.col("ts") >= split)), 1)
    table.compact(spark, above=1)
    out = current(table.read(spark), F.lit(NOW).cast("timestamp"))
    return out.select("user_id", "event_id", "prediction", A.joined(F.col("recs")).alias("recs"), F.col("expires_at").cast("string").alias("expires_at"))


TAIL = 1000


@query("stream_telemetry", with_views("decisions", f"""with_tail as (select * from decisions order by ts desc, event_id desc limit {TAIL})
    select (select count(*) from with_tail) as n_events, (select count(*) from decisions) as total_events,
      (select round(quantile_cont(latency_ms, 0.5), 6) from with_tail) as p50, (select round(quantile_cont(latency_ms, 0.95), 6) from with_tail) as p95,
      (select round(avg(cast(is_active as int)) * 100, 6) from with_tail) as active_pct, (select round(100 - avg(cast(is_active as int)) * 100, 6) from with_tail) as silent_pct,
      (select string_agg(v || ':' || n, ',' order by n desc, v) from (select action as v, count(*) as n from with_tail group by 1)) as action_mix,
      (select string_agg(v || ':' || n, ',' order by n desc, v) from (select regime as v, count(*) as n from with_tail group by 1)) as regime_mix""").replace(")\nwith_tail", "),\nwith_tail"))
def stream_telemetry(spark, sf):
    """The newest thousand decisions: latency percentiles, share of live ones, mixes."""
    d = staged(V.decisions(spark, sf).select(*NEEDED))
    return rounded(telemetry_of(last_decisions(d, TAIL), F.lit(d.count())))


@query("sessions", f"""with e as (select user_id, ts, {V.CLAIM_SQL} as item, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end as apart from events),
    s as (select *, sum(apart) over (partition by user_id order by ts rows unbounded preceding) as session from e)
    select user_id, cast(min(ts) as varchar) as session_start, cast(max(ts) as varchar) as session_end, count(*) as n_events, count(item) as n_acquired from s group by user_id, session""")
def activity_sessions(spark, sf):
    """Sessions of each user: events at most six hours apart."""
    out = sessions(V.claims(spark, sf), 6 * 3600)
    return out.select("user_id", *[F.col(c).cast("string").alias(c) for c in ("session_start", "session_end")], "n_events", "n_acquired")


@query("daily_telemetry", with_views("decisions", """select cast(cast(ts as date) as varchar) as day, count(*) as n, count(*) filter (is_active) as n_active,
    round(avg(latency_ms), 6) as mean_latency from decisions group by 1"""))
def daily_telemetry(spark, sf):
    return rounded(V.decisions(spark, sf).groupBy(F.to_date("ts").alias("day")).agg(*telemetry_columns()))


@query("audit_trail", with_views("decisions", """select event_id, cast(user_id as varchar) as customer, case action when 'purchase' then 'Bought' when 'view' then 'Looked' else action end as activity,
    case regime when 'stage1_cpu_hold' then 'Propensity hold' when 'stage2_gate1c_hold' then 'Odds hold' when 'candidate_a_silent_cache' then 'Silent' else 'Live' end as regime_label,
    printf('%.3f', p_buy) as p_buy, printf('%.2f', odds_ratio) || 'x' as odds, case when skipped then 'skipped' else 'scored' end as scoring from decisions"""))
def audit_trail(spark, sf):
    labels = {"stage1_cpu_hold": "Propensity hold", "stage2_gate1c_hold": "Odds hold", "candidate_a_silent_cache": "Silent"}
    names = spark.createDataFrame([("purchase", "Bought"), ("view", "Looked")], "action string, label string")
    from panelrec.operators.scale import join_lookup

    d = join_lookup(V.decisions(spark, sf), names, ["action"])
    return d.select(
        "event_id", F.col("user_id").cast("string").alias("customer"), F.coalesce("label", "action").alias("activity"),
        S.recoded(F.col("regime"), labels, "Live").alias("regime_label"), F.format_string("%.3f", "p_buy").alias("p_buy"),
        F.concat(F.format_string("%.2f", "odds_ratio"), F.lit("x")).alias("odds"),
        F.when(F.col("skipped"), "skipped").otherwise("scored").alias("scoring"))
