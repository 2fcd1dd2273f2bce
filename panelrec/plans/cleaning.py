"""Queries: sources, projections, cleaning and filters."""

from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.functions import scalars as S
from panelrec.operators import clean as K
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import CM_ITEMS, ITEMS, r6, with_views
from panelrec.session import staged
from panelrec.sources import tables as T

DAY_CUT = "2024-01-20"
_clean = {c: f"case when trim({c}) not in ('NA', '', 'nan', 'NULL') then trim({c}) end" for c in (
    "income", "seg", "gender", "kind", "join_date", "seniority", "resident")}


@query("scan_parquet", "select user_id, count(*) as n, round(sum(value), 6) as total from events group by 1")
def scan_parquet(spark, sf):
    events = T.scan_parquet(spark, f"{sf}/events.parquet")
    return rounded(events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("rename_columns", with_views("panel_cm", """select c_custkey as customer_id, cast(m as varchar) as snapshot_date,
    province as province_code, seg as customer_segment from panel_cm"""))
def rename_columns(spark, sf):
    names = {"c_custkey": "customer_id", "m": "snapshot_date", "province": "province_code", "seg": "customer_segment"}
    return rounded(V.panel_cm(spark, sf).withColumnsRenamed(names).select(*names.values()))


@query("leakage_guard", with_views("panel_cm", f"select c_custkey, cast(m as varchar) as m, seg, province, {r6('income')} as income from panel_cm"))
def leakage_guard(spark, sf):
    return rounded(K.drop_columns(V.panel_cm(spark, sf), [*CM_ITEMS, "total", "join_date", "income_pos"]))


@query("feature_columns", with_views("panel_ud", f"select {', '.join(ITEMS)}, {r6('amt')} as amt from panel_ud"))
def feature_columns(spark, sf):
    panel = V.panel_ud(spark, sf)
    return rounded(panel.select(*K.feature_columns(panel, ("user_id", "d"))))


@query("clean_null_tokens", with_views("raw_cm", "select c_custkey, m, " + ", ".join(
    f"{_clean[c]} as {c}" for c in ("income", "seg", "gender", "kind")) + " from raw_cm"))
def clean_null_tokens(spark, sf):
    return K.clean_tokens(V.raw_cm(spark, sf).select("c_custkey", "m", "income", "seg", "gender", "kind"))


@query("clean_safe_cast", with_views("raw_cm", f"""select c_custkey, m, try_cast({_clean['income']} as double) as income,
    try_cast({_clean['seniority']} as integer) as seniority, try_cast({_clean['gender']} as integer) as gender_num from raw_cm"""))
def clean_safe_cast(spark, sf):
    t = K.clean_tokens(V.raw_cm(spark, sf))
    return t.select(
        "c_custkey", "m", S.safe_double(F.col("income")).alias("income"),
        S.safe_int(F.col("seniority")).alias("seniority"), S.safe_int(F.col("gender")).alias("gender_num"),
    )


@query("clean_dates", with_views("raw_cm", f"""select c_custkey, m,
    cast(try_cast({_clean['join_date']} as date) as varchar) as join_date from raw_cm"""))
def clean_dates(spark, sf):
    t = K.clean_tokens(V.raw_cm(spark, sf))
    return rounded(t.select("c_custkey", "m", S.safe_date(F.col("join_date")).alias("join_date")))


@query("clean_recode", with_views("raw_cm", """select c_custkey, m,
    case gender when 'H' then 'F' when 'V' then 'M' else 'Unknown' end as gender from raw_cm"""))
def clean_recode(spark, sf):
    return V.raw_cm(spark, sf).select(
        "c_custkey", "m", S.recoded(F.col("gender"), {"H": "F", "V": "M"}, "Unknown").alias("gender")
    )


@query("clean_clamp", with_views("raw_cm", """select c_custkey, m,
    greatest(coalesce(try_cast(seniority as integer), 0), 0) as seniority from raw_cm"""))
def clean_clamp(spark, sf):
    return V.raw_cm(spark, sf).select("c_custkey", "m", S.floor_zero(F.col("seniority")).alias("seniority"))


@query("clean_regex_default", with_views("raw_cm", f"""select c_custkey, m,
    coalesce(regexp_replace({_clean['kind']}, '\\.0$', ''), 'UNKNOWN') as kind from raw_cm"""))
def clean_regex_default(spark, sf):
    t = K.clean_tokens(V.raw_cm(spark, sf))
    return t.select("c_custkey", "m", S.code_text(F.col("kind"), "UNKNOWN").alias("kind"))


@query("clean_flags", with_views("raw_cm", """select c_custkey, m,
    case when upper(resident) = 'S' then 1 else 0 end as resident from raw_cm"""))
def clean_flags(spark, sf):
    return V.raw_cm(spark, sf).select("c_custkey", "m", S.yes_flag(F.col("resident")).cast("int").alias("resident"))


@query("clean_product_flags", with_views("raw_cm", "select c_custkey, m, " + ", ".join(
    f"coalesce(try_cast({c} as integer), 0) as {c}" for c in CM_ITEMS) + ", coalesce(try_cast(gender as integer), 0) as gender from raw_cm"))
def clean_product_flags(spark, sf):
    return V.raw_cm(spark, sf).select(
        "c_custkey", "m", *[S.flag_or_zero(F.col(c)).alias(c) for c in (*CM_ITEMS, "gender")]
    )


@query("filter_not_null", with_views("raw_cm", """select c_custkey, m, cast(try_cast(join_date as date) as varchar) as join_date
    from raw_cm where try_cast(join_date as date) is not null"""))
def filter_not_null(spark, sf):
    t = V.raw_cm(spark, sf).select("c_custkey", "m", S.safe_date(F.col("join_date")).alias("join_date"))
    return rounded(t.where(F.col("join_date").isNotNull()))


@query("impute_group_median", with_views("raw_cm", f"""
    , t as (select c_custkey, m, province, try_cast({_clean['income']} as double) as income from raw_cm),
    g as (select province, median(income) as med from t group by 1)
    select c_custkey, m, t.province, {r6('coalesce(income, med, (select median(income) from t))')} as income
    from t left join g on t.province is not distinct from g.province""").replace(")\n\n    , t as", "),\n t as", 1))
def impute_group_median(spark, sf):
    t = K.clean_tokens(V.raw_cm(spark, sf)).select(
        "c_custkey", "m", "province", S.safe_double(F.col("income")).alias("income")
    )
    return rounded(K.impute_by_group(staged(t), "income", "province"))


@query("temporal_split", with_views("panel_ud", f"""select case when d < date '{DAY_CUT}' then 'train' else 'holdout' end as part,
    count(*) as n, round(sum(amt), 4) + 0.0 as total from panel_ud where d <= date '{DAY_CUT}' group by 1"""))
def temporal_split(spark, sf):
    train, holdout = K.temporal_split(V.panel_ud(spark, sf), "d", DAY_CUT)
    both = train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amt"), 4).alias("total"))


@query("filter_dates", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, {r6('amt')} as amt from panel_ud
    where d in (date '2024-01-08', date '2024-01-15', date '2024-01-22')"""))
def filter_dates(spark, sf):
    days = ["2024-01-08", "2024-01-15", "2024-01-22"]
    return rounded(V.panel_ud(spark, sf).where(F.col("d").isin(*[F.lit(x).cast("date") for x in days])).select("user_id", "d", "amt"))


@query("cap_categories", with_views("panel_cm", """
    select c_custkey, cast(m as varchar) as m,
    case when seg in (select seg from panel_cm group by 1 order by count(*) desc, seg limit 3) then seg else 'OTHER' end as seg,
    case when cast(province as varchar) in (select cast(province as varchar) from panel_cm group by 1
        order by count(*) desc, cast(province as varchar) limit 10) then cast(province as varchar) else 'OTHER' end as province
    from panel_cm"""))
def cap_categories(spark, sf):
    t = V.panel_cm(spark, sf).select("c_custkey", F.col("m").cast("string").alias("m"), "seg", F.col("province").cast("string").alias("province"))
    tops = {"seg": K.top_categories(t, "seg", 3), "province": K.top_categories(t, "province", 10)}
    return K.cap_categories(t, tops, fill=())


@query("point_lookup", with_views("panel_ud", f"select user_id, cast(d as varchar) as d, {', '.join(ITEMS)}, {r6('amt')} as amt from panel_ud where user_id = 7"))
def point_lookup(spark, sf):
    return rounded(K.point_lookup(V.panel_ud(spark, sf), "user_id", 7))


@query("last_n_history", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, {r6('amt')} as amt from panel_ud
    qualify row_number() over (partition by user_id order by d desc) <= 3"""))
def last_n_history(spark, sf):
    return rounded(K.last_n_history(V.panel_ud(spark, sf), "user_id", "d", 3).select("user_id", "d", "amt"))


@query("latest_snapshot", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, {', '.join(ITEMS)}, {r6('amt')} as amt
    from panel_ud qualify d = max(d) over (partition by user_id)"""))
def latest_snapshot(spark, sf):
    return rounded(K.latest_snapshot(V.panel_ud(spark, sf), "user_id", "d"))


@query("drop_first_snapshot", with_views("panel_ud", f"""select user_id, cast(d as varchar) as d, {r6('amt')} as amt from panel_ud
    qualify lag(d) over (partition by user_id order by d) is not null"""))
def drop_first_snapshot(spark, sf):
    return rounded(K.drop_first_snapshot(V.panel_ud(spark, sf), "user_id", "d").select("user_id", "d", "amt"))


@query("class_limit", with_views("pool_ud", "select rid, cls from pool_ud where cls = 3 order by rid limit 10"))
def class_limit(spark, sf):
    return K.class_limit(V.pool_ud(spark, sf), "cls", 3, 10, ["rid"]).select("rid", "cls")


@query("top_categories", with_views("panel_cm", "select seg, count(*) as n from panel_cm where seg is not null group by 1 order by n desc, seg limit 3"))
def top_categories(spark, sf):
    return K.top_categories(V.panel_cm(spark, sf), "seg", 3)


@query("stream_tail", "select event_id, user_id, event_type from events order by ts desc, event_id desc limit 25")
def stream_tail(spark, sf):
    return T.stream_tail(V.read(spark, sf, "events"), 25, "ts", "event_id").select("event_id", "user_id", "event_type")
