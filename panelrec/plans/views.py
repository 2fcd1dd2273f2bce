"""Views that give the benchmark tables the shapes the operators work on.

Each view exists twice: as a DataFrame and as SQL text for the comparison engine.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelrec.config import PanelSpec
from panelrec.functions import arrays as A
from panelrec.functions import scalars as S

ITEMS = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
RELEVANCE = {"purchase": (1, 3, 9), "view": (2, 4), "signup": (5, 8, 11), "error": (6,), "click": ()}
CLASS_NAMES = tuple(["hold"] + [f"item_{i}" for i in range(1, 16)])

UD_SPEC = PanelSpec(
    entity="user_id", time="d", targets=ITEMS, lag2=ITEMS, deltas=("click", "purchase", "view"),
    bundles={
        "browse_bundle_lag1": ("click", "view", "error"),
        "growth_bundle_lag1": ("signup", "purchase", "click"),
    },
    eligibility={"buy_eligible": ("signup", "purchase"), "view_eligible": ("click", "view")},
    activity="click",
    drop=("amt",),
)
CM_ITEMS = ("p1", "p2", "p3", "p4", "p5")
CM_SPEC = PanelSpec(
    entity="c_custkey", time="m", targets=CM_ITEMS, lag2=CM_ITEMS, deltas=CM_ITEMS,
    bundles={"rush_bundle_lag1": ("p1", "p2", "p3"), "slow_bundle_lag1": ("p3", "p4", "p5")},
    eligibility={"rush_eligible": ("p1", "p2")},
    activity="p5", amount="income_pos", group="province", joined="join_date",
    drop=("total", "seg", "income", "income_pos", "join_date"),
)

#: Batches of the store are open-ended.
FIRST_DAY, LAST_DAY = "0001-01-01", "9999-12-31"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{table}.parquet"))


# --------------------------------------------------------------- user by day

def panel_ud(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day: which event kinds occurred, and the value sum."""
    flags = [F.max(F.when(F.col("event_type") == i, 1).otherwise(0)).alias(i) for i in ITEMS]
    return read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        *flags, F.sum("value").alias("amt")
    )


def pool_ud(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling pool: row key, first-acquired class, recency, coldness and activity."""
    from panelrec.operators.panel import added_classes, with_lags

    table = with_lags(panel_ud(spark, sf), UD_SPEC)
    newest = table.agg(F.max("d")).first()[0]
    return table.select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("rid"),
        "user_id", "d",
        A.first_or(added_classes(UD_SPEC), F.lit(0)).alias("cls"),
        F.when(F.col("d") >= F.date_sub(F.lit(newest), 10), 1).otherwise(0).alias("is_recent"),
        F.when(F.col("prev_snapshot").isNull(), 1).otherwise(0).alias("is_cold"),
        F.col("click").alias("is_active"),
        "amt",
    ).withColumn("is_buyer", F.when(F.col("cls") > 0, 1).otherwise(0))


# ---------------------------------------------------------- customer by month

def panel_cm(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer and month: order priorities seen, total, customer facts."""
    flags = [
        F.max(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)).alias(c)
        for c, p in zip(CM_ITEMS, PRIORITIES)
    ]
    monthly = read(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "MM").alias("m")
    ).agg(*flags, F.sum("o_totalprice").alias("total"), F.min(F.to_date("o_orderdate")).alias("first_day"))
    # A customer has at most one row per month, so this window stays small per key.
    first = F.min("first_day").over(Window.partitionBy("c_custkey"))
    monthly = monthly.withColumn("join_date", first)
    facts = read(spark, sf, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("province"),
        F.col("c_acctbal").alias("income"),
    )
    return (
        monthly.join(facts, "c_custkey")
        .select("c_custkey", "m", *CM_ITEMS, "total", "seg", "province", "income", "join_date",
                F.greatest("income", F.lit(0.0)).alias("income_pos"))
    )


def raw_cm(spark: SparkSession, sf: str) -> DataFrame:
    """``panel_cm`` as untidy text: null tokens, padding, letters for flags, bad dates."""
    p = panel_cm(spark, sf)
    text = {c: F.col(c).cast("string") for c in ("c_custkey", "m", *CM_ITEMS, "province")}
    return p.select(
        *[v.alias(c) for c, v in text.items()],
        F.when(F.col("income") < 0, "NA").otherwise(
            F.concat(F.lit("  "), F.format_string("%.2f", "income"), F.lit(" "))
        ).alias("income"),
        F.when(F.col("seg") == "MACHINERY", "nan").otherwise(F.col("seg")).alias("seg"),
        F.when(F.col("p1") == 1, "H").when(F.col("p2") == 1, "V").otherwise("NA").alias("gender"),
        (F.col("province") - 3).cast("string").alias("seniority"),
        F.when(F.col("p3") == 1, "1.0").when(F.col("p4") == 1, "1").otherwise("").alias("kind"),
        F.when(F.col("p5") == 1, "s").otherwise("N").alias("resident"),
        F.when(F.col("income") < 0, "not a date").otherwise(F.col("join_date").cast("string")).alias("join_date"),
    )


# --------------------------------------------------------------------- scores

def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen-class probabilities of two models, propensity, held and true classes."""
    e = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("e"), "label"
    )

    def logits(start: int):
        return F.transform(F.slice("e", start, 16), lambda x: x * 10.0)

    held = F.filter(
        F.transform(F.slice("e", 18, 15), lambda x, i: F.when(x > 0.12, (i + 1).cast("int"))),
        lambda c: c.isNotNull(),
    )
    base = e.select(
        "row_id", "label",
        logits(1).alias("logits"), logits(41).alias("logits2"),
        A.softmax(logits(1)).alias("probs"), A.softmax(logits(41)).alias("probs2"),
        (1.0 / (1.0 + F.exp(F.get("e", F.lit(16)) * -10.0))).alias("p_buy"),
        held.alias("held"), (F.get("e", F.lit(39)) < 0).alias("is_cold"),
        (F.get("e", F.lit(63)) > 0.05).alias("_easy"),
    )
    y = F.when(F.col("_easy"), A.argmax(F.col("probs"))).otherwise(F.col("label"))
    return base.withColumn("y", y).withColumn(
        "actual", F.when(F.col("y") > 0, F.array("y")).otherwise(F.array().cast("array<int>"))
    ).drop("_easy")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def actions(spark: SparkSession, sf: str, ranked: bool = False) -> DataFrame:
    """Events with the score row of their user, optionally with its candidates.

    Users without one keep their events: they are scored as a zero vector, hold nothing, have no truth and are flagged.
    """
    from panelrec.operators.decide import CANDIDATE_COLUMNS, with_candidates
    from panelrec.operators.scale import join_lookup

    ev = read(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("row_id"), F.col("event_type").alias("action"),
        F.col("value").alias("latency_ms"),
    )
    facts = with_candidates(scores(spark, sf)) if ranked else scores(spark, sf)
    kept = ["row_id", "y", "actual", "probs", "p_buy", "held", "is_cold"]
    facts = facts.select(*kept, *(CANDIDATE_COLUMNS if ranked else ()))
    out = join_lookup(ev, facts.withColumn("_known", F.lit(True)), ["row_id"])
    unknown = _zero_scores()
    return out.select(
        *ev.columns[:2], F.col("row_id").alias("user_id"), *ev.columns[3:],
        *[F.coalesce(F.col(c), unknown[c].cast(facts.schema[c].dataType)).alias(c) for c in facts.columns[1:]],
        F.col("_known").isNull().alias("is_unknown"))


def _zero_scores() -> dict[str, Column]:
    """The score row, and its candidates, of a vector of zeros: every class alike."""
    none, p = F.array(), F.lit(1.0 / 16)
    return {
        "y": F.lit(None), "actual": none, "probs": F.array_repeat(p, 16), "p_buy": F.lit(0.5), "held": none, "is_cold": F.lit(False),
        "ranked": F.array(*map(F.lit, range(1, 16))), "cand": F.lit(1), "p0": p, "p_top": p, "p_second": p,
        "base_recs": F.array(*map(F.lit, range(1, 8))), "odds": S.odds(p, p, "add"),
    }


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event routed; ranking happens per user, before events join."""
    from panelrec.operators.decide import route

    return route(actions(spark, sf, ranked=True), RELEVANCE)


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the decision stream sees them: ``item`` is set where one acquires an item."""
    code = F.lit(None).cast("int")
    for n, i in enumerate(ITEMS, 1):
        if i in CLAIMS:
            code = F.when(F.col("event_type") == i, n).otherwise(code)
    return read(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("action"), code.alias("item"))


def decisions_held(spark: SparkSession, sf: str) -> DataFrame:
    """Every event routed with the items its user had acquired before it held too."""
    from panelrec.operators.decide import route
    from panelrec.operators.scale import join_lookup
    from panelrec.operators.store import held_before

    got = held_before(claims(spark, sf), "user_id", "item", ["ts", "event_id"]).select("event_id", F.col("held").alias("_got"))
    both = join_lookup(actions(spark, sf), got, ["event_id"])
    return route(both.withColumn("held", A.ordered_union(F.col("held"), F.col("_got"))).drop("_got"), RELEVANCE)


# -------------------------------------------------------------- feature store

def day_vectors(spark: SparkSession, sf: str, first: str, last: str) -> DataFrame:
    """Newest user-day of each user within a date range, as a feature row."""
    from panelrec.operators.scale import newest

    rows = panel_ud(spark, sf).where(F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    rows = newest(rows, ["user_id"], ["d"])
    return rows.select(
        "user_id", A.assemble([F.col(i) for i in ITEMS]).alias("vector"),
        A.flagged([(F.col(i), F.lit(n)) for n, i in enumerate(ITEMS, 1)]).alias("held"),
        F.col("d").alias("updated_at"),
    )


def store_first(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen up to the first day of the benchmark's log."""
    return day_vectors(spark, sf, FIRST_DAY, "2024-01-01")


def store_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Users seen after the first day: the update batch."""
    return day_vectors(spark, sf, "2024-01-02", LAST_DAY)


def store_all(spark: SparkSession, sf: str) -> DataFrame:
    return day_vectors(spark, sf, FIRST_DAY, LAST_DAY)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Metric results: part averages per type, brand and size fold."""
    return (
        read(spark, sf, "part")
        .groupBy(F.col("p_type").alias("suite"), F.col("p_brand").alias("name"), F.pmod("p_size", F.lit(5)).alias("fold"))
        .agg((F.sum(F.col("p_retailprice").cast("decimal(15,2)")).cast("double") / F.count("p_retailprice") / 2000.0).alias("metric"))
    )


# ------------------------------------------------------------------ SQL twins

_flag = ", ".join(f"max(case when event_type = '{i}' then 1 else 0 end) as {i}" for i in ITEMS)
_cmflag = ", ".join(
    f"max(case when o_orderpriority = '{p}' then 1 else 0 end) as {c}" for c, p in zip(CM_ITEMS, PRIORITIES)
)


def lag_sql(items: tuple[str, ...], entity: str, time: str, twice: tuple[str, ...] = ()) -> str:
    w = f"over (partition by {entity} order by {time})"
    parts = [f"coalesce(lag({i}) {w}, 0) as has_{i}_lag1" for i in items]
    parts += [f"coalesce(lag({i}, 2) {w}, 0) as has_{i}_lag2" for i in twice]
    return ", ".join([*parts, f"lag({time}) {w} as prev_snapshot"])


def added_sql(items: tuple[str, ...], named: bool = False) -> str:
    cells = ", ".join(
        f"case when {i} = 1 and has_{i}_lag1 = 0 then {repr(i) if named else n} end" for n, i in enumerate(items, 1)
    )
    return f"list_filter([{cells}], lambda x: x is not null)"


def softmax_sql(z: str) -> str:
    e = f"list_transform({z}, lambda x: exp(x - list_max({z})))"
    return f"list_transform({e}, lambda x: x / list_sum({e}))"


def ranked_sql(p: str) -> str:
    pairs = f"list_transform(range(1, 16), lambda c: {{'n': -{p}[c + 1], 'c': cast(c as integer)}})"
    return f"list_transform(list_sort({pairs}), lambda s: s.c)"


def unheld_sql(ranked: str, held: str = "held", k: int = 7) -> str:
    return f"(list_filter({ranked}, lambda c: not list_contains({held}, c)))[1:{k}]"


def relevance_sql(action: str, item: str) -> str:
    tests = " ".join(
        f"when {action} = '{a}' then {item} in ({', '.join(map(str, items))})" for a, items in RELEVANCE.items() if items
    )
    return f"coalesce(case {tests} else false end, false)"


def _day_sql(first: str, last: str) -> str:
    vec = ", ".join(f"cast({i} as double)" for i in ITEMS)
    held = ", ".join(f"case when {i} > 0 then {n} end" for n, i in enumerate(ITEMS, 1))
    return f"""select user_id, [{vec}] as vector, list_filter([{held}], lambda x: x is not null) as held,
        d as updated_at from panel_ud where d between date '{first}' and date '{last}'
        qualify row_number() over (partition by user_id order by d desc) = 1"""


#: Event kinds that acquire the item of their number.
CLAIMS = ("purchase", "signup", "view")
CLAIM_SQL = "case event_type " + " ".join(f"when '{i}' then {n}" for n, i in enumerate(ITEMS, 1) if i in CLAIMS) + " end"

DECISIONS_SQL = f"""select *, case when regime in ('stage1_cpu_hold', 'stage2_gate1c_hold') then 0
          else choice end as prediction, case when skipped then [] else base end as recs,
        case when skipped then 0.0 else ratio end as odds_ratio, regime = 'candidate_c_live_push' as is_active
        from (select *, case when skipped then 'stage1_cpu_hold' when ratio <= theta then 'stage2_gate1c_hold'
          when p_buy >= 0.3 and {relevance_sql('action', 'choice')} then 'candidate_c_live_push'
          else 'candidate_a_silent_cache' end as regime
        from (select *, p_buy < 0.2 as skipped, coalesce(base[1], cand) as choice,
          case when cand in (1, 7, 9, 14, 15) then 6.0 else 1.8 end as theta
        from (select *, ({ranked_sql('probs')})[1] as cand, {unheld_sql(ranked_sql('probs'))} as base,
          list_max(probs[2:16]) / greatest(probs[1], 1e-8) as ratio from SOURCE)))"""

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "panel_ud": ((), f"select user_id, cast(ts as date) as d, {_flag}, sum(value) as amt from events group by 1, 2"),
    "lags_ud": (("panel_ud",), f"""select *, {lag_sql(ITEMS, 'user_id', 'd', ITEMS)},
        coalesce(lag(click) over (partition by user_id order by d), 0) as click_lag1,
        coalesce(lag(click, 2) over (partition by user_id order by d), 0) as click_lag2 from panel_ud"""),
    "labels_ud": (("lags_ud",), f"""select *, {added_sql(ITEMS)} as added, {added_sql(ITEMS, True)} as added_names
        from lags_ud"""),
    "pool_ud": (("labels_ud",), """select cast(user_id as varchar) || '|' || cast(d as varchar) as rid, user_id, d,
        coalesce(added[1], 0) as cls,
        case when d >= (select max(d) from labels_ud) - 10 then 1 else 0 end as is_recent,
        case when prev_snapshot is null then 1 else 0 end as is_cold, click as is_active, amt,
        case when len(added) > 0 then 1 else 0 end as is_buyer from labels_ud"""),
    "panel_cm": ((), f"""select o.c_custkey, o.m, {', '.join(CM_ITEMS)}, total, c_mktsegment as seg,
        c_nationkey as province, c_acctbal as income,
        min(first_day) over (partition by o.c_custkey) as join_date, greatest(c_acctbal, 0) as income_pos
        from (select o_custkey as c_custkey, cast(date_trunc('month', o_orderdate) as date) as m, {_cmflag},
              sum(o_totalprice) as total, min(cast(o_orderdate as date)) as first_day from orders group by 1, 2) o
        join customer c on c.c_custkey = o.c_custkey"""),
    "lags_cm": (("panel_cm",), f"""select *, {lag_sql(CM_ITEMS, 'c_custkey', 'm', CM_ITEMS)},
        coalesce(lag(p5) over (partition by c_custkey order by m), 0) as p5_lag1,
        coalesce(lag(p5, 2) over (partition by c_custkey order by m), 0) as p5_lag2 from panel_cm"""),
    "labels_cm": (("lags_cm",), f"select *, {added_sql(CM_ITEMS)} as added from lags_cm"),
    "medians_cm": (("panel_cm",), "select province, median(income_pos) as med from panel_cm group by 1"),
    "raw_cm": (("panel_cm",), f"""select cast(c_custkey as varchar) as c_custkey, cast(m as varchar) as m,
        {', '.join(f'cast({c} as varchar) as {c}' for c in CM_ITEMS)}, cast(province as varchar) as province,
        case when income < 0 then 'NA' else '  ' || printf('%.2f', income) || ' ' end as income,
        case when seg = 'MACHINERY' then 'nan' else seg end as seg,
        case when p1 = 1 then 'H' when p2 = 1 then 'V' else 'NA' end as gender,
        cast(province - 3 as varchar) as seniority,
        case when p3 = 1 then '1.0' when p4 = 1 then '1' else '' end as kind,
        case when p5 = 1 then 's' else 'N' end as resident,
        case when income < 0 then 'not a date' else cast(join_date as varchar) end as join_date from panel_cm"""),
    "emb": ((), "select vec_id as row_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings"),
    "logit": (("emb",), """select row_id, label, e, list_transform(e[1:16], lambda x: x * 10.0) as logits,
        list_transform(e[41:56], lambda x: x * 10.0) as logits2 from emb"""),
    "expz": (("logit",), """select *, list_transform(logits, lambda x: exp(x - list_max(logits))) as ez,
        list_transform(logits2, lambda x: exp(x - list_max(logits2))) as ez2 from logit"""),
    "prob": (("expz",), """select *, list_transform(ez, lambda x: x / list_sum(ez)) as probs,
        list_transform(ez2, lambda x: x / list_sum(ez2)) as probs2 from expz"""),
    "scores": (("prob",), """select *, case when y > 0 then [y] else [] end as actual from (
        select row_id, label, logits, logits2, probs, probs2, 1.0 / (1.0 + exp(e[17] * -10.0)) as p_buy,
        list_transform(list_filter(range(1, 16), lambda k: e[17 + k] > 0.12), lambda k: cast(k as integer)) as held,
        e[40] < 0 as is_cold,
        case when e[64] > 0.05 then cast(list_position(probs, list_max(probs)) - 1 as integer) else label end as y
        from prob)"""),
    "cands": (("scores",), f"""select *, {ranked_sql('probs')} as ranked, ({ranked_sql('probs')})[1] as cand,
        probs[1] as p0, list_max(probs[2:16]) as p_top, (list_reverse_sort(probs[2:16]))[2] as p_second,
        {unheld_sql(ranked_sql('probs'))} as base_recs, list_max(probs[2:16]) / (probs[1] + 1e-9) as odds
        from scores"""),
    "actions": (("scores",), """select event_id, ts, user_id, event_type as action, value as latency_ms, y, coalesce(actual, []) as actual,
        coalesce(probs, list_transform(range(16), lambda i: cast(0.0625 as double))) as probs, coalesce(p_buy, 0.5) as p_buy,
        coalesce(held, []) as held, coalesce(is_cold, false) as is_cold, row_id is null as is_unknown
        from events left join scores on row_id = user_id"""),
    "decisions": (("actions",), DECISIONS_SQL.replace("SOURCE", "actions")),
    "claims": ((), f"select event_id, ts, user_id, {CLAIM_SQL} as item from events"),
    "actions_held": (("actions", "claims"), """select a.* replace (list_concat(held, coalesce(list_filter(got, lambda c: not list_contains(held, c)), [])) as held)
        from actions a left join (select e.event_id, list(f.item order by f.item) as got from claims e
          join (select user_id, item, min((ts, event_id)) as first from claims where item is not null group by 1, 2) f
            on f.user_id = e.user_id and f.first < (e.ts, e.event_id) group by 1) using (event_id)"""),
    "decisions_held": (("actions_held",), DECISIONS_SQL.replace("SOURCE", "actions_held")),
    "store_first": (("panel_ud",), _day_sql(FIRST_DAY, "2024-01-01")),
    "store_batch": (("panel_ud",), _day_sql("2024-01-02", LAST_DAY)),
    "store_all": (("panel_ud",), _day_sql(FIRST_DAY, LAST_DAY)),
    "results": ((), """select p_type as suite, p_brand as name, p_size % 5 as fold,
        cast(sum(cast(p_retailprice as decimal(15,2))) as double) / count(p_retailprice) / 2000.0 as metric
        from part group by 1, 2, 3"""),
}


def with_views(names: str | tuple[str, ...], body: str) -> str:
    """``body`` preceded by the named views and everything they stand on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEW_SQL[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split() if isinstance(names, str) else names:
        visit(name)
    ctes = ",\n".join(f"{n} as materialized ({VIEW_SQL[n][1]})" for n in order)
    return f"with {ctes}\n{body}"


def r6(expr: str) -> str:
    """Six decimals without a negative zero."""
    return f"round({expr}, 6) + 0.0"
