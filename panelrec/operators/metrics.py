"""Ranking, calibration, drift, diversity and classification metrics.

Row-level scores are array expressions; a metric is then one aggregation whose
partial sums combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelrec.functions import arrays as A
from panelrec.functions import ranking as R
from panelrec.operators.scale import bounded_table, group_quantiles, join_lookup, running_totals


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def mean_of(value: Column) -> Column:
    return or_zero(F.avg(value))


def pct_of(flag: Column, among: Column | None = None) -> Column:
    hit = flag.cast("int")
    return or_zero(F.avg(hit if among is None else F.when(among, hit)) * 100.0)


# ------------------------------------------------------------------- ranking

def with_row_scores(df: DataFrame, recs: str, actual: str, k: int, prefix: str = "") -> DataFrame:
    """Add AP, NDCG, reciprocal rank, recall and hit of each row; null without truth."""
    r, a = F.col(recs), F.col(actual)
    return df.select(
        "*",
        R.average_precision(r, a, k).alias(f"{prefix}ap"),
        R.discounted_gain(r, a, k).alias(f"{prefix}ndcg"),
        R.reciprocal_rank(r, a, k).alias(f"{prefix}rr"),
        R.recall(r, a, k).alias(f"{prefix}recall"),
        R.hit(r, a, k).alias(f"{prefix}hit"),
    )


def map_at_k(df: DataFrame, recs: str, actual: str, ks: Sequence[int]) -> DataFrame:
    return df.agg(
        *[mean_of(R.average_precision(F.col(recs), F.col(actual), k)).alias(f"map_{k}") for k in ks]
    )


def ndcg_at_k(df: DataFrame, recs: str, actual: str, ks: Sequence[int]) -> DataFrame:
    return df.agg(
        *[mean_of(R.discounted_gain(F.col(recs), F.col(actual), k)).alias(f"ndcg_{k}") for k in ks]
    )


def mrr(df: DataFrame, recs: str, actual: str, k: int = 7) -> DataFrame:
    return df.agg(mean_of(R.reciprocal_rank(F.col(recs), F.col(actual), k)).alias("mrr"))


def recall_hit_at_k(df: DataFrame, recs: str, actual: str, ks: Sequence[int]) -> DataFrame:
    out = []
    for k in ks:
        out += [
            mean_of(R.recall(F.col(recs), F.col(actual), k)).alias(f"recall_{k}"),
            mean_of(R.hit(F.col(recs), F.col(actual), k)).alias(f"hit_{k}"),
        ]
    return df.agg(*out)


def customer_eval(df: DataFrame, recs: str, actual: str) -> DataFrame:
    """Per-row precision, recall and AP over min(actual, recommended).

    An empty truth counts as recall 1, and AP 1 only when nothing is recommended.
    """
    r, a = F.col(recs), F.col(actual)
    n_recs, n_true = F.size(r), F.size(a)
    hits = F.size(F.filter(r, lambda c: F.array_contains(a, c)))
    ap = R.precision_sum(r, a, 1_000_000) / F.least(n_true, n_recs)
    return df.select(
        "*",
        hits.alias("hits"),
        F.when((n_true > 0) & (n_recs > 0), F.round(hits / n_recs, 4)).otherwise(0.0).alias("precision"),
        F.when(n_true > 0, F.round(hits / n_true, 4)).otherwise(1.0).alias("recall"),
        F.when(n_true == 0, F.when(n_recs == 0, 1.0).otherwise(0.0))
        .when(n_recs == 0, 0.0)
        .otherwise(F.round(ap, 4))
        .alias("average_precision"),
    )


def catalog_gini(df: DataFrame, recs: str, catalog: Sequence[int]) -> DataFrame:
    """Gini of recommendation counts over the catalog, unrecommended items included.

    Counts are summed per item in one pass; the sorted list is as long as the catalog.
    """
    items = F.array(*[F.lit(c) for c in catalog])
    zeros = F.array(*[F.struct(F.lit(c).alias("item"), F.lit(0).cast("bigint").alias("n")) for c in catalog])
    counts = df.select(F.explode(recs).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.where(F.array_contains(items, F.col("item"))).agg(
        F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("m")
    )
    full = listed.select(
        F.sort_array(
            F.transform(zeros, lambda z: F.coalesce(F.try_element_at("m", z["item"]), z["n"]).cast("double"))
        ).alias("f")
    )
    n = len(catalog)
    weighted = F.aggregate(
        F.transform("f", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x
    )
    total = A.total(F.col("f"))
    gini = 2.0 * weighted / (n * total) - (n + 1.0) / n
    return full.select(
        F.round(F.when(total > 0, A.clipped(gini, 0.0, 1.0)).otherwise(0.0), 4).alias("gini")
    )


# ------------------------------------------------------- calibration, drift

def ece(df: DataFrame, probs: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (low, high]."""
    conf = F.array_max(probs)
    rows = df.select(
        conf.alias("conf"), (A.argmax(F.col(probs)) == F.col(label)).cast("int").alias("ok")
    )
    binned = rows.groupBy(F.ceil(F.col("conf") * bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ok").alias("acc"), F.avg("conf").alias("mean_conf")
    )
    used = F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("acc") - F.col("mean_conf"))).otherwise(0.0)
    return binned.agg(or_zero(F.sum(used) / F.sum("n")).alias("ece"))


def class_distribution(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Count and share of each class 0..n-1, absent ones as zero, and of every other label there is; nulls are no label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("cls"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(classes).groupBy("cls").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return full.select("cls", "n", F.when(whole > 0, F.col("n") / whole).otherwise(0.0).alias("share"))


def _pairs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    both = expected.select("cls", F.col("share").alias("p")).join(actual.select("cls", F.col("share").alias("q")), "cls", "full")
    return both.select("cls", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def psi(expected: DataFrame, actual: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Population stability index of two (cls, share) tables, shares bounded below."""
    pairs = _pairs(expected, actual).select(
        F.greatest("p", F.lit(eps)).alias("p"), F.greatest("q", F.lit(eps)).alias("q")
    )
    all_rows = Window.partitionBy(F.lit(0))
    p, q = F.col("p") / F.sum("p").over(all_rows), F.col("q") / F.sum("q").over(all_rows)
    return pairs.select(((q - p) * F.log(q / p)).alias("term")).agg(F.sum("term").alias("psi"))


def js_divergence(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence and distance, base 2, four decimals."""
    all_rows = Window.partitionBy(F.lit(0))
    p_all, q_all = F.sum("p").over(all_rows), F.sum("q").over(all_rows)
    pairs = _pairs(expected, actual).select(
        F.when(p_all > 0, F.col("p") / p_all).otherwise(0.0).alias("p"),
        F.when(q_all > 0, F.col("q") / q_all).otherwise(0.0).alias("q"),
        ((p_all > 0) & (q_all > 0)).alias("ok"),
    )
    middle = (F.col("p") + F.col("q")) / 2.0

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / middle)).otherwise(0.0)

    summed = pairs.agg(
        F.sum((part("p") + part("q")) / 2.0).alias("js"), F.min("ok").alias("ok")
    )
    js = F.when(F.col("ok"), A.clipped(F.col("js"), 0.0, 1.0)).otherwise(0.0)
    return summed.select(
        F.round(js, 4).alias("js_divergence"), F.round(F.sqrt(js), 4).alias("js_distance")
    )


# ------------------------------------------------------------ classification

def buyer_accuracy(df: DataFrame, pred: str, label: str) -> DataFrame:
    p, y = F.col(pred), F.col(label)
    return df.agg(
        F.round(pct_of(p == y, y != 0), 2).alias("buyer_top1"),
        F.round(pct_of(p == y, y == 0), 2).alias("non_buyer"),
        F.round(pct_of(p == y), 2).alias("overall"),
    )


def buyer_top1_filtered(df: DataFrame, recs: str, actual: str) -> DataFrame:
    """Share of rows with truth whose first recommended item is true."""
    first = F.coalesce(F.array_contains(F.col(actual), F.get(F.col(recs), F.lit(0))), F.lit(False))
    return df.agg(pct_of(first, F.size(actual) > 0).alias("buyer_top1"))


def alert_distribution(df: DataFrame, pred: str) -> DataFrame:
    n, silent = F.count(F.lit(1)), F.sum((F.col(pred) == 0).cast("int"))
    return df.agg(
        F.when(n > 0, F.round((n - silent) / n * 100.0, 2)).otherwise(0.0).alias("active_pct"),
        F.when(n > 0, F.round(silent / n * 100.0, 2)).otherwise(100.0).alias("silent_pct"),
    )


def fp_breakdown(df: DataFrame, pred: str, label: str, n_classes: int) -> DataFrame:
    """Per item class: truths, hits, firings on non-buyers, precision against them."""
    p, y = F.col(pred), F.col(label)
    rows = df.select(
        F.explode(F.array_distinct(F.array(p.cast("int"), y.cast("int")))).alias("cls"),
        p.alias("p"), y.alias("y"),
    ).groupBy("cls").agg(
        F.sum((F.col("y") == F.col("cls")).cast("int")).alias("true_count"),
        F.sum(((F.col("p") == F.col("cls")) & (F.col("y") == F.col("cls"))).cast("int")).alias("tp"),
        F.sum(((F.col("p") == F.col("cls")) & (F.col("y") == 0)).cast("int")).alias("fp_nb"),
    )
    classes = df.sparkSession.range(1, n_classes).select(F.col("id").cast("int").alias("cls"))
    full = F.broadcast(classes).join(rows, "cls", "left").na.fill(0)
    fired = F.sum("fp_nb").over(Window.partitionBy(F.lit(0)))
    return full.select(
        "cls", "true_count", "tp", "fp_nb",
        F.round(F.when(fired > 0, F.col("fp_nb") / fired * 100.0).otherwise(0.0), 1).alias("fp_share_pct"),
        F.round(F.col("tp") / (F.col("tp") + F.col("fp_nb") + 1e-9) * 100.0, 1).alias("prec_vs_nb"),
    )


def decision_columns(pred: str = "pred", label: str = "y", cold: str = "is_cold") -> list[Column]:
    """Aggregates of the decision bundle over rows from ``with_row_scores``."""
    p, y, c = F.col(pred), F.col(label), F.col(cold)
    return [
        pct_of(p == y, y > 0).alias("buyer_top1"),
        pct_of(p == 0, y == 0).alias("non_buyer_top1"),
        pct_of(p == y).alias("overall_top1"),
        pct_of(p > 0).alias("alert_pct"),
        mean_of(F.col("ap")).alias("map7"),
        mean_of(F.when(c, F.col("ap"))).alias("cold_map7"),
        mean_of(F.when(~c, F.col("ap"))).alias("warm_map7"),
        mean_of(F.col("ndcg")).alias("ndcg7"),
        mean_of(F.col("rr")).alias("mrr"),
        (mean_of(F.col("hit")) * 100.0).alias("hit7"),
        mean_of(F.col("recall")).alias("recall7"),
    ]


def decision_bundle(df: DataFrame, by: Sequence[str] = (), recs: str = "recs", actual: str = "actual", k: int = 7) -> DataFrame:
    scored = with_row_scores(df, recs, actual, k)
    return scored.groupBy(*by).agg(*decision_columns()) if by else scored.agg(*decision_columns())


def three_tier_map(df: DataFrame, base: str = "base_recs", recs: str = "recs", pred: str = "pred", label: str = "y", actual: str = "actual", k: int = 7) -> DataFrame:
    """MAP and hit rate on alerted buyers, on all buyers' rankings, and with misses as zero."""
    buyer = (F.col(label) > 0) & (F.size(actual) > 0)
    alerted = buyer & (F.col(pred) > 0) & (F.size(recs) > 0)
    raw_ap, raw_hit = (f(F.col(base), F.col(actual), k) for f in (R.average_precision, R.hit))
    live_ap, live_hit = (f(F.col(recs), F.col(actual), k) for f in (R.average_precision, R.hit))
    return df.agg(
        mean_of(F.when(alerted, live_ap)).alias("conditional_map7"),
        (mean_of(F.when(alerted, live_hit)) * 100.0).alias("conditional_hit7"),
        mean_of(F.when(buyer, raw_ap)).alias("unconditional_map7"),
        (mean_of(F.when(buyer, raw_hit)) * 100.0).alias("unconditional_hit7"),
        mean_of(F.when(buyer, F.when(alerted, live_ap).otherwise(0.0))).alias("coverage_map7"),
        (mean_of(F.when(buyer, F.when(alerted, live_hit).otherwise(0.0))) * 100.0).alias("coverage_hit7"),
        pct_of(F.col(pred) > 0).alias("alert_pct"),
    )


def metrics_by_cohort(df: DataFrame, recs: str, actual: str, cold: str, k: int = 7) -> DataFrame:
    """MAP, NDCG and hit rate for all, cold and warm rows by grouping sets."""
    scored = with_row_scores(df, recs, actual, k).withColumn(
        "_cohort", F.when(F.col(cold), "cold").otherwise("warm")
    )
    sets = scored.cube("_cohort").agg(
        mean_of(F.col("ap")).alias("map7"),
        mean_of(F.col("ndcg")).alias("ndcg7"),
        mean_of(F.col("hit")).alias("hit7"),
        F.count("ap").alias("n_rows"),
    )
    return sets.select(F.coalesce("_cohort", F.lit("all")).alias("cohort"), "map7", "ndcg7", "hit7", "n_rows")


# ----------------------------------------------------------------- AUC, AP, F1

def _score_counts(df: DataFrame, score: str, positive: Column, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(positive.cast("int")).alias("pos"), F.sum((~positive).cast("int")).alias("neg")
    )


def roc_auc(
    df: DataFrame, score: str, positive: Column, by: Sequence[str] = (), buckets: int = 256
) -> DataFrame:
    """Exact area under the ROC curve, ties at half weight."""
    by = list(by)
    run = running_totals(
        _score_counts(df, score, positive, by), "score", ["pos", "neg"], by, buckets=buckets
    )
    below = F.col("cum_neg") - F.col("neg")
    summed = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").alias("np"), F.sum("neg").alias("nn"),
    )
    area = F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np").cast("double") * F.col("nn")))
    return summed.select(*by, area.alias("auc"))


def average_precision_score(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Step-sum average precision over descending distinct scores."""
    run = running_totals(
        _score_counts(df, score, positive, []), "score", ["pos", "neg"], descending=True
    )
    term = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return run.agg((F.sum(term) / F.sum("pos")).alias("average_precision"))


def roc_auc_ovo(df: DataFrame, probs: str, label: str, n_classes: int) -> DataFrame:
    """Mean one-against-one AUC over the pairs of classes present.

    A row meets only the pairs of its own class: two scores for each other class.
    """
    y = F.col(label).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda c: c != y)
    side = F.transform(
        others,
        lambda c: F.array(
            F.struct(F.least(c, y).alias("a"), F.greatest(c, y).alias("b"), y.alias("pos_class")),
            F.struct(F.least(c, y).alias("a"), F.greatest(c, y).alias("b"), c.alias("pos_class")),
        ),
    )
    rows = df.select(
        F.col(probs).alias("_probs"), y.alias("_truth"), F.explode(F.flatten(side)).alias("t")
    ).select("t.a", "t.b", "t.pos_class", "_truth", F.get("_probs", F.col("t.pos_class")).alias("s"))
    areas = roc_auc(rows, "s", F.col("_truth") == F.col("pos_class"), ["a", "b", "pos_class"], buckets=64)
    return areas.agg(F.avg("auc").alias("auc_ovo"))


def f1_logloss(df: DataFrame, pred: str, label: str, probs: str, eps: float = 2.220446049250313e-16) -> DataFrame:
    """Accuracy, support-weighted F1 and clipped log loss in one row."""
    p, y = F.col(pred), F.col(label)
    own = A.clipped(F.get(F.col(probs), y), eps, 1 - eps)
    by_class = df.select(
        F.explode(F.array_distinct(F.array(p.cast("int"), y.cast("int")))).alias("cls"),
        p.alias("p"), y.alias("y"), own.alias("own"),
    ).groupBy("cls").agg(
        F.sum(((F.col("p") == F.col("cls")) & (F.col("y") == F.col("cls"))).cast("int")).alias("tp"),
        F.sum((F.col("p") == F.col("cls")).cast("int")).alias("n_pred"),
        F.sum((F.col("y") == F.col("cls")).cast("int")).alias("n_true"),
        F.sum(F.when(F.col("y") == F.col("cls"), -F.log("own")).otherwise(0.0)).alias("loss"),
    )
    f1 = 2.0 * F.col("tp") / (F.col("n_pred") + F.col("n_true"))
    return by_class.agg(
        (F.sum("tp") / F.sum("n_true")).alias("accuracy"),
        (F.sum(f1 * F.col("n_true")) / F.sum("n_true")).alias("f1_weighted"),
        (F.sum("loss") / F.sum("n_true")).alias("log_loss"),
    )


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    sse = F.sum((t - p) * (t - p))
    return df.agg(
        F.avg((t - p) * (t - p)).alias("mse"),
        F.corr(t, p).alias("corr"),
        F.when(F.var_pop(t) > 0, 1.0 - sse / (F.var_pop(t) * F.count(t))).alias("r2"),
    )


def latency_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, p50, p95 and p99; all zero for an empty input."""
    levels = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    by = list(by)
    cuts = group_quantiles(df, by, value, levels)
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"))
    if by:
        return join_lookup(means, cuts, by, "inner")
    row = cuts.first()
    points = {name: (row[name] if row and row[name] is not None else 0.0) for name in levels}
    return means.select(
        or_zero(F.col("mean")).alias("mean"), *[F.lit(v).alias(n) for n, v in points.items()]
    )


def compare_predictions(a: DataFrame, b: DataFrame, key: str = "row_id") -> DataFrame:
    """Align two prediction sets (key, y, pred, p0) and count agreement on non-buyers."""
    both = a.select(key, "y", F.col("pred").alias("pa"), F.col("p0").alias("pa0")).join(
        b.select(key, F.col("pred").alias("pb"), F.col("p0").alias("pb0")), key
    )
    quiet = F.col("y") == 0
    return both.agg(
        F.sum(quiet.cast("int")).alias("n_non_buyers"),
        F.sum((~quiet).cast("int")).alias("n_buyers"),
        pct_of(F.col("pa") == 0, quiet).alias("hold_a"),
        pct_of(F.col("pb") == 0, quiet).alias("hold_b"),
        pct_of(F.col("pa") == F.col("y"), ~quiet).alias("top1_a"),
        pct_of(F.col("pb") == F.col("y"), ~quiet).alias("top1_b"),
        mean_of(F.when(quiet, F.col("pa0"))).alias("mean_p0_a"),
        mean_of(F.when(quiet, F.col("pb0"))).alias("mean_p0_b"),
        F.sum((quiet & (F.col("pa") == 0) & (F.col("pb") > 0)).cast("int")).alias("a_held_b_fired"),
        F.sum((quiet & (F.col("pb") == 0) & (F.col("pa") > 0)).cast("int")).alias("b_held_a_fired"),
    )


def disagreement_top(a: DataFrame, b: DataFrame, key: str = "row_id", n: int = 5) -> DataFrame:
    """Most common classes the second set fires where the first holds a non-buyer."""
    both = a.select(key, "y", F.col("pred").alias("pa")).join(
        b.select(key, F.col("pred").alias("pb")), key
    )
    wrong = both.where((F.col("y") == 0) & (F.col("pa") == 0) & (F.col("pb") > 0))
    return (
        wrong.groupBy(F.col("pb").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "cls").limit(n)
    )


def model_record(df: DataFrame, name: str, train_shares: DataFrame, catalog: Sequence[int], n_classes: int) -> DataFrame:
    """One row of measures of a scored cohort (probs, ranked recs, y, actual, is_cold)."""
    r, a, c = F.col("base_recs"), F.col("actual"), F.col("is_cold")
    p, y = A.argmax(F.col("probs")), F.col("y")
    rows = df.withColumn("_p", p)
    p = F.col("_p")
    aggs = []
    for k in (4, 7):
        ap = R.average_precision(r, a, k)
        aggs += [
            F.round(mean_of(ap), 4).alias(f"map{k}"),
            F.round(mean_of(F.when(~c, ap)), 4).alias(f"warm_map{k}"),
            F.round(mean_of(F.when(c, ap)), 4).alias(f"cold_map{k}"),
        ]
    aggs += [F.round(mean_of(R.discounted_gain(r, a, k)), 4).alias(f"ndcg{k}") for k in (4, 5, 7)]
    aggs.append(F.round(mean_of(R.reciprocal_rank(r, a, 7)), 4).alias("mrr"))
    for k in (3, 4, 7):
        aggs += [
            F.round(mean_of(R.recall(r, a, k)), 4).alias(f"recall{k}"),
            F.round(mean_of(R.hit(r, a, k)) * 100.0, 2).alias(f"hit_rate{k}"),
        ]
    aggs += [
        F.round(pct_of(p > 0), 2).alias("active_alerts_pct"),
        F.round(pct_of(p == 0), 2).alias("silent_alerts_pct"),
        F.round(pct_of(p == y, y != 0), 2).alias("buyer_top1_acc"),
        F.round(pct_of(p == y, y == 0), 2).alias("non_buyer_acc"),
        F.round(pct_of(p == y), 2).alias("overall_top1_acc"),
    ]
    # Distributions hold one row per class.
    predicted = bounded_table(class_distribution(rows, "_p", n_classes))
    train_shares = bounded_table(train_shares)
    parts = [
        ece(df, "probs", "y").select(F.round("ece", 4).alias("ece")),
        psi(train_shares, predicted).select(F.round("psi", 4).alias("psi")),
        js_divergence(train_shares, predicted),
        catalog_gini(df, "base_recs", catalog).select(F.col("gini").alias("catalog_gini")),
    ]
    out = rows.agg(*aggs).withColumn("model_name", F.lit(name))
    # Each part is a one-row aggregate, so it travels as literals.
    for part in parts:
        for column, value in part.first().asDict().items():
            out = out.withColumn(column, F.lit(value))
    return out
