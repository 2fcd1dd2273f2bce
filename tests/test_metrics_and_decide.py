import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrec.config import CascadeSpec
from panelrec.functions import arrays as A
from panelrec.functions import binned as B
from panelrec.functions import scalars as S
from panelrec.operators import decide as D
from panelrec.operators import encode as E
from panelrec.operators import fusion as U
from panelrec.operators import metrics as M
from panelrec.operators import models as O
from panelrec.operators import reports as R
from panelrec.operators import sweeps as W
from panelrec.operators.fitted import scale_quantile
from panelrec.operators.knn import knn_class_probs


def lists(spark, *rows):
    return spark.createDataFrame(list(rows), "recs array<string>, actual array<string>")


def one(df):
    return df.first().asDict()


def test_map(spark):
    t = lists(spark, (["a", "b", "c"], ["a", "c"]), (["x", "y", "a"], ["a"]), (["a"], []))
    got = one(M.map_at_k(t, "recs", "actual", (1, 2, 7)))
    assert got["map_7"] == pytest.approx(((1 + 2 / 3) / 2 + 1 / 3) / 2)
    assert got["map_2"] == pytest.approx((1 / 2 + 0) / 2) and got["map_1"] == pytest.approx(0.5)
    assert one(M.map_at_k(lists(spark, (["a"], [])), "recs", "actual", (7,)))["map_7"] == 0.0


def test_ndcg_mrr_recall(spark):
    t = lists(spark, (["x", "y", "a"], ["a"]), (["b", "z"], ["b", "q", "r", "s"]), ([], ["a"]))
    got = one(M.ndcg_at_k(t, "recs", "actual", (7,)))["ndcg_7"]
    ideal = sum(1 / math.log2(i + 2) for i in range(4))
    assert got == pytest.approx((1 / 2 + 1 / ideal + 0) / 3)
    assert one(M.mrr(t, "recs", "actual"))["mrr"] == pytest.approx((1 / 3 + 1 + 0) / 3)
    got = one(M.recall_hit_at_k(t, "recs", "actual", (2, 3)))
    assert got["recall_3"] == pytest.approx((1 + 1 / 4) / 3) and got["hit_3"] == pytest.approx(2 / 3)
    assert got["recall_2"] == pytest.approx(1 / 12) and got["hit_2"] == pytest.approx(1 / 3)


def test_customer_eval_rules(spark):
    t = lists(spark, (["x", "a"], ["a", "b", "c"]), (["x"], ["a"]), (["x"], []), ([], []), ([], ["a"]))
    rows = M.customer_eval(t, "recs", "actual").collect()
    got = [(r["precision"], r["recall"], r["average_precision"]) for r in rows]
    assert got == [(0.5, 0.3333, 0.25), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_ece_by_hand(spark):
    rows = [(0, [0.95, 0.05]), (1, [0.92, 0.08]), (0, [0.65, 0.35]), (1, [0.45, 0.55])]
    t = spark.createDataFrame(rows, "y int, probs array<double>")
    want = (2 * abs(0.5 - 0.935) + abs(1 - 0.65) + abs(1 - 0.55)) / 4
    assert one(M.ece(t, "probs", "y"))["ece"] == pytest.approx(want)


def shares(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "cls int, share double")


def test_drift(spark):
    p, q = [0.5, 0.3, 0.2], [0.2, 0.3, 0.5]
    a, b = shares(spark, p), shares(spark, q)
    assert one(M.psi(a, a))["psi"] == pytest.approx(0.0, abs=1e-12)
    assert one(M.psi(a, b))["psi"] == pytest.approx(sum((y - x) * math.log(y / x) for x, y in zip(p, q)))
    assert one(M.js_divergence(a, a)) == {"js_divergence": 0.0, "js_distance": 0.0}
    mid = [(x + y) / 2 for x, y in zip(p, q)]
    js = sum(x * math.log2(x / m) + y * math.log2(y / m) for x, y, m in zip(p, q, mid)) / 2
    assert one(M.js_divergence(a, b)) == {"js_divergence": round(js, 4), "js_distance": round(math.sqrt(js), 4)}
    apart = M.js_divergence(shares(spark, [3, 0, 1]), shares(spark, [0, 2, 0]))
    assert one(apart) == {"js_divergence": 1.0, "js_distance": 1.0}
    assert one(M.js_divergence(shares(spark, [0, 0]), shares(spark, [0, 1])))["js_divergence"] == 0.0


def test_gini(spark):
    catalog = ["k", "l", "m"]
    even = lists(spark, (["k", "l", "m"], []), (["m"], []), (["l", "k"], []))
    assert one(M.catalog_gini(even, "recs", catalog))["gini"] == 0.0
    steep = spark.range(40).select(F.array(F.lit("l")).alias("recs"))
    assert one(M.catalog_gini(steep, "recs", catalog))["gini"] == pytest.approx(2 / 3, abs=1e-4)
    assert one(M.catalog_gini(steep.limit(0), "recs", catalog))["gini"] == 0.0


def test_alerts_accuracy_latency(spark):
    t = spark.createDataFrame([(0,), (5,), (2,), (9,), (0,), (1,)], "pred int")
    assert one(M.alert_distribution(t, "pred")) == {"active_pct": 66.67, "silent_pct": 33.33}
    assert one(M.alert_distribution(t.limit(0), "pred")) == {"active_pct": 0.0, "silent_pct": 100.0}
    t = spark.createDataFrame([(0, 0), (0, 4), (0, 0), (7, 7), (5, 0), (3, 8), (2, 9)], "y int, p int")
    assert one(M.buyer_accuracy(t, "p", "y")) == {"buyer_top1": 25.0, "non_buyer": 66.67, "overall": 42.86}
    ms = spark.createDataFrame([(4.0,), (8.0,), (16.0,)], "ms double")
    got = one(M.latency_summary(ms, "ms"))
    assert got["mean"] == pytest.approx(28 / 3) and got["p50"] == 8.0 and got["p95"] == pytest.approx(15.2)
    assert one(M.latency_summary(ms.limit(0), "ms")) == {"mean": 0.0, "p50": 0.0, "p95": 0.0, "p99": 0.0}


def test_auc_by_brute_force(spark):
    rng = np.random.default_rng(3)
    s, y = np.round(rng.random(400), 2), rng.integers(0, 2, 400)
    t = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert one(M.roc_auc(t, "s", F.col("y") == 1))["auc"] == pytest.approx(want)
    seen, total = 0.0, 0.0
    for v in sorted(set(s), reverse=True):
        hit = ((s == v) & (y == 1)).sum()
        total += hit * ((s >= v) & (y == 1)).sum() / (s >= v).sum()
        seen += hit
    assert one(M.average_precision_score(t, "s", F.col("y") == 1))["average_precision"] == pytest.approx(total / seen)


# ------------------------------------------------------------------- decisions

def row(p0, top, rest_class=5, n=16):
    """Probabilities with the given hold and one leading class."""
    left = (1 - p0 - top) / (n - 2)
    return [p0] + [top if c == rest_class else left for c in range(1, n)]


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (1, "purchase", row(0.1, 0.6, 3), 0.10, []),
        (2, "purchase", row(0.5, 0.3, 3), 0.90, []),
        (3, "click", row(0.1, 0.6, 3), 0.90, []),
        (4, "purchase", row(0.1, 0.6, 3), 0.90, []),
        (5, "purchase", row(0.1, 0.6, 3), 0.25, []),
        (6, "purchase", row(0.1, 0.5, 1), 0.90, []),
        (7, "purchase", row(0.1, 0.6, 3), 0.90, [3]),
        (8, None, row(0.1, 0.6, 3), None, []),
    ]
    return spark.createDataFrame(rows, "id int, action string, probs array<double>, p_buy double, held array<int>")


RELEVANCE = {"purchase": (1, 3, 9), "click": ()}


def test_four_regimes(events):
    rows = {r["id"]: r for r in D.route(events, RELEVANCE).collect()}
    assert rows[1]["regime"] == "stage1_cpu_hold" and rows[1]["recs"] == [] and rows[1]["odds_ratio"] == 0.0
    assert rows[2]["regime"] == "stage2_gate1c_hold" and rows[2]["prediction"] == 0 and len(rows[2]["recs"]) == 7
    assert rows[3]["regime"] == "candidate_a_silent_cache" and rows[3]["prediction"] == 3
    assert rows[4]["regime"] == "candidate_c_live_push" and rows[4]["is_active"]
    assert rows[5]["regime"] == "candidate_a_silent_cache"
    assert rows[6]["regime"] == "stage2_gate1c_hold"
    assert rows[7]["prediction"] == rows[7]["recs"][0] == 1 and 3 not in rows[7]["recs"]
    assert rows[8]["regime"] == "candidate_a_silent_cache"


def test_gate_on_recommended(events):
    rows = {r["id"]: r for r in D.route(events, RELEVANCE, CascadeSpec(gate_on="recommended")).collect()}
    assert rows[7]["regime"] == "stage2_gate1c_hold" and rows[4]["regime"] == "candidate_c_live_push"


def test_cascade_scores_only_rows_past_the_gate(spark, events):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    stripped = events.drop("probs")

    def scorer(df):
        passed = df.mapInPandas(count, df.schema)
        return passed.join(events.select("id", "probs"), "id").select(*df.columns, "probs")

    got = {r["id"]: r["regime"] for r in D.cascade(stripped, RELEVANCE, scorer).collect()}
    assert got == {r["id"]: r["regime"] for r in D.route(events, RELEVANCE).collect()}
    assert seen.value == 7


def test_odds_variants(spark):
    t = spark.createDataFrame([(0.5, 0.0), (0.5, 0.25)], "top double, hold double")
    got = t.select(S.odds(F.col("top"), F.col("hold")).alias("a"), S.odds(F.col("top"), F.col("hold"), "add").alias("b")).collect()
    assert got[0]["a"] == pytest.approx(5e7) and got[0]["b"] == pytest.approx(5e8)
    assert got[1]["a"] == 2.0
    edge = t.select(S.fires(F.lit(2.0), F.lit(2.0)).alias("s"), S.fires(F.lit(2.0), F.lit(2.0), False).alias("l")).first()
    assert (edge["s"], edge["l"]) == (False, True)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        p = rng.dirichlet([2.0] + [0.6] * 15)
        y = int(rng.choice(16, p=p)) if rng.random() < 0.7 else 0
        held = [int(c) for c in rng.choice(range(1, 16), size=rng.integers(0, 4), replace=False)]
        rows.append((i, [float(x) for x in p], float(rng.random()), held, y, [y] if y else [], bool(rng.random() < 0.4)))
    t = spark.createDataFrame(
        rows, "row_id int, probs array<double>, p_buy double, held array<int>, y int, actual array<int>, is_cold boolean")
    return D.with_candidates(t)


def test_sweep_equals_gating_one_by_one(cohort):
    thetas, deltas = (0.5, 2.0, 50.0), (0.0, 0.2)
    margin = F.col("p_top") - F.col("p_second")
    swept = W.sweep(cohort, [W.Axis("theta", F.col("odds"), thetas), W.Axis("delta", margin, deltas)]).collect()
    assert len(swept) == 6
    for r in swept:
        single = one(M.decision_bundle(D.apply_gate(cohort, D.gate_margin(r["theta"], r["delta"]))))
        assert {k: r[k] for k in single} == pytest.approx(single)


def test_configs_equal_two_tier_gate(cohort):
    configs = (W.GateConfig("open", None, 6.0, 1.8), W.GateConfig("shut", 0.4, 6.0, 1.8))
    for r in W.sweep_configs(cohort, configs).collect():
        gated = D.apply_gate(cohort, D.gate_two_tier(CascadeSpec(), r["gamma"]))
        single = one(M.decision_bundle(gated))
        assert {k: r[k] for k in single} == pytest.approx(single)
        tiers = one(M.three_tier_map(gated))
        assert r["conditional_map7"] == pytest.approx(tiers["conditional_map7"])


def test_ascent_beats_its_start(cohort):
    fitted = W.fit_coordinate_ascent(cohort, ["row_id"], floor=5.0).collect()
    assert len(fitted) == 15 and {r["theta"] for r in fitted} <= set((1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0))
    thetas = {r["cls"]: r["theta"] for r in fitted}
    half = cohort.where(F.substring(S.draw_key(42, F.col("row_id")), 1, 1) < "8")

    def hold(gate):
        return one(M.decision_bundle(D.apply_gate(half, gate)))["non_buyer_top1"]

    assert hold(D.gate_per_class(thetas)) >= hold(D.gate_odds(1.5))


def test_labels_and_names_beyond_the_expected_are_kept(spark):
    t = spark.createDataFrame([(0,), (0,), (2,), (7,), (-1,), (None,)], "y int")
    got = {r.cls: (r.n, r.share) for r in M.class_distribution(t, "y", 4).collect()}
    assert got == {0: (2, 0.4), 1: (0, 0.0), 2: (1, 0.2), 3: (0, 0.0), 7: (1, 0.2), -1: (1, 0.2)}
    other = M.class_distribution(spark.createDataFrame([(0,), (5,)], "y int"), "y", 4)
    assert M.psi(M.class_distribution(t, "y", 4), other).first()[0] > 0
    runs = spark.createDataFrame([("a", "m1", 1.0), ("a", "m 2", 3.0), ("b", "m1", 5.0)], "d string, name string, v double")
    rows = {r["d"]: (r["m 2"], r["m1"]) for r in R.pivot_fill(runs, "d", "name", "v").collect()}
    assert rows == {"a": (3.0, 1.0), "b": (5.0, 5.0)}


def test_columns_of_nulls_missing_baselines_and_empty_bins(spark):
    t = spark.createDataFrame([(None, 1.0), (None, 3.0)], "x double, y double")
    for scaled in (E.scale_minmax(t, ["x", "y"]), E.scale_robust(t, ["x", "y"]), E.scale_standard(t, ["x", "y"])):
        rows = scaled.collect()
        assert [r.x for r in rows] == [None, None] and rows[0].y == -rows[1].y
    results = spark.createDataFrame([("a", 0.5, 0.5, 50.0)], "config string, map7 double, cold_map7 double, buyer_top1 double")
    assert W.verdict(results, "config", "none").count() == 0
    bins = spark.createDataFrame([([-1e6, 0.0, 0.0], [0.0, 1.0, 2.0, 3.0])], "z array<double>, b array<double>")
    got = bins.select(B.binned_quantile(F.col("z"), F.col("b"), F.lit(0.0)).alias("low"), B.binned_quantile(F.col("z"), F.col("b"), F.lit(0.5)).alias("mid")).first()
    assert got.low == 0.0 and got.mid == 2.0


def test_ascent_ends_where_no_single_class_improves(spark):
    rng = random.Random(6)
    levels = (1.0, 1.5, 2.5, 4.0)
    rows = [(i, rng.randint(1, 3), rng.choice([0, 0, 1, 2, 3]), rng.uniform(0.5, 5.0)) for i in range(600)]
    table = spark.createDataFrame(rows, "i int, cand int, y int, odds double")
    fitted = W.fit_coordinate_ascent(table, ["i"], n_classes=4, thetas=levels, floor=15.0, passes=50).collect()
    sides = {r["i"]: r["half"] < "8" for r in table.select("i", F.substring(S.draw_key(42, F.col("i")), 1, 1).alias("half")).collect()}

    def measured(thetas, side):
        part = [r for r in rows if sides[r[0]] == side]
        fire = [r for r in part if r[3] > thetas[r[1]]]
        top1 = 100 * sum(r[1] == r[2] for r in fire) / sum(r[2] > 0 for r in part)
        quiet = sum(r[2] == 0 for r in part)
        return top1, 100 * (quiet - sum(r[2] == 0 for r in fire)) / quiet

    def score(thetas):
        top1, hold = measured(thetas, True)
        return hold - 10 * max(15.0 - top1, 0)

    found = {r["cls"]: r["theta"] for r in fitted}
    assert score(found) >= score(dict.fromkeys(found, 1.5))
    assert all(score({**found, c: t}) <= score(found) + 1e-9 for c in found for t in levels)
    assert (fitted[0]["val_buyer_top1"], fitted[0]["val_hold"]) == pytest.approx(measured(found, False), abs=0.006)


def test_tier_thresholds(spark):
    t = spark.createDataFrame([(1, 80.0), (2, 50.0), (3, 30.0), (4, 0.0)], "cls int, prec_vs_nb double")
    assert [r["theta"] for r in W.fit_tier_thresholds(t).orderBy("cls").collect()] == [1.0, 1.5, 2.5, 3.5]
    assert [r["theta"] for r in W.fit_tier_thresholds(t, "strict").orderBy("cls").collect()] == [1.0, 1.5, 3.0, 4.5]


def test_fusion(spark):
    p = [0.0, 0.5, 0.3, 0.2]
    q = [0.0, 0.1, 0.2, 0.7]
    t = spark.createDataFrame([(p, q, [1])], "p array<double>, q array<double>, held array<int>")
    args = (F.col("p"), F.col("q"), F.col("held"))
    r = t.select(
        U.fuse_linear(*args, 0.9).alias("lin"), U.fuse_rrf(*args).alias("rrf"),
        U.fuse_two_stage(*args, m=1).alias("two"), U.fuse_logodds(*args, 0.1).alias("log")).first()
    assert r["lin"] == [2, 3] and r["rrf"] == [3, 2] and r["two"] == [2, 3] and r["log"] == [3, 2]


def test_lists_and_vectors(spark):
    t = spark.createDataFrame([(["a", "b", "c", "d"], ["a", "d"])], "r array<string>, h array<string>")
    got = t.select(
        A.unheld_items(F.col("r"), F.col("h"), 3).alias("k"), A.ordered_union(F.col("h"), F.col("r")).alias("u"),
        A.append_absent(F.col("h"), F.lit("z"), F.lit("hold")).alias("z"),
        A.append_absent(F.col("h"), F.lit("hold"), F.lit("hold")).alias("n")).first()
    assert got["k"] == ["b", "c"] and got["u"] == ["a", "d", "b", "c"] and got["z"] == ["a", "d", "z"] and got["n"] == ["a", "d"]
    v = spark.createDataFrame([([1.0, 0.0, 2.0],)], "v array<double>")
    got = v.select(A.pad(F.col("v"), 5).alias("p"), A.pad(F.col("v"), 2).alias("c"), A.nonzero_count(F.col("v")).alias("n")).first()
    assert got["p"] == [1.0, 0.0, 2.0, 0.0, 0.0] and got["c"] == [1.0, 0.0] and got["n"] == 2
    with pytest.raises(Exception, match="wider"):
        v.select(A.pad(F.col("v"), 2, strict=True)).collect()


def test_scalers(spark):
    t = spark.createDataFrame([(0.0,)] * 20 + [(1000.0,)], "x double")
    assert E.sigma_clip(t, ["x"]).agg(F.max("x")).first()[0] < 1000.0
    t = spark.createDataFrame([(0, 0.0), (1, 0.0), (2, 100.0)], "i int, x double")
    assert E.normalize_masked(t, ["x"], F.col("i") < 2).agg(F.max("x")).first()[0] > 1e6
    s = spark.createDataFrame([(-1.0,), (0.0,), (math.e - 1,)], "x double").select(S.signed_log(F.col("x")).alias("y"))
    assert [r["y"] for r in s.collect()] == pytest.approx([-math.log(2), 0.0, 1.0])
    q = spark.createDataFrame([(float(x),) for x in (3, 1, 2, 2, 5)], "x double")
    got = sorted(r["x"] for r in scale_quantile(q, ["x"]).collect())
    assert got == pytest.approx([-1.0, -0.25, -0.25, 0.5, 1.0])
    n = spark.createDataFrame([(0.975,), (0.5,), (0.001,)], "p double").select(S.inverse_normal(F.col("p")).alias("z"))
    assert [r["z"] for r in n.collect()] == pytest.approx([1.959964, 0.0, -3.090232], abs=1e-5)


def test_unseen_codes(spark):
    fit = spark.createDataFrame([("a", "x"), ("a", "UNKNOWN"), ("b", "x")], "p string, q string")
    new = spark.createDataFrame([("a", "x"), ("zz", "zz"), (None, None)], "p string, q string")
    got = [tuple(r) for r in E.apply_frequency_codes(new, E.fit_frequency_codes(fit, ["p", "q"]), ["p", "q"]).collect()]
    assert got == [(0, 0), (2, 1), (2, 1)]


def test_binned_distribution(spark):
    logits = [math.log(p) for p in (0.2, 0.5, 0.3)]
    t = spark.createDataFrame([(logits, [0.0, 1.0, 2.0, 4.0])], "z array<double>, b array<double>")
    z, b = F.col("z"), F.col("b")
    got = t.select(
        B.binned_mean(z, b).alias("mean"), B.binned_mode(z, b).alias("mode"),
        *[B.binned_quantile(z, b, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.0, 0.1, 0.45, 0.85, 1.0)]).first()
    assert got["mean"] == pytest.approx(0.1 + 0.75 + 0.9) and got["mode"] == 1.5
    assert [got[f"q{q}"] for q in (0, 10, 45, 85, 100)] == pytest.approx([0.0, 0.5, 1.5, 3.0, 4.0])


def test_knn_votes(spark):
    near = spark.createDataFrame([(1, 0, 10, 0.0), (1, 1, 11, 1.0)], "row_id int, rank int, context_id int, distance double")
    labels = spark.createDataFrame([(10, 2), (11, 0)], "context_id int, label int")
    p = knn_class_probs(near, labels, 3).first()["probs"]
    assert sum(p) == pytest.approx(1.0) and p[2] > p[0] > p[1] > 0


def test_models_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0.3, np.where(x[:, 1] > 0, 2, 1), 0)
    t = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int")
    model = O.PropensityModel(["a", "b", "c"], params=O.PropensityParams(trees=5, depth=3)).fit(t)
    assert one(M.roc_auc(model.score(t), "p_buy", F.col("y") > 0))["auc"] > 0.9
    many = O.ClassModel(["a", "b", "c"], n_classes=16, numTrees=5).fit(t).score(t)
    r = many.first()
    assert len(r["probs"]) == 16 and sum(r["probs"]) == pytest.approx(1.0) and r["probs"][9] == 0.0
    hit = many.agg(F.avg((A.argmax(F.col("probs")) == F.col("y")).cast("int"))).first()[0]
    assert hit > 0.8


def test_plug_in_scorer(spark):
    def make():
        def predict(batch: np.ndarray) -> np.ndarray:
            e = np.exp(batch - batch.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        return predict

    t = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 3.0])], "id int, v array<double>")
    rows = {r["id"]: r["probs"] for r in O.plug_in_scorer(make, "v", 2)(t).collect()}
    assert rows[2] == pytest.approx([0.5, 0.5]) and rows[1][1] > rows[1][0]


def test_reports(spark):
    t = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 4, 100, 6, 7, 8)], "suite string, metric double")
    assert R.iqm(t, ["suite"], "metric").first()["iqm"] == pytest.approx((3 + 4 + 6 + 7) / 4)
    runs = spark.createDataFrame([("s", f, f"{f}{i}", float(i)) for f in (1, 2) for i in range(8)], "suite string, fold int, k string, metric double")
    got = R.iqm_bootstrap(runs, ["suite"], "fold", "metric", "k", reps=50).first()
    assert got["low"] <= got["mean"] <= got["high"] and 1 < got["mean"] < 6
    wide = R.pivot_fill(spark.createDataFrame([("r", "a", 1.0), ("r", "b", 3.0), ("q", "a", 5.0)], "r string, n string, v double"), "r", "n", "v", ["a", "b", "c"])
    assert sorted(map(tuple, wide.collect())) == [("q", 5.0, 5.0, 5.0), ("r", 1.0, 3.0, 2.0)]


def test_pivot_fill_means_do_not_depend_on_the_order_of_cells(spark):
    rows = [("r", "a", 0.1), ("r", "b", 0.2), ("r", "c", 0.3), ("q", "a", 0.3), ("q", "b", 0.1), ("q", "c", 0.2), ("h", "a", 1e20), ("h", "b", 2e20)]
    wide = R.pivot_fill(spark.createDataFrame(rows, "r string, n string, v double"), "r", "n", "v", ["a", "b", "c", "d"])
    assert {r["r"]: r["d"] for r in wide.collect()} == {"r": 0.6 / 3, "q": 0.6 / 3, "h": 1.5e20}
