"""The skew-safe paths, forced on small data and compared with brute force."""

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrec.operators import encode as E
from panelrec.operators import sample as M
from panelrec.operators import scale as Z
from panelrec.operators.knn import nearest


def md5(seed, key):
    return hashlib.md5(f"{seed}|{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", round(rng.gauss(0, 1), 2)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, g string, x double").repartition(5)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def shuffled_joins(spark):
    """No broadcast, and sizes at which the small tables here count as skewed."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def jobs_of(spark, build):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "")
    out = build()
    seen = len(tracker.getJobIdsForGroup("plan"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, seen


def test_join_lookup_paths_agree(spark, skewed, shuffled_joins):
    rows, fact = skewed
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), (None, 9)], "g string, v int")
    with_null = fact.unionByName(spark.createDataFrame([(-1, None, 0.0)], "id long, g string, x double"))
    known = {"hot": 1, "k3": 2, "k6": 3, None: 9}
    for how in ("left", "inner"):
        out, jobs = jobs_of(spark, lambda: Z.join_lookup(with_null, lookup, ["g"], how))
        assert jobs == 0 and out.columns == ["id", "g", "x", "v"]
        want = [(*r, known.get(r[1])) for r in [*rows, (-1, None, 0.0)] if how == "left" or r[1] in known]
        large = sorted(map(str, map(tuple, out.collect())))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        small = sorted(map(str, map(tuple, Z.join_lookup(with_null, lookup, ["g"], how).collect())))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert small == large == sorted(map(str, want))


def test_hot_key_of_equal_rows_is_split(spark, shuffled_joins):
    fact = spark.range(40_000).selectExpr("'hot' as g", "1 as x").unionByName(spark.range(200).selectExpr("concat('k', id) as g", "2 as x")).repartition(8)
    counts = fact.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = Z.join_lookup(fact, counts, ["g"]).groupBy("x").agg(F.sum("n").alias("s"))
    got = {r.x: r.s for r in out.collect()}
    assert got == {1: 40_000 * 40_000, 2: 200}
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_join_on_table_derived_lookup(skewed, shuffled_joins):
    _, fact = skewed
    counts = fact.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = Z.join_lookup(fact, counts, ["g"], "inner")
    assert out.columns == ["id", "g", "x", "n"] and out.count() == 3000
    assert out.where("g = 'hot'").select("n").distinct().first()[0] == 2000


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_hash_segments_match_sorting(skewed, prefix):
    rows, fact = skewed

    def bounds(sizes):
        return sizes.withColumn("bounds", F.array(F.lit(0), F.floor(F.col("n") * 0.3), F.col("n") - 1, F.col("n") + 5).cast("array<bigint>"))

    got = {r["id"]: r["segment"] for r in Z.hash_segments(fact, ["g"], ["id"], bounds, 42, prefix).collect()}
    groups = defaultdict(list)
    for i, g, _ in rows:
        groups[g].append(i)
    for g, ids in groups.items():
        n = len(ids)
        for rank, i in enumerate(sorted(ids, key=lambda i: md5(42, i)), 1):
            assert got[i] == sum(rank > b for b in (0, int(n * 0.3), n - 1, n + 5)), (g, i)


def _expected_quota(rows, strata, quota, n):
    groups = defaultdict(list)
    for r in rows:
        groups[strata(r)].append(r[0])
    picked = set()
    for s, ids in groups.items():
        picked |= set(sorted(ids, key=lambda i: md5(42, i))[: quota(s, len(ids))])
    order = sorted((r[0] for r in rows), key=lambda i: (i not in picked, md5(42, i)))
    return set(order[:n])


@pytest.mark.parametrize("prefix", [1, 4])
@pytest.mark.parametrize("n", [10, 300, 2900, 5000])
def test_quota_samples_match_sorting(skewed, n, prefix):
    rows, fact = skewed
    specs = {"even": (["g"], F.lit(20)), "share": (["g"], F.floor(F.col("n") / 7)), "none": (["g"], F.lit(0))}
    out = Z.quota_samples(fact, specs, ["id"], n, prefix=prefix).collect()
    want = {
        "even": _expected_quota(rows, lambda r: r[1], lambda s, k: 20, n),
        "share": _expected_quota(rows, lambda r: r[1], lambda s, k: k // 7, n),
        "none": _expected_quota(rows, lambda r: r[1], lambda s, k: 0, n),
    }
    for name, ids in want.items():
        got = [r["id"] for r in out if r["sample"] == name]
        assert len(got) == len(set(got)) == min(n, 3000) and set(got) == ids


def test_sample_does_not_depend_on_partitions(skewed):
    _, fact = skewed
    draws = [
        {r["id"] for r in M.sample_per_group(fact.repartition(p), ["g"], ["id"], 15).collect()} for p in (1, 8)
    ]
    assert draws[0] == draws[1] and M.random_n(fact, ["id"], 100).count() == 100


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    rows, fact = skewed
    counts = fact.groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    out = Z.running_totals(counts, "x", ["n"], ["g"], descending, buckets=8).collect()
    for r in out:
        side = [v for _, g, v in rows if g == r["g"] and (v >= r["x"] if descending else v <= r["x"])]
        assert r["cum_n"] == len(side)


@pytest.mark.parametrize("sort_rows", [0, 10**6])
def test_group_quantiles_paths(skewed, sort_rows):
    rows, fact = skewed
    levels = {"a": 0.1, "m": 0.5, "z": 0.95}
    out = Z.group_quantiles(fact, ["g"], "x", levels, sort_rows=sort_rows).collect()
    assert len(out) == len({g for _, g, _ in rows})
    for r in out:
        values = [v for _, g, v in rows if g == r["g"]]
        assert [r["a"], r["m"], r["z"]] == pytest.approx(list(np.percentile(values, [10, 50, 95])))
    whole = Z.group_quantiles(fact, [], "x", {"m": 0.5}, sort_rows=sort_rows).first()[0]
    assert whole == pytest.approx(np.median([v for _, _, v in rows]))


def test_tight_brackets(spark):
    t = spark.range(20_000).select((F.pmod(F.col("id") * 7919, F.lit(20_000)) / 10).alias("x"))
    got = Z.group_quantiles(t, [], "x", {"p": 0.25, "m": 0.5}, accuracy=100, sort_rows=0).first()
    want = np.percentile(np.arange(20_000) / 10, [25, 50])
    assert [got["p"], got["m"]] == pytest.approx(list(want))


def test_ranked_table_paths_agree(skewed):
    _, fact = skewed
    order = [F.desc("x"), F.asc("id")]
    small = Z.ranked_table(fact, ["g"], order, "at").collect()
    large = Z.ranked_table(fact, ["g"], order, "at", sort_rows=10).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, large))


def test_frequency_codes_break_ties_by_value(spark):
    t = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    got = {r["value"]: r["code"] for r in E.fit_frequency_codes(t, ["v"]).collect()}
    assert got == {"c": 0, None: 1, "a": 2, "b": 3}


def test_newest(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 1, "c")], "k int, t int, v string")
    assert sorted(map(tuple, Z.newest(t, ["k"], ["t"]).collect())) == [(1, 3, "b"), (2, 1, "c")]


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("block", [100_000, 40])
def test_nearest_with_copies(spark, metric, block):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(120, 5))
    points[:50] = points[0]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    t = spark.createDataFrame(rows, "row_id long, vector array<double>").repartition(3)
    out = nearest(t, t, 7, metric=metric, exclude_self=True, block_rows=block).collect()
    got = defaultdict(dict)
    for r in out:
        got[r["row_id"]][r["rank"]] = r["context_id"]
    for i, p in enumerate(points):
        score = ((points - p) ** 2).sum(1) if metric == "l2" else -(points * p).sum(1)
        want = [j for j in sorted(range(120), key=lambda j: (score[j], j)) if j != i][:7]
        assert [got[i][k] for k in range(7)] == want


def test_nearest_rows_around_a_large_offset(spark):
    import numpy as np

    from panelrec.operators.knn import nearest

    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 6)) + 1e7
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id long, vector array<double>")
    got = {}
    for r in nearest(df, df, 3, exclude_self=True).collect():
        got.setdefault(r.row_id, {})[r["rank"]] = r.context_id
    for i in range(120):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        assert [got[i][k] for k in sorted(got[i])] == np.argsort(far, kind="stable")[:3].tolist()


def test_long_top_lists_and_fitted_transforms(spark):
    from panelrec.operators.clean import cap_categories, impute_by_group
    from panelrec.operators.encode import scale_power

    top = spark.range(15_000).selectExpr("cast(id as string) as c")
    got = cap_categories(spark.createDataFrame([("7",), ("14999",), ("x",), (None,)], "c string"), {"c": top})
    assert sorted(r.c for r in got.collect()) == ["14999", "7", "OTHER", "OTHER"]
    served = spark.createDataFrame([("new", None), ("new", 5.0)], "g string, v double")
    medians = spark.createDataFrame([("old", 1.0)], "g string, median double")
    assert sorted(r.v for r in impute_by_group(served, "v", "g", medians, 2.0).collect()) == [2.0, 5.0]
    fit = spark.range(100).selectExpr("cast(id as double) as v")
    moved = scale_power(spark.createDataFrame([(1000.0,), (1002.0,)], "v double"), ["v"], fit)
    assert min(r.v for r in moved.collect()) > 1


def test_nearest_with_equal_keys_and_blocks(spark):
    import numpy as np

    from panelrec.operators.knn import nearest

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, size=(90, 3)).astype(float)
    ids = [f"k{i % 5}" if i < 60 else f"u{i}" for i in range(90)]
    shape = "row_id string, vector array<double>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [("none", None)], shape)
    for exclude in (False, True):
        got = [(r.row_id, r["rank"], r.context_id, r.distance) for r in nearest(df, df, 4, exclude_self=exclude, block_rows=13).collect()]
        want = []
        for i in range(90):
            far = ((x - x[i]) ** 2).sum(1)
            near = sorted((far[j], ids[j]) for j in range(90) if not (exclude and ids[j] == ids[i]))[:4]
            want += [(ids[i], n, c, d) for n, (d, c) in enumerate(near)]
        assert sorted(got) == sorted(want)
    none = df.limit(0)
    assert nearest(df, none, 3).count() == 0 and nearest(none, df, 3).count() == 0
    # blocks meet in a shuffle: no plan of ours sends one side to the driver or to all tasks
    plan = nearest(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_nearest_holds_a_strip_and_busies_all_cores(spark, metric):
    """A pair of full blocks needs little beside its matrices, and a table below one block still meets in several tasks."""
    from panelrec.operators import knn

    rng = np.random.default_rng(5)
    rows, ids = rng.normal(size=(20_000, 8)) + 50.0, np.arange(20_000)
    tracemalloc.start()
    found = list(zip(range(700), knn._nearest(rows[:700], rows, ids[:700], ids, 3, metric, True)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 700 and peak < 40 << 20
    for i, (near, score) in found[::50]:
        exact = ((rows - rows[i]) ** 2).sum(1) if metric == "l2" else -(rows * rows[i]).sum(1)
        exact[i] = np.inf
        want = np.lexsort((ids, exact))[:3]
        assert near.tolist() == want.tolist() and score == pytest.approx(exact[want])
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids[:4000], rows)], "row_id long, vector array<double>")
    assert knn._dealt(t, "row_id", "vector", knn.BLOCK_ROWS)[1] >= 3
