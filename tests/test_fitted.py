"""Transforms fitted on one part and applied to another, against numpy."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrec.operators import fitted as Q


@pytest.mark.parametrize("n, points", [(1, 1000), (2, 1000), (7, 3), (500, 101), (3000, 1000)])
def test_quantile_points(spark, n, points):
    x = np.random.default_rng(n).integers(0, 400, n) / 8.0  # many ties
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    got = Q.fit_quantiles(df, ["x"], points).first()["points"]
    want = np.quantile(x, np.linspace(0, 1, min(points, n)))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_quantile_map_applies_to_new_rows(spark):
    rng = np.random.default_rng(1)
    fit, new = np.round(rng.normal(size=800), 1), np.round(rng.normal(size=300) * 2, 2)
    table = spark.createDataFrame([(float(v),) for v in fit], "x double")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(new)] + [(999, None)], "i int, x double")
    maps = {r["column"]: r["points"] for r in Q.fit_quantiles(table, ["x"], 50).collect()}
    q, ref = np.array(maps["x"]), np.linspace(0, 1, 50)
    # the mean of interpolating from the left and from the right is the middle of equal points
    want = 0.5 * (np.interp(new, q, ref) - np.interp(-new, -q[::-1], -ref[::-1]))
    out = Q.apply_quantiles(rows, maps)
    got = {r.i: r.x for r in out.collect()}
    np.testing.assert_allclose([got[i] for i in range(300)], 2 * want - 1, atol=1e-12)
    assert got[999] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    normal = Q.apply_quantiles(rows, maps, "normal").agg(F.max("x"), F.min("x")).first()
    assert normal[0] == pytest.approx(-normal[1]) and normal[0] == pytest.approx(5.199, abs=1e-3)
    none = Q.scale_quantile(rows, ["x"], fit=table.limit(0)).collect()
    assert all(r.x is None for r in none)


@pytest.mark.parametrize("output", ["uniform", "normal"])
def test_own_ranks_are_exact_beyond_any_map(spark, output):
    """Every distinct value is ranked; a map of 1,000 points would place the values between its points elsewhere."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.exp(rng.normal(size=3000) * 4), np.repeat(7.5, 400), [-0.0, 0.0]])
    rows = [(i, float(v)) for i, v in enumerate(x)] + [(9999, None)]
    df = spark.createDataFrame(rows, "i int, x double").repartition(5)
    got = {r.i: r.x for r in Q.scale_quantile(df, ["x"], output).collect()}
    assert len(got) == len(rows) and got[9999] is None
    ordered = np.sort(x)
    low, high = np.searchsorted(ordered, x), np.searchsorted(ordered, x, "right")
    u = (low + (high - low - 1) / 2) / (len(x) - 1)
    z = [NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)) for p in u] if output == "normal" else 2 * u - 1
    np.testing.assert_allclose([got[i] for i in range(len(x))], z, atol=1e-8 if output == "normal" else 1e-12)
    assert Q.scale_quantile(df.where("x is null"), ["x"], output).first().x is None


def test_projection_fits_once_and_applies(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 3.0
    fit = spark.createDataFrame([(r.tolist(),) for r in x[:300]] + [(None,)], "v array<double>").repartition(5)
    axes = Q.fit_pca(fit, "v", 3)
    axes.write.parquet(str(tmp_path / "axes"))
    kept = spark.read.parquet(str(tmp_path / "axes"))
    values, vectors = np.linalg.eigh(np.cov(x[:300].T))
    order = np.argsort(-values)[:3]
    rows = sorted(kept.collect(), key=lambda r: r.component)
    np.testing.assert_allclose([r.variance for r in rows], values[order])
    want = vectors[:, order]
    want = want * np.sign(want[np.abs(want).argmax(0), range(3)])
    np.testing.assert_allclose(np.array([r.loadings for r in rows]).T, want, atol=1e-9)
    new = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[300:])] + [(999, None)], "i int, v array<double>")
    got = {r.i: r.components for r in Q.project(new, "v", kept).collect()}
    np.testing.assert_allclose([got[i] for i in range(100)], x[300:] @ want, atol=1e-8)
    assert got[999] is None
    wide = Q.reduce_features(new.where("v is not null"), "v", 4, fit)
    assert {len(r.v) for r in wide.collect()} == {4} and Q.reduce_features(new, "v", 6, fit) is new
    assert Q.fit_pca(fit.limit(0), "v", 2).count() == 0
