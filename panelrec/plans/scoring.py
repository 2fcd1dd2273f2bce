"""Queries: trained scorers, softmax, ensembles and binned distributions."""

from pyspark.sql import functions as F

from panelrec.functions import arrays as A
from panelrec.functions import binned as B
from panelrec.functions import scalars as S
from panelrec.operators import models as O
from panelrec.operators.sample import stratified_split
from panelrec.plans import views as V
from panelrec.plans.registry import query, rounded
from panelrec.plans.views import r6, with_views

FEATURES = [f"f{i}" for i in range(64)]


def _training(spark, sf):
    t = V.scores(spark, sf).select("row_id", "y").join(V.vectors(spark, sf).select("row_id", "vector"), "row_id")
    t = t.select("row_id", "y", *[F.get("vector", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])
    return stratified_split(t, ["y"], ["row_id"])


@query("gatekeeper_scores")
def gatekeeper_scores(spark, sf):
    t = _training(spark, sf)
    model = O.PropensityModel(FEATURES, params=O.PropensityParams(trees=10, depth=4))
    fitted = model.fit(t.where(F.col("split") == "train"))
    return rounded(fitted.score(t.where(F.col("split") == "test")).select("row_id", "y", "p_buy"))


@query("multiclass_scores")
def multiclass_scores(spark, sf):
    t = _training(spark, sf)
    model = O.ClassModel(FEATURES, numTrees=20, maxDepth=6).fit(t.where(F.col("split") == "train"))
    scored = model.score(t.where(F.col("split") == "test"))
    return rounded(scored.select("row_id", "y", F.posexplode("probs").alias("cls", "p")))


@query("softmax", with_views("scores", """select row_id, cast(c as integer) as cls, round(probs[c + 1], 6) as p, round(ln(probs[c + 1]), 6) + 0.0 as log_p,
    round(hot[c + 1], 6) as p_hot from (select *, """ + V.softmax_sql("list_transform(logits, lambda x: x / 0.5)").replace("lambda x: exp(x", "lambda v: exp(v").replace("lambda x: x / list_sum", "lambda u: u / list_sum") + """ as hot from scores), range(0, 16) r(c)"""))
def softmax(spark, sf):
    z = F.col("logits")
    t = V.scores(spark, sf).select("row_id", F.explode(F.arrays_zip(
        F.sequence(F.lit(0), F.lit(15)).alias("cls"), A.softmax(z).alias("p"), A.log_softmax(z).alias("log_p"), A.tempered(z, 0.5).alias("p_hot"))).alias("r"))
    return rounded(t.select("row_id", "r.cls", "r.p", "r.log_p", "r.p_hot"))


_mean_logit = "list_transform(range(1, 17), lambda i: (logits[i] + logits2[i]) / 2.0)"


@query("ensemble_average", with_views("scores", f"""select row_id, cast(c as integer) as cls, round(f[c + 1], 6) as p from (select row_id, list_transform(z, lambda v: exp(v - list_max(z))
    / list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) as f from (select row_id, {_mean_logit} as z from scores)), range(0, 16) r(c)"""))
def ensemble_average(spark, sf):
    """Member 1 reports its classes reversed; the order is undone before averaging."""
    t = V.scores(spark, sf)
    first = t.select("row_id", F.lit(0).alias("member"), F.posexplode("logits").alias("class_id", "logit"))
    second = t.select("row_id", F.lit(1).alias("member"), F.posexplode(F.reverse("logits2")).alias("class_id", "logit"))
    members = O.undo_permutation(first.unionByName(second), {0: range(16), 1: range(15, -1, -1)})
    out = O.ensemble_average(members, "row_id")
    return rounded(out.select("row_id", F.posexplode("probs").alias("cls", "p")))


@query("ensemble_mean", with_views("scores", f"select row_id, {r6('(logits[2] + logits2[2] + logits[3]) / 3')} as prediction from scores"))
def ensemble_mean(spark, sf):
    t = V.scores(spark, sf).select("row_id", F.explode(F.array(F.get("logits", F.lit(1)), F.get("logits2", F.lit(1)), F.get("logits", F.lit(2)))).alias("prediction"))
    return rounded(O.ensemble_mean(t, "row_id"))


_hist = with_views("scores", "").rstrip() + """, hist as materialized (select row_id, probs as p,
    list_transform(range(0, 17), lambda i: (-10.0 + i * 1.25) * 2.0 + 1.0) as b from scores)"""


def _hist_df(spark, sf):
    return V.scores(spark, sf).select("row_id", "logits", B.even_borders(-10.0, 10.0, 16, F.lit(1.0), F.lit(2.0)).alias("b"))


@query("hist_borders", _hist + " select row_id, cast(i - 1 as integer) as pos, round(cast(b[i] as double), 6) + 0.0 as border from hist, range(1, 18) r(i)")
def hist_borders(spark, sf):
    return rounded(_hist_df(spark, sf).select("row_id", F.posexplode("b").alias("pos", "border")))


@query("hist_mean", _hist + " select row_id, round(list_sum(list_transform(range(1, 17), lambda i: p[i] * (b[i] + b[i + 1]) / 2)), 6) + 0.0 as mean from hist")
def hist_mean(spark, sf):
    return rounded(_hist_df(spark, sf).select("row_id", B.binned_mean(F.col("logits"), F.col("b")).alias("mean")))


@query("hist_mode", _hist + " select row_id, round((b[k] + b[k + 1]) / 2, 6) + 0.0 as mode from (select *, list_position(p, list_max(p)) as k from hist)")
def hist_mode(spark, sf):
    return rounded(_hist_df(spark, sf).select("row_id", B.binned_mode(F.col("logits"), F.col("b")).alias("mode")))


LEVELS = (0.1, 0.5, 0.9)


@query("hist_quantiles", _hist + f""" select row_id, level, round(b[k] + (b[k + 1] - b[k]) * (level - c[k] + p[k]) / p[k], 6) + 0.0 as value from (
    select *, list_position(list_transform(c, lambda x: x >= level), true) as k from (select row_id, p, b, list_transform(range(1, 17), lambda i: list_sum(p[1:i])) as c from hist),
    (select unnest({list(LEVELS)}::double[]) as level))""")
def hist_quantiles(spark, sf):
    levels = F.explode(F.array(*[F.lit(q) for q in LEVELS])).alias("level")
    t = _hist_df(spark, sf).select("row_id", "logits", "b", levels)
    return rounded(t.select("row_id", "level", B.binned_quantile(F.col("logits"), F.col("b"), F.col("level")).alias("value")))


@query("hist_sample", _hist + """ select row_id, round(b[k] + (b[k + 1] - b[k]) * (u - c[k] + p[k]) / p[k], 6) + 0.0 as draw from (
    select *, list_position(list_transform(c, lambda x: x >= u), true) as k from (select row_id, p, b, list_transform(range(1, 17), lambda i: list_sum(p[1:i])) as c,
      cast(('0x' || md5('42|' || row_id)[1:13])::bigint as double) / 4503599627370496.0 as u from hist))""")
def hist_sample(spark, sf):
    u = S.draw_unit(42, F.col("row_id"))
    return rounded(_hist_df(spark, sf).select("row_id", B.binned_quantile(F.col("logits"), F.col("b"), u).alias("draw")))
