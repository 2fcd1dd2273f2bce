"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key divided by its quality weight; a source's documents in key order are a
weighted sample without replacement at every prefix. A source is taken in complete epochs first and then by prefix
sums of sizes up to what is left of its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelrec.llm.common import SPACE, staged

WEIGHTS = (3, 1, 2)
EPOCHS = 2
BUDGET = 1.5
ROWS_PER_BUCKET = 1_000


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE, -1), "")


def sized(docs: DataFrame) -> DataFrame:
    """Add ``size`` (words) and ``quality``: a quarter plus three quarters of the share of words that differ."""
    words = docs.withColumn("__w", word_list(F.col("text")))
    n = F.size("__w")
    share = F.when(n > 0, F.size(F.array_distinct("__w")) / n).otherwise(0.0)
    return words.withColumn("size", n.cast("long")).withColumn("quality", 0.25 + 0.75 * share).drop("__w")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share ``budget`` of all sizes. A target stops
    at ``epochs`` times its source; the excess goes to the others by weight until none is above: with sources in order
    of cap / weight, those whose cap is reached by the level of the rest are capped, and one level holds for all others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    all_rows = Window.partitionBy()
    base = sizes.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * epochs).cast("double")).withColumn(
        "__t", F.sum("source_size").over(all_rows) * F.lit(budget))
    by_level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("__w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    marked = base.withColumn("__capped", F.col("__cap") * rest <= F.col("__w") * (F.col("__t") - before))
    left = F.col("__t") - F.sum(F.when(F.col("__capped"), F.col("__cap")).otherwise(0.0)).over(all_rows)
    free = F.sum(F.when(F.col("__capped"), 0.0).otherwise(F.col("__w"))).over(all_rows)
    return marked.withColumn("target", F.when(F.col("__capped"), F.col("__cap")).otherwise(F.col("__w") * left / free)).select(
        "source", "source_size", "target")


def mixed(docs: DataFrame, seed: int = 11, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every document (doc_id, source, size, quality).

    ``copies`` is the number of complete epochs plus one for documents that the rest of the budget reaches: in key order
    while at least half of the document fits. A row's key is drawn from its id and all its other columns but size and
    quality, so rows that share an id or have none need a column that tells them apart, such as the text or its hash. Ties of the
    key fall by id, then by the row's hash; rows equal in all of these share one key and are interchangeable. Null sources are a source; null sizes count as 0 and null or non-positive qualities as the least.

    Prefix sums run inside buckets of equal key width whose totals are summed first. A key's density is at most its
    weight, so with weights scaled to 1 at most no bucket of a source of m rows holds more than about
    m * width rows, whatever the weights; the width falls as rows grow.
    """
    names = [c for c in docs.columns if c not in ("size", "quality")]
    base = docs.withColumn("__row", F.xxhash64(*[F.col(c) for c in names])).withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    base = base.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    base = staged(base.withColumn("quality", F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(1e-3))))
    whole_table = base.agg(F.count(F.lit(1)).alias("n"), F.max("quality").alias("q")).first()
    n, top = whole_table["n"], whole_table["q"] or 1.0
    goal = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs)
    goal = goal.withColumn("__src", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).drop("source")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__row")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    width = max(ROWS_PER_BUCKET, n ** 0.5) / max(1, n)
    placed = base.withColumn("__key", -F.log(u) * top / F.col("quality")).withColumn("__b", F.floor(F.col("__key") / width).cast("long"))
    totals = placed.groupBy("__src", "__b").agg(F.sum("size").alias("__s"))
    earlier = Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__src", "__b", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__o")).join(goal, "__src")
    inside = Window.partitionBy("__src", "__b").orderBy("__key", "doc_id", "__row").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("__c", F.sum("size").over(inside)).join(offsets, ["__src", "__b"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    left = F.col("target") - whole * F.col("source_size")
    middle = F.col("__o") + F.col("__c") - F.col("size") / 2
    copies = (whole + F.when((F.col("source_size") > 0) & (middle <= left), 1).otherwise(0)).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(
        "__row", "__key", "__b", "__c", "__o", "__src", "quality")
