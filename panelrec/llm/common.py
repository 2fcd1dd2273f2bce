"""Helpers shared by the operators: staging, row keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared checkpoint folder and read it back.

    Later steps start from the written table when an executor is lost, and the shuffle
    files behind it are removed as soon as it is written.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = f"{checkpoint_root(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def order_key(column: str = "doc_id") -> Column:
    """The id as a long that orders rows; rows without an id come last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, th, text)``: order key, hash of the text and the text, null texts being empty.

    Rows of one id and one text are one document to the operators that join on (key, th).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(order_key(id_col).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(node, component)``, component the smallest node.

    Alternating large-star and small-star steps: a logarithmic number of rounds, each a few
    aggregations and joins; every round is staged, and a hub's edges are never gathered in one row.
    """
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, staged(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old, large)
    own = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        own.select("node", F.col("node").alias("component")))
