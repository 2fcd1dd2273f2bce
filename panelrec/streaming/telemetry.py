"""Telemetry over the last n decisions, kept from batch to batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.sources.tables import stream_tail

NEEDED = ("event_id", "ts", "action", "regime", "is_active", "latency_ms")


def telemetry_of(tail: DataFrame, total: Column) -> DataFrame:
    """One row over the newest decisions: how many, median and 95th percentile of latency, shares of live and silent ones,
    and the mix of actions and regimes by count; zeros and empty mixes without decisions. Latencies that are null do not count.
    """
    def mix(name: str) -> Column:
        # the tail is bounded, so is a list of its values
        values = F.filter(F.collect_list(F.coalesce(F.col(name), F.lit("unknown"))), lambda x: x.isNotNull())
        counted = F.transform(F.array_distinct(values), lambda v: F.struct(
            (-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")))
        return F.array_join(F.transform(F.array_sort(counted), lambda s: F.concat(s["v"], F.lit(":"), (-s["n"]).cast("string"))), ",")

    share = F.coalesce(F.avg(F.coalesce(F.col("is_active"), F.lit(False)).cast("int")) * 100.0, F.lit(0.0))
    n = F.count(F.lit(1))
    return tail.agg(
        n.alias("n_events"), F.coalesce(F.max(total), F.lit(0)).cast("long").alias("total_events"),
        F.coalesce(F.percentile("latency_ms", F.lit(0.5)), F.lit(0.0)).alias("p50"),
        F.coalesce(F.percentile("latency_ms", F.lit(0.95)), F.lit(0.0)).alias("p95"),
        share.alias("active_pct"), F.when(n > 0, 100.0 - share).otherwise(0.0).alias("silent_pct"),
        mix("action").alias("action_mix"), mix("regime").alias("regime_mix"))


def last_decisions(decisions: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest by (ts, event_id): each partition offers at most n."""
    return stream_tail(decisions.select(*NEEDED), n, "ts", "event_id")


class Tail:
    """The newest ``n`` decisions of a stream as a small table, one version a batch.

    A batch's version is made of the version before it and the batch, so a replay writes the same version again; the
    version before is kept for that, older ones are deleted. Reading telemetry never goes back to the log.
    """

    def __init__(self, path: str, n: int = 1000):
        self.path, self.n = path, n

    def add(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select(*NEEDED, F.lit(0).cast("long").alias("seen"))
        before = [v for v in self._versions(spark) if v < batch_id]
        both, seen = own, batch.count()
        if before:
            old = self._version(spark, before[-1])
            seen += old.agg(F.max("seen")).first()[0] or 0
            both = own.unionByName(old.select(*own.columns))
        kept = stream_tail(both, self.n, "ts", "event_id").withColumn("seen", F.lit(seen).cast("long"))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        for v in before[:-1]:
            store, path = self._files(spark, f"/version={v}")
            store.delete(path, True)

    def telemetry(self, spark: SparkSession) -> DataFrame:
        versions = self._versions(spark)
        if versions:
            return telemetry_of(self._version(spark, versions[-1]), F.col("seen"))
        empty = "event_id long, ts timestamp, action string, regime string, is_active boolean, latency_ms double"
        return telemetry_of(spark.createDataFrame([], empty), F.lit(0))

    def _version(self, spark: SparkSession, v: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/version={v}")

    def _versions(self, spark: SparkSession) -> list[int]:
        store, root = self._files(spark)
        if not store.exists(root):
            return []
        names = [f.getPath() for f in store.listStatus(root)]
        done = [p for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))

    def _files(self, spark: SparkSession, name: str = ""):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path + name)
        return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path
