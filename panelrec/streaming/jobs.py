"""Streaming decisions, held-item state and telemetry.

Sinks are written per batch id with overwrite, so a replayed batch replaces its own
output: at-least-once delivery plus that gives every event one stored decision.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelrec.config import RECS_TTL_SECONDS, CascadeSpec
from panelrec.functions import arrays as A
from panelrec.operators.decide import cascade
from panelrec.operators.scale import newest
from panelrec.operators.store import lookup, missed
from panelrec.streaming.keyed import KeyedTable
from panelrec.streaming.state import held_items
from panelrec.streaming.telemetry import Tail

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("item", T.IntegerType()),
])


def event_stream(
    spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, files_per_trigger: int | None = None,
    kind: str = "parquet",
) -> DataFrame:
    """Events from a folder; the query's checkpoint is the read position."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(kind).load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """Events as JSON values of a topic; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "subscribe", topic
    ).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def with_defaults(events: DataFrame) -> DataFrame:
    """Fill a missing action with ``unknown``."""
    return events.withColumn("action", F.coalesce("action", F.lit("unknown")))


def dedup_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


# ------------------------------------------------------- log-structured sinks

def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch under its id; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def read_newest(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keyed table view of a log: the newest row of every key."""
    return newest(read_log(spark, path), keys, [*order, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, path: str, target: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Rewrite a log as one row per key in a new folder."""
    write_batch(read_newest(spark, path, keys, order), target, 0)


RECS_COLUMNS = "user_id long, event_id long, ts timestamp, action string, prediction int, recs array<int>, is_active boolean, regime string, expires_at timestamp"
LATENCY_COLUMNS = "n_events long, mean_ms double, max_ms double, decided_at timestamp"


def recs_table(path: str, buckets: int = 64) -> KeyedTable:
    """Newest decision of every user, by event time."""
    return KeyedTable(path, RECS_COLUMNS, ("user_id",), ("ts", "event_id"), buckets)


def recommendations(routed: DataFrame, ttl_seconds: int = RECS_TTL_SECONDS) -> DataFrame:
    """Decisions as rows of ``recs_table``, each with the time at which it expires."""
    names = [c.split()[0] for c in RECS_COLUMNS.split(", ")]
    ts = F.col("ts").cast("timestamp")
    return routed.withColumn("ts", ts).withColumn("expires_at", ts + F.make_dt_interval(secs=F.lit(ttl_seconds))).select(*names)


def current(recs: DataFrame, now: Column) -> DataFrame:
    """Recommendations that have not expired at ``now``."""
    return recs.where(F.col("expires_at") > now)


@dataclass(frozen=True)
class Outputs:
    """Where a decision sink writes: the log of all decisions and, if named, the newest decision of every user, the last
    decisions for telemetry, one row of latencies a batch, and fallback rows of entities the store lacks."""

    log: str
    recs: KeyedTable | None = None
    tail: Tail | None = None
    latency: str | None = None
    missed: str | None = None


def decision_sink(
    outputs: Outputs | str,
    store: Callable[[SparkSession], DataFrame] | KeyedTable,
    relevance: dict[str, Sequence[int]],
    scorer: Callable[[DataFrame], DataFrame],
    propensity: Callable[[DataFrame], DataFrame],
    width: int,
    fallback: Callable[[SparkSession], DataFrame] | None = None,
    store_path: str | None = None,
    spec: CascadeSpec = CascadeSpec(),
    ttl_seconds: int = RECS_TTL_SECONDS,
) -> Callable[[DataFrame, int], None]:
    """Batch function: features, propensity, gated scoring, routing, then all outputs of the batch.

    ``store`` and ``fallback`` are read anew per batch, so updates are seen; a ``KeyedTable`` as ``store`` is read in the
    buckets of the batch's users only. Items of a ``held`` column of the events (``held_items``) are held besides the
    store's. The log is written first and everything else is made from what was written, so a batch decides once and a
    replay gives all outputs the same rows again, only latencies being those of the replay. With ``store_path`` fallback rows of missing entities are written back.
    """
    to = Outputs(outputs, missed=store_path) if isinstance(outputs, str) else outputs

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = with_defaults(batch)
        claimed = "held" in events.columns
        if claimed:
            events = events.withColumnRenamed("held", "_claimed")
        table = store.read(spark, events.select(*store.keys)) if isinstance(store, KeyedTable) else store(spark)
        batch_view = fallback(spark) if fallback else None
        featured = lookup(events, table, "user_id", width, batch_view)
        if claimed:
            both = A.ordered_union(F.col("held"), F.coalesce("_claimed", F.array().cast("array<int>")))
            featured = featured.withColumn("held", both).drop("_claimed")
        routed = cascade(propensity(featured), relevance, scorer, spec).drop("vector")
        seen = Observation()
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        write_batch(routed.observe(seen, F.count(F.lit(1)).alias("n"), F.avg(ms).alias("mean"), F.min(ms).alias("least")), to.log, batch_id)
        decided = time.time() * 1000
        written = spark.read.parquet(f"{to.log}/batch_id={batch_id}")
        if to.recs is not None:
            to.recs.write(recommendations(written, ttl_seconds), batch_id)
        if to.tail is not None:
            to.tail.add(written.withColumn("latency_ms", F.lit(decided) - ms), batch_id)
        if to.latency is not None:
            n, mean, least = (seen.get[x] for x in ("n", "mean", "least"))
            row = (n, decided - mean if n and mean is not None else None, decided - least if least is not None else None, datetime.fromtimestamp(decided / 1000))
            write_batch(spark.createDataFrame([row], LATENCY_COLUMNS), to.latency, batch_id)
        if batch_view is not None and to.missed is not None:
            write_batch(missed(events, table, batch_view, "user_id"), to.missed, batch_id)

    return run


def start_decisions(
    events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# -------------------------------------------------------------- keyed state

def held_state_stream(events: DataFrame) -> DataFrame:
    """Items each user held just before each event; ``item`` is set on acquisitions."""
    return held_items(events).select("event_id", "user_id", "action", "held")


# ---------------------------------------------------------------- telemetry

def telemetry(decisions: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Decisions per event-time window: count, live share, latency."""
    return (
        decisions.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(*telemetry_columns())
        .select(F.col("w.start").alias("day"), "n", "n_active", "mean_latency")
    )


def telemetry_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("is_active").cast("int")).alias("n_active"),
        F.avg("latency_ms").alias("mean_latency"),
    ]
