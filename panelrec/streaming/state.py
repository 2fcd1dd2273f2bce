"""Held items and sessions: state kept by entity inside a stream, with batch forms for whole tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window


class HeldItems(StatefulProcessor):
    """Adds the items an entity held just before each of its events and keeps them as a list state.

    The state of an entity is as long as the item catalog at most; of an entity's events those of one micro-batch meet.
    """

    def __init__(self, item: str, order: Sequence[str], columns: Sequence[str]):
        self.item, self.order, self.columns = item, list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("held", T.StructType([T.StructField("item", T.IntegerType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held = [r[0] for r in self.items.get()]
        item = events[self.item]
        fresh = (item.notna() & ~item.isin(held) & ~item.duplicated()).to_numpy()
        gained = item.to_numpy()[fresh].astype(int).tolist()
        if gained:
            self.items.appendList([(i,) for i in gained])
        upto = len(held) + np.cumsum(fresh) - fresh
        every = [*held, *gained]
        yield events[self.columns].assign(held=[every[:n] for n in upto])

    def close(self) -> None:
        pass


def held_items(events: DataFrame, key: str = "user_id", item: str = "item", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Streaming ``events`` with ``held``; ``item`` is set where an event acquires one.

    Needs the RocksDB state store (``build_session`` sets it). Batches are taken as they come: an event that arrives in a
    later batch sees what was acquired in earlier ones, whatever its time.
    """
    names = events.columns
    schema = T.StructType([*events.schema.fields, T.StructField("held", T.ArrayType(T.IntegerType()))])
    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=HeldItems(item, order, names), outputStructType=schema, outputMode="Append", timeMode="None")


# ------------------------------------------------------------------ sessions

SESSION_COLUMNS = ("session_start", "session_end", "n_events", "n_acquired")


def session_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "user_id", item: str = "item") -> DataFrame:
    """Sessions of each entity: events at most ``gap`` apart; a late event within ``delay`` extends or joins sessions.

    ``session_end`` is the time of the last event. Rows come out once the watermark has passed a session's end.
    """
    grouped = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n_events"), F.count(item).alias("n_acquired")).select(
        key, F.col("w.start").alias("session_start"), *SESSION_COLUMNS[1:])


def sessions(events: DataFrame, gap_seconds: int = 1800, key: str = "user_id", item: str = "item") -> DataFrame:
    """``session_stream`` over a whole table: gap flags and their running sum.

    Events are first counted by slices of one gap's length, map-side: two events of a slice are always of one session.
    The window over an entity then sees one row for each slice it was active in, however busy it is. Events without time
    are left out, those without key are one entity.
    """
    gap = gap_seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    slices = events.where("ts is not null").groupBy(F.col(key), F.floor(micros / gap).alias("slice")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.min(micros).alias("first_us"), F.max(micros).alias("last_us"),
        F.count(F.lit(1)).alias("n"), F.count(item).alias("got"))
    order = Window.partitionBy(key).orderBy("slice")
    apart = F.coalesce((F.col("first_us") - F.lag("last_us").over(order) > gap).cast("int"), F.lit(1))
    numbered = slices.withColumn("apart", apart).withColumn("session", F.sum("apart").over(order))
    return numbered.groupBy(key, "session").agg(
        F.min("first").alias("session_start"), F.max("last").alias("session_end"), F.sum("n").alias("n_events"), F.sum("got").alias("n_acquired")
    ).drop("session")
