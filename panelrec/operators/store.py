"""Keyed feature table: lookup, upsert, expiry and deletion as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelrec.config import FEATURE_TTL_SECONDS
from panelrec.functions import arrays as A
from panelrec.operators.scale import join_lookup, newest


def upsert(existing: DataFrame, batch: DataFrame, keys: Sequence[str], updated: str = "updated_at") -> DataFrame:
    """Newest version of every key; the batch wins over an equal timestamp."""
    both = existing.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)))
    return newest(both, keys, [updated, "_from"]).drop("_from")


def delete_keys(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def alive(store: DataFrame, now: Column, updated: str = "updated_at", ttl: int = FEATURE_TTL_SECONDS) -> DataFrame:
    """Rows whose time to live has not run out at ``now``."""
    return store.where(F.col(updated) + F.make_dt_interval(secs=F.lit(ttl)) > now)


def store_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_keys"), F.max("updated_at").alias("newest"))


def lookup(
    events: DataFrame, store: DataFrame, key: str, width: int, fallback: DataFrame | None = None
) -> DataFrame:
    """Add vector, held list and ``source`` of each event's entity.

    Misses come from the batch ``fallback`` view when given, then from a zero vector
    and an empty list, marked unknown. Both tables hold one row per key.
    """
    kept = store.select(key, F.col("vector").alias("_sv"), F.col("held").alias("_sh"))
    out = join_lookup(events, kept, [key])
    if fallback is not None:
        batch = fallback.select(key, F.col("vector").alias("_fv"), F.col("held").alias("_fh"))
        out = join_lookup(out, batch, [key])
    else:
        out = out.withColumn("_fv", F.lit(None).cast(store.schema["vector"].dataType)).withColumn(
            "_fh", F.lit(None).cast(store.schema["held"].dataType)
        )
    zero = F.array_repeat(F.lit(0.0), width).cast(store.schema["vector"].dataType)
    none = F.array().cast(store.schema["held"].dataType)
    return out.select(
        *events.columns,
        F.coalesce("_sv", "_fv", zero).alias("vector"),
        F.coalesce("_sh", "_fh", none).alias("held"),
        F.when(F.col("_sv").isNotNull(), "store").when(F.col("_fv").isNotNull(), "fallback")
        .otherwise("unknown").alias("source"),
    )


def missed(events: DataFrame, store: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Fallback rows to write back: entities seen in events but absent from the store."""
    seen = events.select(key).distinct()
    return fallback.join(seen, key, "left_semi").join(store.select(key), key, "left_anti")


def first_acquisitions(events: DataFrame, key: str, item: str, order: Sequence[str]) -> DataFrame:
    """First time each entity acquired each item; bounded by entities times catalog."""
    return events.where(F.col(item).isNotNull()).groupBy(key, item).agg(
        F.min(F.struct(*order)).alias("first")
    )


def held_before(
    events: DataFrame, key: str, item: str, order: Sequence[str], base: DataFrame | None = None
) -> DataFrame:
    """Items held just before each event: the base list, then earlier acquisitions in order.

    Each entity's acquisitions shrink to one first time per item before they meet the
    events, so a busy entity costs a lookup of catalog size, not a window over its past.
    """
    firsts = first_acquisitions(events, key, item, order)
    lists = firsts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("first", F.col(item).alias("item")))).alias("_got")
    )
    out = join_lookup(events, lists, [key])
    now = F.struct(*order)
    got = F.transform(
        F.filter(F.coalesce("_got", F.array().cast(lists.schema["_got"].dataType)), lambda g: g["first"] < now),
        lambda g: g["item"],
    )
    if base is None:
        return out.select(*events.columns, got.alias("held"))
    start = join_lookup(out, base.select(key, F.col("held").alias("_start")), [key])
    both = A.ordered_union(F.coalesce("_start", F.array().cast(base.schema["held"].dataType)), got)
    return start.select(*events.columns, both.alias("held"))


def latest_recs(decisions: DataFrame, key: str, time: str, tie: str, now: Column, ttl: int) -> DataFrame:
    """Newest decision per entity that has not expired at ``now``."""
    return alive(newest(decisions, [key], [time, tie]), now, time, ttl)
