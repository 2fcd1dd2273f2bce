"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Documents are dealt by a hash of their id, repeated rows also by the number of the repeat, into groups of bounded
size; each group is packed by best-fit decreasing.
A bin carries a bitmap of its sources and the set of its duplicate clusters: two documents of one cluster, or of two
sources that must stay apart, never share a bin. For each document the search goes through the bins in order of what
is left in them, from the tightest that holds the document, until one is compatible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm.common import SPACE, order_key

CAPACITY = 4096
ROWS_PER_GROUP = 8_000
COPIES_TOGETHER = 64


def cluster_of():
    """Duplicate cluster of a text: hash of its lower-cased words; texts without words are in none."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), SPACE, " "))
    return F.when(words != "", F.xxhash64(words))


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, forbidden: dict[int, int], capacity: int) -> np.ndarray:
    """Bin of each item; items come in the order they are packed, clusters below 0 are in no cluster."""
    bins = np.zeros(len(sizes), np.int64)
    left = np.zeros(max(16, len(sizes)), np.int64)
    seen = np.zeros(len(left), object)
    holders: dict[int, list[int]] = {}
    repeated = set(np.flatnonzero(np.bincount(clusters[clusters >= 0])).tolist()) if len(clusters) else set()
    used = 0
    for i, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist())):
        fits = left[:used] >= size
        if cluster in repeated and cluster in holders:
            fits[holders[cluster]] = False
        at = _tightest(left[:used], fits, seen, forbidden.get(source, 0))
        if at < 0:
            at, used = used, used + 1
            left[at], seen[at] = capacity, 0
        left[at] -= size
        seen[at] |= 1 << source
        if cluster in repeated:
            holders.setdefault(cluster, []).append(at)
        bins[i] = at
    return bins


def _tightest(left: np.ndarray, fits: np.ndarray, seen: np.ndarray, forbidden: int) -> int:
    """The fitting bin with least left (the oldest of equals) none of whose sources is forbidden, or -1."""
    able = np.flatnonzero(fits)
    while len(able):
        at = int(able[np.argmin(left[able])])
        if not forbidden or not seen[at] & forbidden:
            return at
        able = able[[not seen[b] & forbidden for b in able]]
    return -1


def packed(docs: DataFrame, capacity: int = CAPACITY, apart: tuple[tuple[str, str], ...] = (), rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """``(doc_id, piece, first_word, n_words, bin_id)`` of documents (doc_id, source, size, cluster).

    A document longer than a bin fills whole bins with its first pieces; what is left is packed like any document.
    Every word is in one piece; documents without words get a piece of no words. ``apart`` lists pairs of sources
    that share no bin. A null source is a source of its own, a null cluster none. Repeated rows are packed as
    often as they come, in different bins where they are one cluster. Groups are numbered by a count of the rows, so
    none grows with the table; bins never cross groups.
    """
    n = docs.count()
    groups = max(1, -(-n // rows_per_group))
    narrow = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("cluster").cast("long").alias("cluster"), order_key().alias("key"))
    # equal rows are counted and dealt a few at a time, so that they cannot fill one group; the count does not depend on order
    few = min(COPIES_TOGETHER, max(1, rows_per_group // 8))
    equal = narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n"))
    dealt = equal.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {few})"))).withColumn(
        "copies", F.least(F.lit(few), F.col("n") - F.col("part") * few))
    dealt = dealt.withColumn("g", F.pmod(F.xxhash64("key", "size", "cluster", "source", "part"), F.lit(groups)).cast("int")).drop("n", "part")
    pairs = tuple(tuple(p) for p in apart)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.loc[frame.index.repeat(frame["copies"])]
        frame = frame.sort_values(["key", "source", "size", "cluster"], kind="stable").reset_index(drop=True)
        size = frame["size"].to_numpy(np.int64)
        full = np.where(size > capacity, (size - 1) // capacity, 0)
        rest = size - full * capacity
        codes, names = pd.factorize(frame["source"].where(~frame["no_source"], "\\x00none"), sort=True)
        number = {name: i for i, name in enumerate(names)}
        forbidden: dict[int, int] = {}
        for a, b in pairs:
            if a in number and b in number:
                forbidden[number[a]] = forbidden.get(number[a], 0) | 1 << number[b]
                forbidden[number[b]] = forbidden.get(number[b], 0) | 1 << number[a]
        cluster = pd.factorize(frame["cluster"])[0]
        order = np.argsort(-rest, kind="stable")
        bins = np.empty(len(frame), np.int64)
        bins[order] = best_fit(rest[order], codes[order], cluster[order], forbidden, capacity)
        base = int(bins.max()) + 1
        rows = np.repeat(np.arange(len(frame)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        group = int(frame["g"].iloc[0])
        out = pd.DataFrame({
            "doc_id": pd.concat([frame["doc_id"], frame["doc_id"].iloc[rows]], ignore_index=True).astype("Int64"),
            "piece": np.concatenate((full, piece)),
            "first_word": np.concatenate((full * capacity, piece * capacity)),
            "n_words": np.concatenate((rest, np.full(len(rows), capacity))),
            "bin": np.concatenate((bins, base + np.arange(len(rows))))})
        out["bin_id"] = f"{group}-" + out["bin"].astype(str)
        return out[["doc_id", "piece", "first_word", "n_words", "bin_id"]]

    return dealt.groupBy("g").applyInPandas(run, "doc_id long, piece long, first_word long, n_words long, bin_id string")
