"""N-gram Jaccard join by PartEnum signatures over size bands.

A document's set is its distinct shingles. Sets whose similarity reaches the threshold have close sizes and a bounded
symmetric difference, so inside a size band the feature domain is split into one part more than that bound: two
similar sets then agree on a whole part, and the part's content is a shared signature (PartEnum with all of the
difference spent on the first level). Sets are compared exactly on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm import symbols
from panelrec.llm.common import NO_ID, WORD, components, discard, keyed, order_key, staged

RESEEDS = 6
CROWD = 32
BLOCK = 256


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` lower-cased words; a link where 100 * intersection >= percent * union; bands grow by ``growth``.

    Signatures are shuffled in ``shares`` shares, one after the other, to bound the disk they take at once.
    """

    words: int = 5
    percent: int = 80
    growth: float = 1.8
    shares: int = 3

    def band(self, size: int) -> int:
        """Band of a set's size: band b covers sizes edge(b) to edge(b + 1) - 1."""
        b = max(0, floor(np.log(size) / np.log(self.growth)) - 1)
        while self.edge(b + 1) <= size:
            b += 1
        return b

    def edge(self, b: int) -> int:
        return ceil(round(self.growth ** b, 9))

    def parts(self, b: int) -> int:
        """One more than the largest symmetric difference of a linked pair whose larger set lies in band b."""
        top, p = self.edge(b + 1) - 1, self.percent
        # |x - y| + |y - x| = x + y - 2 i with i >= p (x + y) / (100 + p), largest where both are at the top
        return (2 * top * (100 - p)) // (100 + p) + 1

    def difference(self, size: int) -> int:
        """Largest symmetric difference of a linked pair with a set of this size."""
        largest = 100 * size // self.percent
        return (size + largest) * (100 - self.percent) // (100 + self.percent)

    def bands(self, size: int) -> list[int]:
        """Bands a set signs for: its own and, where a larger partner may lie there, the next."""
        b = self.band(size)
        return [b, b + 1] if 100 * size >= self.percent * self.edge(b + 1) else [b]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of all k-word shingles; fewer words make one shingle, no words none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(symbols.BASE) + hashes[j:len(hashes) - k + 1 + j]
    out = symbols.mix(out + np.uint64(k))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _sums(values: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Sums modulo 2^64 of the values in each part; 32-bit halves are summed exactly as doubles."""
    low = np.bincount(part, values & np.uint64(0xFFFFFFFF), parts).astype(np.uint64)
    high = np.bincount(part, values >> np.uint64(32), parts).astype(np.uint64)
    return low + (high << np.uint64(32))


def _label(band: int, seed: int) -> np.uint64:
    return np.uint64(((band * (RESEEDS + 1) + seed) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF)


def signatures(found: np.ndarray, join: Join, bands: list[int] | None = None, seed: int = 0) -> np.ndarray:
    """Signatures of a set: for each of its bands, one for each part that has shingles.

    A part both sets leave empty says nothing. Two linked sets can agree on empty parts alone only if every filled part of
    each holds a difference, so only if neither has more filled parts than its largest difference. Such a set signs
    again under another split of the domain, and after ``RESEEDS`` splits for its empty parts too: no link is missed.
    """
    out = []
    for b in join.bands(len(found)) if bands is None else bands:
        parts = join.parts(b)
        for again in range(seed, RESEEDS + 1):
            salted = symbols.mix(found + np.uint64(again * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            part = ((salted >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
            filled = np.bincount(part, minlength=parts) > 0
            sums = symbols.mix(_sums(salted, part, parts)) + np.arange(parts, dtype=np.uint64) * np.uint64(symbols.BASE)
            label = _label(b, again)
            out.append(symbols.mix((sums ^ label) if again == RESEEDS else (sums ^ label)[filled]))
            if filled.sum() > join.difference(len(found)):
                break
    return np.concatenate(out)


def sets_of(piece: symbols.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all texts of a piece in one array, each sorted, and where each starts (one more than texts)."""
    found = symbols.words(piece)
    hashes = symbols.word_hashes(piece, found, lower=True)
    at, text = symbols.window_starts(found.starts, k)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * np.uint64(symbols.BASE) + hashes[at + j]
    out = symbols.mix(out + np.uint64(k))
    n = np.diff(found.starts)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([shingles(hashes[found.starts[i]:found.starts[i + 1]], k)[0] for i in short], np.uint64)
        order = np.argsort(np.concatenate((text, short)), kind="stable")
        out, text = np.concatenate((out, whole))[order], np.concatenate((text, short))[order]
    starts = np.searchsorted(text, np.arange(len(n) + 1))
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
        out[lo:hi].sort()
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[first], np.concatenate(([0], np.cumsum(np.bincount(text[first], minlength=len(n)))))


def batch_signatures(values: np.ndarray, starts: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of many sets at once, the set of each, and each set's margin; the same values as ``signatures``.

    A set's margin is the least number of signatures that it shares with any set it links with, over its bands: its
    filled parts less its largest difference.
    """
    sizes = np.diff(starts)
    plan = [(i, b) for i, s in enumerate(sizes.tolist()) if s for b in join.bands(s)]
    if not plan:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
    sets, bands = np.array(plan, np.int64).T
    parts = np.array([join.parts(b) for b in range(int(bands.max()) + 1)], np.int64)[bands]
    offsets = np.concatenate(([0], np.cumsum(parts)))
    n = sizes[sets]
    row = np.repeat(np.arange(len(sets)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[sets][row]
    salted = symbols.mix(values)[at]
    slot = offsets[row] + ((salted >> np.uint64(33)) % parts[row].astype(np.uint64)).astype(np.int64)
    total = int(offsets[-1])
    filled = np.bincount(slot, minlength=total) > 0
    owner = np.repeat(np.arange(len(sets)), parts)
    sums = symbols.mix(_sums(salted, slot, total)) + (np.arange(total) - offsets[owner]).astype(np.uint64) * np.uint64(symbols.BASE)
    label = np.array([_label(b, 0) for b in range(int(bands.max()) + 1)], np.uint64)[bands]
    made = symbols.mix(sums ^ label[owner])[filled]
    who = sets[owner][filled]
    some = np.bincount(owner[filled], minlength=len(sets))
    spare = some - np.array([join.difference(s) for s in n.tolist()])
    margin = np.full(len(sizes), 1 << 40, np.int64)
    np.minimum.at(margin, sets, spare)
    again = np.flatnonzero(spare <= 0).tolist()
    more = [signatures(values[starts[sets[i]]:starts[sets[i] + 1]], join, bands=[int(bands[i])], seed=1) for i in again]
    return (np.concatenate([made, *more]), np.concatenate([who, *[np.full(len(m), sets[i]) for m, i in zip(more, again)]]), margin)


def nodes_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identities of sets by content; equal sets are one node of the join."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols.mix(values))))
    return symbols.mix(sums[starts[1:]] - sums[starts[:-1]] + np.diff(starts).astype(np.uint64))


def sketch(found: np.ndarray) -> bytes:
    """Parities of the set's hashes in a power of two of bits, about two bits an element.

    Two sets' sketches, folded to one length, differ in at most as many bits as the sets differ in elements.
    """
    bits = min(1 << 20, max(256, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_difference(x: bytes, y: bytes) -> int:
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    fold = lambda v: np.bitwise_xor.reduce(v.reshape(-1, n), 0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def near_sketches(sketches: list[bytes], u: np.ndarray, v: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the pairs (u, v) whose sketches differ in at most ``most`` bits.

    Sketches folded to few bits rule out most pairs; those left are compared at twice the length, up to the shorter's own.
    """
    words = [np.frombuffer(x, np.uint64) for x in sketches]
    length = np.array([len(w) for w in words])
    keep, size = np.arange(len(u)), 4
    while len(keep):
        folded = np.stack([np.bitwise_xor.reduce(w.reshape(-1, min(size, len(w))), 0) if len(w) >= size else np.zeros(size, np.uint64) for w in words])
        fits = np.minimum(length[u[keep]], length[v[keep]]) >= size  # shorter sketches were compared whole before
        apart = np.zeros(len(keep), np.int64)
        step = max(1, (1 << 18) // size)
        for at in range(0, len(keep), step):
            part = keep[at:at + step]
            apart[at:at + step] = np.bitwise_count(folded[u[part]] ^ folded[v[part]]).sum(1)
        keep = keep[~fits | (apart <= most[keep])]
        if not fits.any():
            break
        size *= 2
    return keep


def set_rows(docs: DataFrame, join: Join) -> DataFrame:
    """``(key, th, n_shingles, margin, node, sketch)`` of every document; empty sets have no node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            values, starts = sets_of(piece, join.words)
            n = np.diff(starts)
            margin = batch_signatures(values, starts, join)[2]
            yield pa.RecordBatch.from_arrays([
                piece.rows.column("key"), piece.rows.column("th"), pa.array(n), pa.array(margin),
                pa.array(nodes_of(values, starts).view(np.int64), mask=n == 0),
                pa.array([sketch(values[lo:hi]) if hi > lo else None for lo, hi in zip(starts[:-1], starts[1:])], pa.binary())],
                ["key", "th", "n_shingles", "margin", "node", "sketch"])
    return docs.mapInArrow(run, "key long, th long, n_shingles long, margin long, node long, sketch binary")


def signature_rows(docs: DataFrame, join: Join, share: int = 0, shares: int = 1) -> DataFrame:
    """``(node, sig)`` of the signatures that fall into one of ``shares`` equal shares; equal sets of a piece sign once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            values, starts = sets_of(piece, join.words)
            nodes = nodes_of(values, starts)
            made, who, _ = batch_signatures(values, starts, join)
            first = np.zeros(len(nodes), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            keep = first[who] & (made % np.uint64(shares) == np.uint64(share))
            yield pa.RecordBatch.from_arrays([symbols.longs(nodes[who[keep]]), symbols.longs(made[keep])], ["node", "sig"])
    return docs.select("text").mapInArrow(run, "node long, sig long")


def likely_pairs(pairs: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """``pairs(u, v)`` without those that sizes or sketches rule out; nodes are (node, n_shingles, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_u", "n_v"))
            most = (n + m) * (100 - join.percent) // (100 + join.percent)
            keep = 100 * np.minimum(n, m) >= join.percent * np.maximum(n, m)
            for i in np.flatnonzero(keep):
                keep[i] = sketch_difference(batch.column("s_u")[i].as_py(), batch.column("s_v")[i].as_py()) <= most[i]
            yield batch.select(["u", "v"]).filter(pa.array(keep))
    named = lambda at: nodes.select(F.col("node").alias(at), F.col("n_shingles").alias(f"n_{at}"), F.col("sketch").alias(f"s_{at}"))
    return pairs.join(named("u"), "u").join(named("v"), "v").mapInArrow(run, "u long, v long")


def linked_pairs(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """Those of ``pairs(u, v)`` of nodes that link, compared exactly on the nodes' texts ``(node, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
            for piece in symbols.pieces(iter([batch]), column):
                values, starts = sets_of(piece, join.words)
                yield from (values[lo:hi] for lo, hi in zip(starts[:-1], starts[1:]))

        for batch in batches:
            keep = []
            for x, y in zip(sets(batch, "text_u"), sets(batch, "text_v")):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= join.percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    named = lambda at: texts.select(F.col("node").alias(at), F.col("text").alias(f"text_{at}"))
    return pairs.join(named("u"), "u").join(named("v"), "v").mapInArrow(run, "u long, v long")


def unresolved_pairs(members: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """Pairs ``(u, v)`` of members ``(sig, node, c)`` of one signature and different components that may still link.

    Signatures of at most ``CROWD`` members give all their pairs. A pair that shares only crowded signatures
    shares at least its margin of them, so both of its nodes have that many; of such nodes those outside a crowded
    signature's largest component are compared with all others, block by block, by size and sketch, and only pairs that pass are written.
    """
    load = members.groupBy("sig").agg(F.count(F.lit(1)).alias("g"))
    sized = staged(members.join(load, "sig"))
    few = sized.where(F.col("g") <= CROWD).select("sig", "node", "c")
    small = few.alias("x").join(few.alias("y"), "sig").where("x.node < y.node and x.c != y.c").select(
        F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    many = sized.where(F.col("g") > CROWD).drop("g")
    deep = many.groupBy("node").agg(F.count(F.lit(1)).alias("h")).join(nodes, "node").where("h >= margin").drop("h", "margin")
    left = staged(many.join(deep.select("node"), "node"))
    # members of a signature's largest component need no comparison with each other: only those outside it meet all
    held = left.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("n"))
    tops = held.groupBy("sig").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("g")).where("top.n < g").select(
        "sig", F.col("top.c").alias("top"), F.ceil((F.col("g") - F.col("top.n")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("g") / BLOCK).cast("int").alias("inner"))
    placed = left.join(tops, "sig").join(nodes.select("node", "n_shingles", "sketch"), "node")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("sig", "node", "c", "n_shingles", "sketch")
    outside = placed.where("c != top").withColumn("i", F.pmod("node", "outer").cast("int")).select(*kept, "i", every("inner").alias("j"))
    outside = outside.select(*[F.col(x).alias(x) for x in outside.columns])  # a table of its own beside the other one
    inside = placed.withColumn("j", F.pmod("node", "inner").cast("int")).select(*kept, "j", every("outer").alias("i"))

    def compare(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        (n, c, node), (m, d, mate) = ([f[x].to_numpy() for x in ("n_shingles", "c", "node")] for f in (one, other))
        close = 100 * np.minimum(n[:, None], m[None]) >= join.percent * np.maximum(n[:, None], m[None])
        u, v = np.nonzero(close & (c[:, None] != d[None]))
        keep = near_sketches([*one["sketch"], *other["sketch"]], u, v + len(n), (n[u] + m[v]) * (100 - join.percent) // (100 + join.percent))
        u, v = node[u[keep]], mate[v[keep]]
        return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    large = outside.groupBy("sig", "i", "j").cogroup(inside.groupBy("sig", "i", "j")).applyInPandas(compare, "u long, v long")
    return small.unionByName(large).distinct()


def classes(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``(key, th, n_shingles, component, linked)`` of every document (key, th, text).

    The component is the smallest key reachable by links, own key where there is none; keys may repeat, so ``linked``
    names the component by its smallest node (null for an empty set). Equal sets link without being paired. Each signature's members are first compared with its member that meets most others; where links leave members of
    one signature in different components, the pairs across components are compared (``unresolved_pairs``), so no
    link that joins two components is lost. A null or empty text has an empty set and stays alone; rows without an id come last.
    """
    base = staged(set_rows(docs, join))
    found = []
    for share in range(join.shares):  # one share of the signatures at a time is in shuffle files
        signs = staged(signature_rows(docs, join, share, join.shares))
        shared = signs.groupBy("sig").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("sig")
        found.append(staged(signs.join(shared, "sig")))
        discard(signs)
    members = staged(reduce(DataFrame.unionByName, found).distinct())
    discard(*found)
    sizes = staged(base.where("node is not null").select("node", "n_shingles", "margin", "sketch").dropDuplicates(["node"]))
    base = base.drop("sketch", "margin")
    crowd = members.groupBy("sig").agg(F.count(F.lit(1)).alias("g"))
    degree = members.join(crowd, "sig").groupBy("node").agg(F.sum("g").alias("degree"))
    hubs = members.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("top")).select("sig", F.col("top.node").alias("hub"))
    pairs = staged(members.join(hubs, "sig").where("node != hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    likely = staged(likely_pairs(pairs, sizes, join))
    tested = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    nodes = members.select("node").distinct()
    first = base.join(nodes, "node").groupBy("node").agg(F.min("key").alias("key"), F.min_by("th", "key").alias("th"))
    texts = staged(docs.join(first, ["key", "th"]).select("node", "text").dropDuplicates(["node"]))
    links = staged(linked_pairs(likely, texts, join))
    groups = components(links)
    at = members.join(groups, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("c"))
    split = at.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("sig")
    open_ = staged(at.join(split, "sig"))
    across = unresolved_pairs(open_, sizes, join)
    more = staged(linked_pairs(likely_pairs(across.join(tested, ["u", "v"], "left_anti"), sizes, join), texts, join))
    if more.limit(1).count():
        groups = components(links.unionByName(more))
    groups = staged(groups)
    named = base.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    least = named.where("node is not null").groupBy("c").agg(F.min("key").alias("component"))
    out = named.join(least, "c", "left").select(
        "key", "th", "n_shingles", F.coalesce("component", "key").alias("component"), F.col("c").alias("linked"))
    discard(members, pairs, sizes, likely, texts, links, open_, more)
    return out


def digests(docs: DataFrame, join: Join) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; a row without an id is in a component of no id if alone."""
    found = classes(keyed(docs), join)
    none = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return found.select(none("key").alias("doc_id"), "n_shingles", none("component").alias("component_id"))


def representatives(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents that stay: of each group of linked or equal texts the row with the smallest id, all columns as they are.

    Of rows with that id the smallest text hash stays, then any of equal rows. Different unlinked texts stay all,
    also where they share an id or have none; texts without words stay all.
    """
    least = classes(keyed(docs), join).where("linked is not null").groupBy("linked").agg(F.min(F.struct("key", "th")).alias("m"))
    found = least.select(F.col("m.key").alias("__key"), F.col("m.th").alias("__th"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.withColumn("__key", order_key()).withColumn("__th", F.xxhash64(text))
    full = marked.where(text.rlike(WORD)).groupBy("__key", "__th").agg(F.first(F.struct(*docs.columns)).alias("__row"))
    return full.join(found, ["__key", "__th"]).select("__row.*").unionByName(docs.where(~text.rlike(WORD)))
