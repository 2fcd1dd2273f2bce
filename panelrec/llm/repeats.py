"""Windows of a fixed length that repeat across documents, found through compacted paths.

Windows (edges of the de Bruijn graph of the corpus) are compacted inside each document into paths: runs of windows
with one minimizer. Only paths, about 2 / (length - k + 2) of all windows, are shuffled.

1. Anchors (minimizers) are aggregated; those of one document alone are dropped, and the paths of the others kept.
2. Where all paths of an anchor are equal, the anchor's counts are the path's counts.
3. Where an anchor has different paths (a passage begins or ends there, or a copy was edited), the distinct paths are
   opened into windows, read again from the documents by their coordinates, and windows are aggregated, an equal part of
   the anchors at a time, which bounds the disk.

Hot passages are aggregated before they are shuffled. Adaptive execution splits the join of paths with anchors at a hot anchor;
the joins by path, two in one stage, it does not split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm import symbols
from panelrec.llm.common import discard, staged

#: Rounds in which the windows of differing paths are counted; all paths of an anchor are in one.
PASSES = 2


@dataclass(frozen=True)
class Rule:
    """Windows of ``length`` symbols (``word`` or ``byte``), minimizers of ``k``.

    ``earlier``: a window counts where it also starts in a document with a smaller key; else where it starts twice
    or more anywhere.
    """

    unit: str
    length: int
    k: int
    earlier: bool

    @property
    def keep(self) -> str:
        return "low < high" if self.earlier else "copies > 1"

    @property
    def hit(self) -> str:
        return "low < key" if self.earlier else "copies > 1"


def path_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(key, th, start, n, a, p)``: the paths of every document; docs are (key, th, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            values, starts = symbols.units(piece, rule.unit)
            found = symbols.paths(values, starts, rule.length, rule.k)
            rows = pa.array(found.text.astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                piece.rows.column("key").take(rows), piece.rows.column("th").take(rows),
                pa.array(found.start.astype(np.int32)), pa.array(found.n.astype(np.int32)),
                symbols.longs(found.anchor), symbols.longs(found.content)], ["key", "th", "start", "n", "a", "p"])
    return docs.mapInArrow(run, "key long, th long, start int, n int, a long, p long")


def window_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(a, p, j, w, low, copies)``: the j-th window hash of each wanted path, with the path's counts.

    docs carry ``want``, an array of (start, n, a, p, copies); the document's key is the path's least key.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            values, starts = symbols.units(piece, rule.unit)
            sums = symbols.prefix(values)
            want = piece.rows.column("want")
            each = want.flatten()
            text = np.repeat(np.arange(len(want)), np.asarray(want.value_lengths()))
            start, n = each.field("start").to_numpy(), each.field("n").to_numpy().astype(np.int64)
            path = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            at = starts[text[path]] + start[path] + j
            take = pa.array(path)
            hashes = symbols.span_hash(sums, at, at + rule.length)
            yield pa.RecordBatch.from_arrays(
                [each.field("a").take(take), each.field("p").take(take), pa.array(j.astype(np.int32)), symbols.longs(hashes),
                 piece.rows.column("key").take(pa.array(text[path])), each.field("copies").take(take)],
                ["a", "p", "j", "w", "low", "copies"])
    return docs.mapInArrow(run, "a long, p long, j int, w long, low long, copies long")


def repeated_anchors(rows: DataFrame, rule: Rule) -> DataFrame:
    """``(a, low, copies, mixed)`` of the anchors of paths that may repeat; mixed: the anchor has different paths."""
    anchors = rows.groupBy("a").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("copies"),
        F.min("p").alias("p_low"), F.max("p").alias("p_high")).where(rule.keep)
    return anchors.select("a", "low", "copies", (F.col("p_low") != F.col("p_high")).alias("mixed"))


def with_anchors(rows: DataFrame, anchors: DataFrame, rule: Rule) -> DataFrame:
    """The paths whose anchor is mixed or repeats them, with the anchor's columns.

    Adaptive execution splits a hot anchor only where the join reads both shuffles directly, so anchors come staged: an
    aggregate in the join's own stage leaves all paths of an anchor to one task, whatever their size.
    """
    return rows.join(anchors, "a").where(f"mixed or ({rule.hit})")


def repeated_spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(key, th, spans)`` of the documents that have some: spans (start, end) in symbols that repeated windows cover.

    docs are (key, th, text), one row for each (key, th) or equal rows; equal rows count once where ``rule.earlier``.
    """
    rows = path_rows(docs, rule)
    anchors = staged(repeated_anchors(rows, rule))
    kept = with_anchors(rows, anchors, rule)
    hits = staged(kept.select("key", "th", "start", "n", "mixed", *[F.when(F.col("mixed"), F.col(c)).alias(c) for c in ("a", "p")]))
    mixed = hits.where("mixed")
    paths = staged(mixed.groupBy("a", "p").agg(
        F.min("key").alias("low"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")))
    # one place where each distinct path can be read: in its first document
    places = mixed.select("a", "p", "key", "th", "start", "n").join(paths.select("a", "p", "low", "copies"), ["a", "p"]).where("key = low")
    first = places.groupBy("a", "p", "n", "copies").agg(F.min("key").alias("key"), F.min("th").alias("th0")).join(
        places.select("a", "p", F.col("th").alias("th0"), "start"), ["a", "p", "th0"]).groupBy("a", "p", "n", "copies", "key", "th0").agg(
        F.min("start").alias("start"))
    first = staged(first)
    better = "w_low < low" if rule.earlier else "w_copies > 1 and copies = 1"
    passes = []
    # anchors are settled in passes, so that the windows of one pass alone lie in shuffles; each window is made and written once
    for number in range(PASSES):
        some = first.where(F.pmod("a", F.lit(PASSES)) == number)
        wanted = some.groupBy("key", F.col("th0").alias("th")).agg(F.collect_list(F.struct("start", "n", "a", "p", "copies")).alias("want"))
        # each window carries its path's counts, so that no join back to the paths moves all windows once more
        counted = staged(window_rows(docs.join(wanted, ["key", "th"]), rule))
        sums = counted.groupBy("a", "w").agg(F.min("low").alias("w_low"), F.sum("copies").alias("w_copies"))
        passes.append(staged(counted.join(sums, ["a", "w"]).where(better).groupBy("a", "p").agg(
            F.collect_list(F.struct("j", F.col("w_low").alias("low"), F.col("w_copies").alias("copies"))).alias("open"))))
        discard(counted)
    opens = reduce(DataFrame.unionByName, passes)
    span = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))
    whole = hits.where("not mixed").select(
        "key", "th", span(F.col("start"), F.col("start") + F.col("n") + rule.length - 1).alias("span"))
    own = mixed.select("a", "p", "key", "th", "start", "n").join(paths.drop("n"), ["a", "p"])
    path_hit = own.where(rule.hit).select("key", "th", span(F.col("start"), F.col("start") + F.col("n") + rule.length - 1).alias("span"))
    rest = own.where(f"not ({rule.hit})").select("a", "p", "key", "th", "start").join(opens, ["a", "p"])
    window_hit = rest.select("key", "th", "start", F.explode("open").alias("o")).select(
        "key", "th", "start", F.col("o.j").alias("j"), F.col("o.low").alias("low"), F.col("o.copies").alias("copies")).where(rule.hit).select(
        "key", "th", span(F.col("start") + F.col("j"), F.col("start") + F.col("j") + rule.length).alias("span"))
    found = staged(whole.unionByName(path_hit).unionByName(window_hit).groupBy("key", "th").agg(F.collect_list("span").alias("spans")))
    discard(anchors, hits, paths, first, *passes)
    return found


def covered(spans: pa.ListArray, starts: np.ndarray) -> np.ndarray:
    """Which symbols of a piece its spans cover; spans count from each text's first symbol."""
    each = spans.flatten()
    text = np.repeat(np.arange(len(spans)), np.nan_to_num(np.asarray(spans.value_lengths().fill_null(0))).astype(np.int64))
    change = np.zeros(int(starts[-1]) + 1, np.int32)
    if len(each):
        np.add.at(change, starts[text] + each.field("start").to_numpy(), 1)
        np.add.at(change, starts[text] + each.field("end").to_numpy(), -1)
    return np.cumsum(change)[:-1] > 0
