"""Ranked lexical search in norm buckets: the highest-scoring rows of a table for each of a set of queries.

A document's vector holds one coordinate for each query term it has. Vectors are sorted by length, so that a task
sees buckets of ever shorter ones. For a query whose k-th best score so far is t, a bucket whose longest vector times
the query's own length stays below t is left out with all that follow it (Cauchy-Schwarz). Inside a bucket the
query's heaviest coordinates are added up and the rest of both vectors is bounded by the lengths that remain; only
documents whose bound reaches t are scored again, exactly, in 64-bit integers. Bounds carry a margin over the rounding
of doubles, so none that could reach t is left out; equal scores never are.

Scores are sums of products of a term's repeats in the query and its impact in the document. Both sides are scaled by
the square root of the term's weight, which leaves the products alone and makes lengths tell more.

Nulls: rows without text, with an empty one or without a term are no documents (they do not enter N or L) and rank
nowhere; rows without id rank after others of equal score; a query without text or term has no rows. Repeated rows of
documents each take a rank. Queries equal in id and text are one query. Texts of any length are read whole. An empty table
gives no rows. Columns other than the named ones do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelrec.llm.common import discard, staged

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BLOCK_BYTES = 4 << 20
BUCKET_ROWS = 4096
FIRST_ROWS = 4096
MARGIN = 1 + 1e-9


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


@dataclass
class Queries:
    """Queries of one block: for each its term numbers and their repeats, and each term's weight once it is known."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    weights: np.ndarray | None = None


@dataclass
class Scale:
    documents: int
    tokens: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        """m of a document of n terms."""
        return 100 - 25 + (25 * n * self.documents) // self.tokens


def blocks(queries: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Queries]:
    """Queries in blocks of about ``block_bytes`` of text; a block's queries and terms are what tasks are sent."""
    table = staged(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct())
    total = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for part in range(count):
        rows = table.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == part).collect()
        found = [(r.id, Counter(terms_of(r.text))) for r in rows]
        found = [(i, c) for i, c in found if c]
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in found for t in c}))}
        if found:
            yield Queries([i for i, _ in found], vocabulary, [np.array([vocabulary[t] for t in c], np.int32) for _, c in found],
                          [np.array(list(c.values()), np.int64) for _, c in found])
    discard(table)


def profiles(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, terms, tfs)``: terms with repeats, and how often each query term occurs; rows without a term left out."""
    known = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            keep, n, terms, tfs = [], [], [], []
            for i in range(batch.num_rows):
                counts = Counter(terms_of(texts[i].as_py()))
                if not counts:
                    continue
                held = counts.keys() & numbers.keys()
                keep.append(i)
                n.append(counts.total())
                terms.append([numbers[t] for t in held])
                tfs.append([counts[t] for t in held])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(profile, "doc_id long, n long, terms array<int>, tfs array<int>")


def weigh(table: DataFrame, queries: Queries) -> Scale | None:
    """Set the weights of the queries' terms from document frequencies; N and L, or None without documents."""
    whole = table.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    if not whole.n:
        return None
    frequency = np.zeros(len(queries.vocabulary), np.int64)
    for term, df in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
        frequency[term] = df
    queries.weights = np.array([math.floor(1000 * math.log((2 * whole.n + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    return Scale(whole.n, whole.l)


@dataclass
class Vectors:
    """A bucket or batch: rows' ids, where their coordinates start, and terms and impacts of the coordinates."""

    ids: np.ndarray
    unknown: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray


def vectors(batch: pa.RecordBatch, weights: np.ndarray, scale: Scale) -> Vectors:
    names = batch.schema.names
    lists = batch.column(names.index("terms"))
    terms = np.asarray(lists.flatten())
    starts = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    tfs = np.asarray(batch.column(names.index("tfs")).flatten()).astype(np.int64)
    m = np.repeat(scale.damping(np.asarray(batch.column(names.index("n")))), np.diff(starts))
    ids = batch.column(names.index("doc_id"))
    return Vectors(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), starts, terms,
                   weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m)))


def with_lengths(table: DataFrame, queries: Queries, scale: Scale) -> DataFrame:
    """Profiles that have a query term, with the length of their vector, longest first through all partitions.

    One range shuffle; vectors of one length, such as those of copies, are split by where they lie in the input.
    """
    weights = table.sparkSession.sparkContext.broadcast(queries.weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = vectors(batch, weights.value, scale)
                squares = np.concatenate(([0.0], np.cumsum(v.impacts.astype(float) ** 2 / np.maximum(weights.value[v.terms], 1))))
                # a difference of running sums loses bits of the largest sum: lengths grow by that much
                slack = squares[-1] * 1e-15 * len(squares)
                yield batch.append_column("length", pa.array(np.sqrt(np.diff(squares[v.starts]) + slack)))

    kept = table.where(F.size("terms") > 0)
    sized = kept.mapInArrow(measure, "doc_id long, n long, terms array<int>, tfs array<int>, length double")
    keys = [F.desc("length"), F.col("__tie")]
    return sized.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")


@dataclass
class Best:
    """The k best of one query so far: score, id, whether the id is null."""

    score: np.ndarray
    ids: np.ndarray
    unknown: np.ndarray

    def add(self, score: np.ndarray, ids: np.ndarray, unknown: np.ndarray, k: int) -> None:
        score, ids, unknown = (np.concatenate(x) for x in ((self.score, score), (self.ids, ids), (self.unknown, unknown)))
        order = np.lexsort((ids, unknown, -score))[:k]
        self.score, self.ids, self.unknown = score[order], ids[order], unknown[order]


def search(bucket: Vectors, lengths: np.ndarray, queries: Queries, best: list[Best], floor: np.ndarray, open_: np.ndarray, k: int) -> None:
    """Put a bucket's documents that belong there into the queries' best lists; close queries that no later bucket can serve."""
    order = np.argsort(bucket.terms, kind="stable")
    ends = np.cumsum(np.bincount(bucket.terms, minlength=len(queries.weights)))
    row_of = np.repeat(np.arange(len(bucket.ids)), np.diff(bucket.starts))[order]
    root = np.sqrt(np.maximum(queries.weights, 1))
    coordinate = (bucket.impacts / root[bucket.terms])[order]
    longest = lengths.max()
    dense = np.zeros(len(queries.weights), np.int64)
    for q in np.flatnonzero(open_):
        terms, repeats, mine = queries.terms[q], queries.repeats[q], best[q]
        need = max(floor[q], mine.score[k - 1] if len(mine.score) == k else 1)
        values = repeats * root[terms]
        if np.sqrt((values ** 2).sum()) * longest * MARGIN < need:
            open_[q] = False  # later buckets are shorter still
            continue
        heaviest = np.argsort(-values, kind="stable")
        rest = np.sqrt(np.append(np.cumsum(values[heaviest][::-1] ** 2)[::-1], 0.0))  # length of the query after its first i coordinates
        sums, taken = np.zeros(len(bucket.ids)), np.zeros(len(bucket.ids))
        left = 0.0
        for i, at in enumerate(heaviest):
            left = rest[i]
            if left * longest < need / 2:
                break
            t = terms[at]
            span = slice(ends[t - 1] if t else 0, ends[t])
            rows, value = row_of[span], coordinate[span]
            sums[rows] += values[at] * value
            taken[rows] += value * value
            left = rest[i + 1]
        bound = sums + left * np.sqrt(np.maximum(lengths * lengths * MARGIN - taken, 0))
        alive = np.flatnonzero((bound * MARGIN >= need))
        if not len(alive):
            continue
        dense[terms] = repeats
        begin, n = bucket.starts[alive], np.diff(bucket.starts)[alive]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.add.reduceat(dense[bucket.terms[at]] * bucket.impacts[at], np.cumsum(n) - n)
        dense[terms] = 0
        good = score >= need
        if good.any():
            mine.add(score[good], bucket.ids[alive[good]], bucket.unknown[alive[good]], k)


def best_of(table: DataFrame, queries: Queries, scale: Scale, floor: np.ndarray, k: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(query, score, doc_id)``: each partition's k best of every query with a score of at least its floor."""
    sent = table.sparkSession.sparkContext.broadcast((queries, floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floor = sent.value
        empty = np.zeros(0, np.int64)
        best = [Best(empty, empty, empty.astype(bool)) for _ in queries.ids]
        open_ = np.ones(len(best), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, bucket_rows):
                part = batch.slice(at, bucket_rows)
                search(vectors(part, queries.weights, scale), np.asarray(part.column(part.schema.names.index("length"))), queries, best, floor, open_, k)
            if not open_.any():
                break
        for q, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b.score), q, np.int32)), pa.array(b.score), pa.array(b.ids, mask=b.unknown)], names=["query", "score", "doc_id"])

    return table.mapInArrow(run, "query int, score long, doc_id long")


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text",
           query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_rows: int = BUCKET_ROWS,
           first_rows: int = FIRST_ROWS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents with a score above 0 for each query; staged.

    The ``first_rows`` longest vectors are searched first; the k-th score each query finds there is a floor for the whole
    search. It only saves work: every document is still bounded or scored.
    """
    spark, out = docs.sparkSession, None
    for block in blocks(queries, query_id, query_text, block_bytes):
        table = staged(profiles(docs, block, doc_id, doc_text))
        scale = weigh(table, block)
        if scale is None:
            discard(table)
            continue
        sized = staged(with_lengths(table, block, scale))
        discard(table)
        floor = np.ones(len(block.ids), np.int64)
        first = sized.orderBy(F.desc("length")).limit(first_rows)
        for row in _top(best_of(first, block, scale, floor, k, bucket_rows), k).where(F.col("rank") == k).collect():  # at most one a query
            floor[row.query] = row.score
        found = _top(best_of(sized, block, scale, floor, k, bucket_rows), k)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(block.ids)], "query int, item_id long")
        part = staged(found.join(names, "query").select("item_id", "rank", "doc_id", "score"))
        discard(sized)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
