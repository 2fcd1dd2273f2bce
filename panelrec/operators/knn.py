"""Exact nearest context rows per query row, and voting on their labels.

Both sides are dealt into blocks by row number, whatever their keys, and every pair of a query block and a context block
meets in one task as two matrices: query blocks are repeated for each context block and the other way round, in
one shuffle. A task returns k rows per query, which an aggregation merges, so no pair of rows is ever a row of
a table and neither side passes the driver. Blocks of small tables are smaller, so that all cores get pairs, and a task holds
two blocks and the scores of one strip of queries, whatever the size of the tables.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.session import staged

#: Rows of a block: two blocks of 64 doubles a row and their Arrow copies take about 50 MB of a task.
BLOCK_ROWS = 20_000
#: Rows of a block below which a small table is not cut further to busy all cores.
LEAST_ROWS = 1_000
#: Cells of a strip's score matrix: 8 MB of doubles, held twice.
STRIP_CELLS = 1 << 20


def _dealt(table: DataFrame, key: str, vector: str, block_rows: int) -> tuple[DataFrame, int]:
    """``(row, id, v, block)`` of the rows that have a vector, and the number of blocks; staged, so that row numbers stay."""
    rows = staged(table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    n = rows.count()
    busy = math.isqrt(2 * table.sparkSession.sparkContext.defaultParallelism) + 1  # squared, two pairs a core
    blocks = max(1, -(-n // block_rows), min(busy, n // LEAST_ROWS))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return numbered.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")), blocks


def _matrix(table: pa.Table) -> np.ndarray:
    return np.asarray(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1)


def _nearest(queries: np.ndarray, matrix: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int, metric: str, apart: bool):
    """Yield per query the positions and exact scores of its k best rows, ties by id; ``apart`` leaves out rows of its own id.

    The product ranks roughly, for ``l2`` around the block's mean, so that a common offset cancels before
    squaring; every row within rounding of the k-th, measured by the norms that went into the product, is scored again.
    Only a strip of the product exists at a time.
    """
    place = np.unique(ids, return_inverse=True)[1]
    if metric == "l2":
        middle = matrix.mean(0)
        right = matrix - middle
        b = np.einsum("ij,ij->i", right, right)
        # centring itself rounds by the size of the original coordinates
        shift = np.abs(middle).max() * np.sqrt(matrix.shape[1])
    else:
        right, longest = matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix).max())
    kth = min(k, len(matrix)) - 1
    step = max(1, STRIP_CELLS // len(matrix))
    for start in range(0, len(queries), step):
        strip = queries[start:start + step]
        if metric == "l2":
            left = strip - middle
            rough = left @ right.T
            rough *= -2.0
            rough += b  # the query's own norm ranks nothing
            a = np.einsum("ij,ij->i", left, left)
            scale = a + b.max() + shift * (np.sqrt(a) + np.sqrt(b.max()))
        else:
            rough = strip @ right.T
            np.negative(rough, out=rough)
            scale = np.sqrt(np.einsum("ij,ij->i", strip, strip)) * longest
        slack = 8.0 * (matrix.shape[1] + 4) * np.finfo(np.float64).eps * scale
        if apart:
            rough[names[start:start + step][:, None] == ids[None, :]] = np.inf
        limit = np.partition(rough, kth, axis=1)[:, kth] + 2.0 * slack
        for query, row, most in zip(strip, rough, limit):
            near = np.flatnonzero(row <= most)
            near = near[np.isfinite(row[near])]
            if metric == "l2":
                score = ((matrix[near] - query) ** 2).sum(1)
            else:
                score = -(matrix[near] * query).sum(1)
            order = np.lexsort((place[near], score))[:k]
            yield near[order], score[order]


def nearest(
    queries: DataFrame,
    context: DataFrame,
    k: int,
    key: str = "row_id",
    vector: str = "vector",
    metric: str = "l2",
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, rank, context_id, distance) of the k nearest context rows of each query.

    ``l2`` gives squared distances, ``ip`` negated inner products; ties by context id. Rows without a vector
    neither ask nor answer; equal keys are rows of their own on both sides, and ``exclude_self`` leaves out all context rows
    of the query's key. An empty side gives no rows.
    """
    kind = dict(queries.dtypes)[key]
    left, left_blocks = _dealt(queries, key, vector, block_rows)
    right, right_blocks = _dealt(context, key, vector, block_rows)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    asked = left.select("row", "id", "v", F.col("block").alias("a"), every(right_blocks).alias("b"))
    given = right.select("id", "v", F.col("block").alias("b"), every(left_blocks).alias("a"))

    def product(q: pa.Table, c: pa.Table) -> pa.Table:
        rows, distance, taken = [], [], []
        if q.num_rows and c.num_rows:
            found = _nearest(_matrix(q), _matrix(c), q["id"].to_numpy(), c["id"].to_numpy(), k, metric, exclude_self)
            for i, (near, score) in enumerate(found):
                rows.append(np.full(len(near), i))
                taken.append(near)
                distance.append(score)
        at = np.concatenate(rows) if rows else np.zeros(0, int)
        picked = np.concatenate(taken) if taken else np.zeros(0, int)
        return pa.table({
            "row": q["row"].take(pa.array(at)), "q": q["id"].take(pa.array(at)), "context_id": c["id"].take(pa.array(picked)),
            "distance": pa.array(np.concatenate(distance) if distance else np.zeros(0)),
        })

    # pairs are few and heavy: they are not merged by their bytes, and few share a partition
    pairs = left_blocks * right_blocks
    parts = max(pairs, min(4 * pairs, 256), int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked, given = asked.repartition(parts, "a", "b"), given.repartition(parts, "a", "b")
    found = asked.groupBy("a", "b").cogroup(given.groupBy("a", "b")).applyInArrow(
        product, f"row long, q {kind}, context_id {kind}, distance double")
    # A query gets at most k rows per context block, so its group is bounded.
    best = found.groupBy("row", "q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "context_id"))), 1, k).alias("best")
    )
    return best.select(F.col("q").alias(key), F.posexplode("best").alias("rank", "_b")).select(
        key, F.col("rank").cast("int").alias("rank"),
        F.col("_b.context_id").alias("context_id"), F.col("_b.distance").alias("distance"),
    )


def knn_class_probs(
    neighbours: DataFrame, labels: DataFrame, n_classes: int, key: str = "row_id", smoothing: float = 1e-3
) -> DataFrame:
    """Class probabilities from neighbours' labels weighted by exp(-distance).

    ``labels`` holds (context_id, label), one row per id, and ``neighbours`` queries of different keys. Every class gets
    ``smoothing`` weight.
    """
    votes = neighbours.join(labels, "context_id").groupBy(key).agg(
        *[
            F.sum(F.when(F.col("label") == c, F.exp(-F.col("distance"))).otherwise(0.0)).alias(f"_w{c}")
            for c in range(n_classes)
        ]
    )
    weights = F.array(*[F.col(f"_w{c}") + smoothing for c in range(n_classes)])
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return votes.select(key, weights.alias("_w"), total.alias("_t")).select(
        key, F.transform("_w", lambda w: w / F.col("_t")).alias("probs")
    )
