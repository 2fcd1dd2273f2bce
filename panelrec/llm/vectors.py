"""Embedding near-duplicates by an inverted multi-index.

Vectors of unit length are cut in halves; independent codebooks on the halves form a product grid of cells. A vector
lies in one cell and visits the cells nearest to it in multi-sequence order (by the sum of its halves' distances),
as many as reach the target recall on a sample. What it meets is verified by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm.common import NO_ID, components, discard, order_key, staged

SAMPLE = 10_000
SAMPLE_FLOATS = 5_000_000
ROWS_PER_CELL = 256
MOST_CODES = 512
BLOCK = 1024
QUERIES = 400


@dataclass(frozen=True)
class Grid:
    """Codebooks of the two halves and the number of cells each vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        far = lambda x, c: (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]
        return far(unit[:, :cut], self.first), far(unit[:, cut:], self.second)

    def visited(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` nearest cells of each vector, nearest first.

        The i-th nearest code of one half with the j-th of the other can be among the first ``count`` sums only if
        (i + 1) (j + 1) <= count, so the traversal looks at those pairs alone.
        """
        one, two = self.distances(unit)
        a, b = np.argsort(one, 1, kind="stable"), np.argsort(two, 1, kind="stable")
        i, j = np.meshgrid(np.arange(a.shape[1]), np.arange(b.shape[1]), indexing="ij")
        near = (i + 1) * (j + 1) <= count
        i, j = i[near], j[near]
        rows = np.arange(len(unit))[:, None]
        total = one[rows, a[:, i]] + two[rows, b[:, j]]
        order = np.argsort(total, 1, kind="stable")[:, :count]
        return (a[:, i] * len(self.second) + b[:, j])[rows, order]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's means from evenly spaced start rows; an empty code keeps its place."""
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((codes * codes).sum(1)[None] - 2 * x @ codes.T, 1)
        count = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], k)
            codes[:, d] = np.where(count > 0, total / np.maximum(count, 1), codes[:, d])
    return codes


def fit_grid(sample: np.ndarray, n: int, cosine: float, recall: float) -> Grid:
    """Codebooks of about sqrt(n / ROWS_PER_CELL) codes a half, and the visits that reach ``recall``.

    Visits are counted on vectors of the sample against neighbours at the least similarity that links, made by turning
    them in random directions, and against their true neighbours in the sample. Nearer pairs are met more often. The
    codebooks do not learn from those vectors, which would lie nearer to their codes than others do.
    """
    unit = unit_rows(sample)
    asked = np.linspace(0, len(unit) - 1, min(QUERIES, max(1, len(unit) // 5))).astype(int)
    q, learn = unit[asked], np.delete(unit, asked, 0) if len(unit) > 1 else unit
    k = int(min(MOST_CODES, len(learn), max(1, round((n / ROWS_PER_CELL) ** 0.5))))
    cut = max(1, unit.shape[1] // 2)
    second = learn[:, cut:] if unit.shape[1] > 1 else np.zeros((len(learn), 1))
    grid = Grid(codebook(learn[:, :cut], k), codebook(second, k) if unit.shape[1] > 1 else np.zeros((1, 0)), 1)
    rng = np.random.default_rng(5)
    turn = rng.normal(size=q.shape)
    turn -= (turn * q).sum(1, keepdims=True) * q
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    near = cosine * q + np.sqrt(1 - cosine * cosine) * turn
    all_cells = len(grid.first) * len(grid.second)
    # either of the two may meet the other
    ranks = np.minimum(_ranks(grid, q, near, all_cells), _ranks(grid, near, q, all_cells))
    visits = int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
    sims = q @ unit.T
    a, b = np.nonzero((sims >= cosine) & (sims < 1 - 1e-12))
    if len(a):
        some = slice(0, 2000)
        true = np.minimum(_ranks(grid, q[a[some]], unit[b[some]], all_cells), _ranks(grid, unit[b[some]], q[a[some]], all_cells))
        visits = max(visits, int(np.sort(true)[int(np.ceil(0.999 * len(true))) - 1]) + 1)
    return Grid(grid.first, grid.second, min(visits, all_cells))


def _ranks(grid: Grid, x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Place of y's cell in the traversal of x."""
    one, two = grid.distances(x)
    own = grid.visited(y, 1)[:, 0]
    i, j = own // len(grid.second), own % len(grid.second)
    rows = np.arange(len(x))
    mine = one[rows, i] + two[rows, j]
    return ((one[:, :, None] + two[:, None, :]) < mine[:, None, None]).reshape(len(x), -1).sum(1)


def valid(column: str = "embedding"):
    v = F.col(column)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def near_duplicates(table: DataFrame, cosine: float = 0.9, recall: float = 0.97, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every vector.

    Links are pairs with cosine >= ``cosine`` in double precision, of equal length only. Vectors that are null, empty,
    zero or have null or non-finite components link with nothing. Equal vectors are searched once and counted as often
    as they come, rows of one id included; rows without an id are in no component of an id unless they link. The
    grid is fitted on at most ``SAMPLE`` distinct vectors (``SAMPLE_FLOATS`` numbers) of each length.
    """
    base = table.select(order_key(id_col).alias("key"), F.col(column).cast("array<double>").alias("v")).withColumn("ok", valid("v"))
    base = base.withColumn("node", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("node2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")))
    distinct = staged(base.where("ok").groupBy("node", "node2").agg(F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")).withColumn("dim", F.size("v")))
    grids = {}
    for row in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():
        some = distinct.where(F.col("dim") == row["dim"]).orderBy("node").limit(min(SAMPLE, max(2, SAMPLE_FLOATS // row["dim"]))).select("v").toPandas()
        grids[row["dim"]] = fit_grid(np.stack(some["v"].to_numpy()).astype(np.float64), row["n"], cosine, recall)
    held = table.sparkSession.sparkContext.broadcast(grids)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 2000):
                part = whole.iloc[start:start + 2000]
                for dim, frame in part.groupby("dim"):
                    unit = unit_rows(np.stack(frame["v"].to_numpy()).astype(np.float64))
                    grid = held.value[dim]
                    cells = grid.visited(unit, grid.visits)
                    yield pd.DataFrame({"node": frame["node"].to_numpy(), "copies": frame["copies"].to_numpy(), "dim": dim,
                                        "cell": cells[:, 0], "cells": list(cells.astype(np.int32)), "v": list(frame["v"])})

    placed = staged(distinct.drop("node2").mapInPandas(place, "node long, copies long, dim int, cell int, cells array<int>, v array<double>"))
    probes = placed.select("node", "copies", "dim", "v", F.col("cell").alias("own"), F.explode("cells").alias("cell"))
    members = placed.select("node", "copies", "dim", "v", "cell", "cells")
    loads = members.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("m")).join(
        probes.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK)).cast("int").alias("q")), ["dim", "cell"])
    loads = staged(loads)
    # blocks of members meet blocks of visitors: a cell of any size is many groups of bounded size
    left = probes.join(loads, ["dim", "cell"]).withColumn("qb", F.pmod("node", "q").cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    right = members.join(loads, ["dim", "cell"]).withColumn("mb", F.pmod("node", "m").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    keys = ["dim", "cell", "qb", "mb"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)

    def verify(q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        if not len(q) or not len(m):
            return empty
        x, y = (unit_rows(np.stack(f["v"].to_numpy()).astype(np.float64)) for f in (q, m))
        xn, yn = q["node"].to_numpy(), m["node"].to_numpy()
        near = (x @ y.T >= cosine) & (xn[:, None] != yn[None])
        if not near.any():
            return empty
        mine = near @ m["copies"].to_numpy()
        # a member that does not visit the other's own cell will not meet it again: count it from here
        visits = [set(c) for c in m["cells"]]
        own = q["own"].to_numpy()
        a, b = np.nonzero(near)
        back = np.fromiter((own[i] not in visits[j] for i, j in zip(a, b)), bool, len(a))
        theirs = np.bincount(b[back], q["copies"].to_numpy()[a[back]], len(m)).astype(np.int64)
        label_x, label_y = xn.copy(), yn.copy()
        big = np.iinfo(np.int64).max
        while True:
            new_y = np.minimum(label_y, np.where(near, label_x[:, None], big).min(0))
            new_x = np.minimum(label_x, np.where(near, new_y[None], big).min(1))
            if (new_x == label_x).all() and (new_y == label_y).all():
                break
            label_x, label_y = new_x, new_y
        hx, hy = near.any(1), near.any(0)
        return pd.DataFrame({"u": np.concatenate((xn[hx], yn[hy])), "v": np.concatenate((label_x[hx], label_y[hy])),
                             "links": np.concatenate((mine[hx], theirs[hy])).astype(np.int64)})

    found = staged(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        verify, "u long, v long, links long"))
    groups = components(found.select("u", "v"))
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    facts = distinct.select("node", "copies").join(counts, "node", "left").join(groups, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("c"))
    named = base.select("key", "node").join(facts, "node", "left")
    least = named.where("node is not null").groupBy("c").agg(F.min("key").alias("least"))
    out = named.join(least, "c", "left").withColumn("least", F.coalesce("least", "key"))
    none = lambda c: F.expr(f"nullif({c}, {NO_ID})")
    return out.select(none("key").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      none("least").alias("component_id"), (F.col("key") == F.col("least")).alias("kept"))
