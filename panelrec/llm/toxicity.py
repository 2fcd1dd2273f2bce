"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens (runs of ASCII letters, digits and bytes above 127, A-Z lower-cased) are hashed into ``BUCKETS`` counters, so
the model has one fixed size whatever the corpus. A token scores its log odds of standing in toxic text, under a
Dirichlet prior, less a drift; a passage is a maximal segment of high total score, found in linear time. Under
Karlin and Altschul's statistics a segment of score s in n clean tokens has E-value K n exp(-lambda s), which makes
texts of all lengths comparable; a logistic step turns the evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm import symbols
from panelrec.llm.common import staged

BITS = 18
BUCKETS = 1 << BITS
SAMPLE_PER_CLASS = 20_000
PRIOR_COUNT = 10.0
DRIFT = 0.5
E_LIMIT = 0.05
REPEAT_WITHIN = 256
_OUTSIDE = np.array([not (chr(i).isalnum() if i < 128 else True) for i in range(256)])


@dataclass(frozen=True)
class Model:
    """Token scores, extreme-value parameters and the logistic step (constant, tail evidence, passage evidence)."""

    scores: np.ndarray
    rate: float
    log_k: float
    weights: tuple[float, float, float]


def buckets(piece: symbols.Texts) -> tuple[np.ndarray, symbols.Words]:
    found = symbols.words(piece, _OUTSIDE)
    return (symbols.word_hashes(piece, found, lower=True) >> np.uint64(64 - BITS)).astype(np.int64), found


def values_of(piece: symbols.Texts, table: np.ndarray) -> tuple[np.ndarray, symbols.Words]:
    """Token scores of a piece in text order; a repeat of a token close by in one rise adds no evidence (``damped``)."""
    at, spans = buckets(piece)
    values = table[at]
    up = np.flatnonzero(values > 0)
    text = np.repeat(np.arange(piece.rows.num_rows), np.diff(spans.starts))[up]
    key = text * BUCKETS + at[up]
    order = np.argsort(key, kind="stable")
    again = (np.diff(key[order]) == 0) & (np.diff(up[order]) <= REPEAT_WITHIN)
    for i in np.unique(text[order[1:][again]]).tolist():
        lo, hi = spans.starts[i], spans.starts[i + 1]
        values[lo:hi] = damped(values[lo:hi], at[lo:hi])
    return values, spans


def damped(scores: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Scores of one text where a token said again at most ``REPEAT_WITHIN`` tokens later in the same rise adds only drift.

    A rise is a stretch over which the sum of scores stays above its start. When it has fallen back, every token counts
    in full again, so neither a stray mention nor an earlier passage takes evidence from a later one.
    """
    out = scores.copy()
    up = np.flatnonzero(scores > 0)
    falls = np.diff(np.concatenate(([0.0], np.cumsum(np.minimum(scores, 0.0))))[up], prepend=0.0)
    level, said = 0.0, {}
    for i, token, score, fall in zip(up.tolist(), tokens[up].tolist(), scores[up].tolist(), falls.tolist()):
        level += fall
        if level <= 0:
            level, said = 0.0, {}
        if i - said.get(token, -1 - REPEAT_WITHIN) <= REPEAT_WITHIN:
            out[i] = score = -DRIFT
        said[token] = i
        level += score
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a score sequence, in linear time (Ruzzo and Tompa)."""
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], positive.astype(np.int8), [0]))))
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    out: list[tuple[int, int, float, float]] = []
    for start, end in edges.reshape(-1, 2).tolist():
        low, high = float(sums[start]), float(sums[end])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j -= 1
            if j < 0 or out[j][3] >= high:
                out.append((start, end, low, high))
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
    return [(s, e, h - lo) for s, e, lo, h in out]


def evidence(scores: np.ndarray, rate: float, log_k: float) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Of one text: its best segment's tail evidence, its significant passages' summed evidence, and the passages."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    best = float((sums - np.minimum.accumulate(sums)).max())
    cost = log_k + np.log(max(1, len(scores)))
    tail = rate * best - cost
    limit = -np.log(E_LIMIT)
    if tail < limit:
        return tail, 0.0, []
    passages = [s for s in segments(scores) if rate * s[2] - cost >= limit]
    return tail, sum(rate * s[2] - cost for s in passages), passages


def training_rows(docs: DataFrame, labels: DataFrame, held_out: str) -> tuple[DataFrame, float]:
    """Labelled texts to learn from, at most ``SAMPLE_PER_CLASS`` of each class, and the log of the classes' odds.

    The rows are those of least hash of the id, so the choice does not depend on partitioning. Only their ids are
    broadcast (2 * SAMPLE_PER_CLASS rows at most).
    """
    known = labels.where(f"toxic in (0, 1) and doc_id is not null and not ({held_out})").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = staged(known)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(f"toxic = {c}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for c in (0, 1)]
    chosen = staged(parts[0].unionByName(parts[1]))
    taken = {c: min(SAMPLE_PER_CLASS, counts.get(c, 0)) for c in (0, 1)}
    shift = np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) - np.log(max(1, taken[1]) / max(1, taken[0]))
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), float(shift)


def token_scores(counts: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from counts (buckets x [clean, toxic]) under a Dirichlet prior at the class shares, less the drift."""
    total = counts.sum(0) + 1.0
    prior = PRIOR_COUNT * total / total.sum()
    return (np.log((counts[:, 1] + prior[1]) / (counts[:, 0] + prior[0])) - np.log(total[1] / total[0]) - DRIFT).astype(np.float64)


def tail_rate(scores: np.ndarray, clean: np.ndarray) -> float:
    """lambda: the positive root of sum p exp(lambda s) = 1 over the clean token distribution p."""
    p = (clean + 1e-9) / (clean + 1e-9).sum()
    low, high = 1e-3, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.log(p @ np.exp(np.minimum(mid * scores, 600))) < 0 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features(tail: np.ndarray, passages: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(tail)), np.clip(tail, -10, 30), np.log1p(passages)])


def fit(docs: DataFrame, labels: DataFrame, held_out: str = "false") -> Model:
    """Learn from the labelled rows of documents outside ``held_out`` (SQL over doc_id).

    Counts, lambda, K and the logistic step come from the same bounded sample of labelled rows. Without any labelled
    row of a class all texts score the same.
    """
    rows, shift = training_rows(docs, labels, held_out)
    rows = staged(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS)
        for piece in symbols.pieces(batches):
            found, spans = buckets(piece)
            text = np.repeat(np.arange(piece.rows.num_rows), np.diff(spans.starts))
            each = np.unique(text * BUCKETS + found)  # a text counts once for each of its tokens
            toxic = np.asarray(piece.rows.column("toxic"))[each // BUCKETS]
            total += np.bincount(each % BUCKETS * 2 + toxic, minlength=2 * BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["at", "n"])

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(2 * BUCKETS)
    counts[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    counts = counts.reshape(BUCKETS, 2)
    scores = token_scores(counts)
    rate = tail_rate(scores, counts[:, 0])
    table = docs.sparkSession.sparkContext.broadcast(scores)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            all_scores, spans = values_of(piece, table.value)
            out = []
            for lo, hi in zip(spans.starts[:-1], spans.starts[1:]):
                sums = np.concatenate(([0.0], np.cumsum(all_scores[lo:hi])))
                out.append(float((sums - np.minimum.accumulate(sums)).max()))
            n = np.maximum(1, np.diff(spans.starts))
            yield pa.RecordBatch.from_arrays([piece.rows.column("toxic"), pa.array(n), pa.array(out)], ["toxic", "n", "best"])

    clean = rows.where("toxic = 0").mapInArrow(best, "toxic int, n long, best double")
    # maximum likelihood of K given lambda: texts / sum of n exp(-lambda best)
    tail = clean.agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("n") * F.exp(-rate * F.col("best"))).alias("s")).first()
    log_k = float(np.log(max(1, tail["c"]) / max(1e-300, tail["s"] or 1.0)))
    start = Model(scores, rate, log_k, (0.0, 0.0, 0.0))
    seen = scored(rows, start).select("toxic", "tail", "passage_evidence").toPandas()
    weights = (-2.0, 0.0, 0.0)
    if seen["toxic"].nunique() == 2:
        w = logistic(features(seen["tail"].to_numpy(), seen["passage_evidence"].to_numpy()), seen["toxic"].to_numpy(float))
        weights = (float(w[0] + shift), float(w[1]), float(w[2]))
    return Model(scores, rate, log_k, weights)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score``, ``tail``, ``passage_evidence`` and ``passages`` (first token, end, score); other columns stay.

    Null and empty texts have no passage and get the score of no evidence. The score rises with the evidence.
    """
    table = docs.sparkSession.sparkContext.broadcast(model.scores)
    rate, log_k, weights = model.rate, model.log_k, np.array(model.weights)
    added = "score double, tail double, passage_evidence double, passages array<struct<start:int,end:int,score:double>>"
    names = ("score", "tail", "passage_evidence", "passages")
    kept = [c for c in docs.columns if c not in names]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            values, spans = values_of(piece, table.value)
            found = [evidence(values[lo:hi], rate, log_k) for lo, hi in zip(spans.starts[:-1], spans.starts[1:])]
            tail, mass = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            score = 1 / (1 + np.exp(-np.clip(features(tail, mass) @ weights, -500, 500)))
            passages = pa.array([[{"start": s, "end": e, "score": v} for s, e, v in x[2]] for x in found], kind)
            yield pa.RecordBatch.from_arrays(
                [*[piece.rows.column(c) for c in kept], pa.array(score), pa.array(tail), pa.array(mass), passages], [*kept, *names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return docs.select(*kept).mapInArrow(run, f"{fields}, {added}")


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: str = HELD_OUT) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` (1 where score >= threshold)."""
    model = fit(docs, labels, held_out)
    out = scored(docs, model).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
