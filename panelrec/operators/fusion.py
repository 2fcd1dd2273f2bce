"""Fusing and reranking two probability sets of the same row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelrec.functions import arrays as A


def blend(first: Column, second: Column, alpha: float) -> Column:
    """``alpha`` of the first plus the rest of the second."""
    return F.zip_with(first, second, lambda p, q: F.lit(1.0 - alpha) * q + F.lit(alpha) * p)


def fuse_linear(first: Column, second: Column, held: Column, alpha: float = 0.5, k: int = 7) -> Column:
    return A.unheld_topk(A.ranked_classes(blend(first, second, alpha)), held, k)


def fuse_logodds(first: Column, second: Column, held: Column, weight: float = 0.25, k: int = 7, eps: float = 1e-6) -> Column:
    """Log probabilities of the second plus weighted logs of the first, softmaxed."""
    logs = F.zip_with(first, second, lambda p, q: F.log(q + eps) + F.lit(weight) * F.log(p + eps))
    return A.unheld_topk(A.ranked_classes(A.softmax(logs)), held, k)


def _by_score(classes: Column, score) -> Column:
    pairs = F.transform(classes, lambda c: F.struct((-score(c)).alias("neg"), c.alias("cls")))
    return F.transform(F.array_sort(pairs), lambda s: s["cls"])


def fuse_rrf(first: Column, second: Column, held: Column, constant: int = 60, k: int = 7) -> Column:
    """Reciprocal rank fusion over all items; held ones leave after ranking."""
    def fused(orders: Column) -> Column:
        a, b = orders["a"], orders["b"]
        return _by_score(
            F.array_sort(a),
            lambda c: F.lit(1.0) / (constant + F.array_position(a, c))
            + F.lit(1.0) / (constant + F.array_position(b, c)),
        )

    both = F.struct(A.ranked_classes(first).alias("a"), A.ranked_classes(second).alias("b"))
    return A.unheld_topk(A.let(both, fused), held, k)


def fuse_two_stage(retriever: Column, reranker: Column, held: Column, m: int = 7, k: int = 7) -> Column:
    """The retriever's top ``m`` unheld items in reranker order, padded from the reranker."""
    def fused(s: Column) -> Column:
        picked = A.unheld_topk(s["a"], held, m)
        rest = A.unheld_topk(s["b"], held, 1_000_000)
        return A.let(
            picked,
            lambda chosen: F.slice(
                F.concat(
                    F.filter(rest, lambda c: F.array_contains(chosen, c)),
                    F.filter(rest, lambda c: ~F.array_contains(chosen, c)),
                ),
                1, k,
            ),
        )

    both = F.struct(A.ranked_classes(retriever).alias("a"), A.ranked_classes(reranker).alias("b"))
    return A.let(both, fused)
