"""Row-wise array expressions: probabilities, rankings, lists and vectors.

Each function returns a Column over one row's arrays, so none of them shuffles.
Arrays are as long as the item catalog or the feature list, never as the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    """Softmax with the maximum subtracted first."""
    return let(
        F.array_max(logits),
        lambda top: let(
            F.transform(logits, lambda z: F.exp(z - top)),
            lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)),
        ),
    )


def log_softmax(logits: Column) -> Column:
    return let(
        F.array_max(logits),
        lambda top: let(
            F.log(total(F.transform(logits, lambda z: F.exp(z - top)))),
            lambda log_sum: F.transform(logits, lambda z: z - top - log_sum),
        ),
    )


def tempered(logits: Column, temperature: float) -> Column:
    return softmax(F.transform(logits, lambda z: z / F.lit(float(temperature))))


def argmax(values: Column) -> Column:
    """Zero-based index of the maximum; the lowest index wins a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def item_probs(probs: Column) -> Column:
    """Probabilities of classes 1..n without the hold class 0."""
    return F.slice(probs, 2, F.greatest(F.size(probs) - 1, F.lit(0)))


def ranked_classes(probs: Column) -> Column:
    """Classes 1..n by probability descending, class id ascending."""
    pairs = F.transform(
        item_probs(probs),
        lambda p, i: F.struct((-p).alias("neg"), (i + 1).cast("int").alias("cls")),
    )
    return F.transform(F.array_sort(pairs), lambda s: s["cls"])


def unheld_topk(ranked: Column, held: Column, k: int) -> Column:
    """First ``k`` of a ranked list that are not held, order kept."""
    kept = F.filter(ranked, lambda c: ~F.array_contains(F.coalesce(held, F.array().cast("array<int>")), c))
    return F.slice(kept, 1, k)


def unheld_items(ranked: Column, held: Column, k: int) -> Column:
    """``unheld_topk`` for lists of item names."""
    kept = F.filter(ranked, lambda c: ~F.array_contains(F.coalesce(held, F.array().cast("array<string>")), c))
    return F.slice(kept, 1, k)


def ordered_union(first: Column, second: Column) -> Column:
    return F.array_distinct(F.concat(first, second))


def append_absent(items: Column, item: Column, hold: Column | None = None) -> Column:
    """Append ``item`` unless present, null or the hold label."""
    skip = item.isNull() | F.array_contains(items, item)
    if hold is not None:
        skip = skip | (item == hold)
    return F.when(skip, items).otherwise(F.concat(items, F.array(item)))


def flagged(columns: Sequence[tuple[Column, Column]]) -> Column:
    """Ordered list of labels whose flag is positive; ``columns`` holds (flag, label)."""
    return F.array_compact(F.array(*[F.when(flag > 0, label) for flag, label in columns]))


def first_or(values: Column, default: Column) -> Column:
    return F.when(F.size(values) > 0, F.get(values, F.lit(0))).otherwise(default)


def assemble(columns: Sequence[Column], kind: str = "double") -> Column:
    return F.array(*[c.cast(kind) for c in columns])


def pad(vector: Column, width: int, strict: bool = False) -> Column:
    """Zero-pad to ``width``; a wider vector is cut, or raises when ``strict``."""
    zeros = F.array_repeat(F.lit(0.0), width)
    fixed = F.slice(F.concat(vector, zeros), 1, width)
    if not strict:
        return fixed
    return F.when(F.size(vector) <= width, fixed).otherwise(
        F.raise_error(F.lit(f"vector is wider than {width}"))
    )


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def clip_vector(vector: Column, low: float, high: float) -> Column:
    return F.transform(vector, lambda x: clipped(x, low, high))


def nonzero_count(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda x: x != 0))


def entropy_share(probs: Column, n_items: int) -> Column:
    """Entropy of the item probabilities given an item is chosen, divided by ln(n)."""
    items = item_probs(probs)
    return let(
        total(items) + 1e-12,
        lambda s: -total(
            F.transform(items, lambda p: p / s * F.log(p / s + 1e-12))
        ) / F.log(F.lit(float(n_items))),
    )


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def joined(values: Column, sep: str = ",") -> Column:
    """Comma text of a list, for reports and comparisons."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)
