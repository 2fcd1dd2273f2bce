"""Substring dedup by a de Bruijn graph of token k-mers, compacted into paths.

Edges are windows of ``size`` consecutive words; repeated nonbranching stretches of edges are compacted into paths,
joined by Spark as one unit, and opened into single edges only where paths of one anchor differ (``repeats``). Source
coordinates take every found edge back to its document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm import repeats, symbols
from panelrec.llm.common import keyed, order_key

SIZE = 13


def _applied(docs: DataFrame, size: int, k: int) -> DataFrame:
    """Documents with ``key``, ``th``, ``text`` and the spans of repeated words."""
    spans = repeats.repeated_spans(docs, repeats.Rule("word", size, k, earlier=True))
    return docs.join(spans, ["key", "th"], "left")


def digests(docs: DataFrame, size: int = SIZE, k: int = 4) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row.

    A word goes where a window of ``size`` words that covers it also starts in a document with a smaller id. Null and
    empty texts have no words; rows without an id come after all others; rows of one id never remove from one another.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            found = symbols.words(piece)
            keep = ~repeats.covered(piece.rows.column("spans"), found.starts)
            n = np.diff(found.starts)
            removed = n - np.diff(np.concatenate(([0], np.cumsum(keep)))[found.starts])
            raw, out = piece.data.tobytes(), []
            for i in range(len(n)):
                text = raw[piece.starts[i]:piece.starts[i + 1]].split()
                if removed[i]:
                    text = [text[j] for j in np.flatnonzero(keep[found.starts[i]:found.starts[i + 1]])]
                out.append(hashlib.sha256(b" ".join(text)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.rows.column("doc_id"), pa.array(n), pa.array(removed), pa.array(out, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])
    base = keyed(docs)
    joined = _applied(base, size, k).withColumn("doc_id", F.expr(f"nullif(key, {(1 << 63) - 1})"))
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, size: int = SIZE, k: int = 4) -> DataFrame:
    """The documents with repeated words cut out of their texts; all columns stay, ``n_chars`` is counted anew.

    A cut takes the words and what stands between them; the two sides are joined by one space. Untouched texts stay
    as they are; a text whose words all go becomes empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            found = symbols.words(piece)
            gone = repeats.covered(piece.rows.column("__spans"), found.starts)
            valid = np.asarray(piece.rows.column("text").is_valid())
            raw, out = piece.data.tobytes(), []
            for i in range(piece.rows.num_rows):
                lo, hi = found.starts[i], found.starts[i + 1]
                if not gone[lo:hi].any():
                    out.append(raw[piece.starts[i]:piece.starts[i + 1]] if valid[i] else None)
                    continue
                kept = np.flatnonzero(~gone[lo:hi])
                runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
                out.append(b" ".join(raw[found.begin[lo + r[0]]:found.end[lo + r[-1]]] for r in runs))
            at = piece.rows.schema.get_field_index("text")
            rows = piece.rows.set_column(at, "text", pa.array(out, pa.binary()).cast(pa.string()))
            yield rows.select(names)
    names = docs.columns
    spans = repeats.repeated_spans(keyed(docs), repeats.Rule("word", size, k, earlier=True))
    spans = spans.select(F.col("key").alias("__key"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    marked = docs.withColumn("__key", order_key()).withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = marked.join(spans, ["__key", "__th"], "left").drop("__key", "__th").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
