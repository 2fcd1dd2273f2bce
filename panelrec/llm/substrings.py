"""Exact substring dedup over bytes: every byte covered by a string of ``SIZE`` bytes that also starts elsewhere.

Strings are anchored at minimizers and compacted into paths (``repeats``), so that two rows in a hundred bytes are
shuffled and not one suffix a byte. See the README for why the merge of shard Burrows-Wheeler transforms gives way
to this on whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelrec.llm import repeats, symbols
from panelrec.llm.common import NO_ID, keyed

SIZE = 400
ANCHOR = 160


def deduplicated(docs: DataFrame, size: int = SIZE, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept, text)`` of every row: its byte length, what goes and what stays.

    Matches lie inside one row's text, and both of two equal strings go, in one document or in two; equal rows
    remove each other. Null and empty texts have no bytes; texts shorter than ``size`` lose nothing. ``spans`` are the
    maximal removed runs (start, end) in bytes, ``kept`` the remaining bytes; ``text`` has the characters that stay whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in symbols.pieces(batches):
            gone = repeats.covered(piece.rows.column("spans"), piece.starts)
            first, after = runs(gone, piece.starts)
            part = np.searchsorted(first, piece.starts)
            shift = np.repeat(piece.starts[:-1], np.diff(part))
            spans = pa.ListArray.from_arrays(
                pa.array(part.astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((x - shift).astype(np.int32)) for x in (first, after)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays(
                [piece.rows.column("doc_id"), pa.array(np.diff(piece.starts)), spans,
                 rest(piece, gone), rest(piece, whole_characters(piece, gone)).view(pa.string())],
                ["doc_id", "n_bytes", "spans", "kept", "text"])
    base = keyed(docs)
    spans = repeats.repeated_spans(base, repeats.Rule("byte", size, k, earlier=False))
    joined = base.join(spans, ["key", "th"], "left").withColumn("doc_id", F.expr(f"nullif(key, {NO_ID})"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start int, end int>>, kept binary, text string")


def runs(gone: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the maximal runs of removed bytes and the bytes after them; none crosses texts."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[starts] = True
    first = gone & (edge[:-1] | ~np.concatenate(([False], gone))[:-1])
    last = gone & (edge[1:] | ~np.concatenate((gone, [False]))[1:])
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def whole_characters(piece: symbols.Texts, gone: np.ndarray) -> np.ndarray:
    """The removed bytes and the others of each UTF-8 character that loses one."""
    if not gone.any():
        return gone
    head = (piece.data & 0xC0) != 0x80
    head[piece.starts[:-1][np.diff(piece.starts) > 0]] = True
    at = np.flatnonzero(head)
    return np.repeat(np.logical_or.reduceat(gone, at), np.diff(np.concatenate((at, [len(gone)]))))


def rest(piece: symbols.Texts, gone: np.ndarray) -> pa.Array:
    """What is left of each text, as bytes."""
    ends = np.concatenate(([0], np.cumsum(~gone)))[piece.starts].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(piece.data[~gone])])


def digested(cut: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of deduplicated rows, and more of their columns."""
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"), *more)


def digests(docs: DataFrame, size: int = SIZE, k: int = ANCHOR) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row, from what ``deduplicated`` leaves."""
    return digested(deduplicated(docs, size, k))
