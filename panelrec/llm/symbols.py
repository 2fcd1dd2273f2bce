"""Vectorised work on Arrow batches of texts: words, symbol hashes, window hashes, minimizers.

All functions take a few megabytes of text at a time: ``pieces`` cuts batches by bytes, a single longer text being a
piece of its own, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
LONG_WORD = 256
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; tables of common size are kept."""
    size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
    if base not in _powers or len(_powers[base]) < size:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * PIECE_BYTES:
            return out[:n]
        _powers[base] = out
    return _powers[base][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i modulo 2^64, one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] by content, wherever the span lies."""
    inverse = powers(BASE_INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """A piece: rows of the batch, their bytes in one array and where each text starts (one more than rows)."""

    rows: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[Texts]:
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_binary()), b"")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield Texts(batch.slice(first, last - first), data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            first = last


@dataclass
class Words:
    """Words of a piece: byte spans in the piece's data and, for each text, where its words start (one more than texts)."""

    begin: np.ndarray
    end: np.ndarray
    starts: np.ndarray


def words(texts: Texts, outside: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes other than space, tab, line breaks, vertical tab and form feed; none crosses texts.

    ``outside`` is another set of separating bytes, as 256 flags.
    """
    n = len(texts.data)
    inside = ~outside[texts.data]
    cut = np.zeros(n + 1, bool)
    cut[texts.starts] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Words(begin, end, np.searchsorted(begin, texts.starts))


def word_hashes(texts: Texts, found: Words, lower: bool = False) -> np.ndarray:
    """Hash of each word; words of ``LONG_WORD`` bytes and more by a cryptographic hash, as the running one, being modulo
    a power of two, has made-up collisions from 1,024 bytes on."""
    data = _LOWER[texts.data] if lower else texts.data
    out = span_hash(prefix(_BYTE[data]), found.begin, found.end)
    for i in np.flatnonzero(found.end - found.begin >= LONG_WORD):
        word = hashlib.blake2b(data[found.begin[i]:found.end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(word, "little")
    return out


def units(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a piece's symbols (``word`` or ``byte``) and where each text's symbols start."""
    if unit == "byte":
        return _BYTE[texts.data], texts.starts
    found = words(texts)
    return word_hashes(texts, found), found.starts


def window_starts(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First symbols of all windows that lie inside one text, and the text of each."""
    counts = np.maximum(np.diff(starts) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[:-1][text]
    return at, text


@dataclass
class Paths:
    """Runs of consecutive windows that share one minimizer: text, first window, windows, anchor and content hash."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def paths(values: np.ndarray, starts: np.ndarray, length: int, k: int) -> Paths:
    """Compact all windows of ``length`` symbols into paths by their minimizers of ``k`` symbols.

    A window's minimizer is its k-symbol string of least hash, the leftmost of equals, so it depends on the
    window's content alone: equal windows lie in paths of one anchor, at one distance from it.
    """
    at, text = window_starts(starts, length)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return Paths(empty, empty, empty, empty, empty)
    sums = prefix(values)
    grams = np.arange(len(values) - k + 1)
    gram = span_hash(sums, grams, grams + k)
    # the high half orders, the low half gives the place and makes the leftmost of equals win
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | grams.astype(np.uint64)
    width, covered = length - k + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        least = np.minimum(least[:-step], least[step:])
        covered += step
    place = (least[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    n = np.diff(np.concatenate((first, [len(at)])))
    start, place = at[first], place[first]
    content = span_hash(sums, start, start + n + length - 1) ^ mix((place - start).astype(np.uint64))
    return Paths(text[first], start - starts[text[first]], n, gram[place], content)


def longs(values: np.ndarray) -> pa.Array:
    """64-bit values as an Arrow column of signed longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
