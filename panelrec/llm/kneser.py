"""Interpolated modified Kneser-Ney model, counted in Spark and kept as sorted hash arrays that workers memory-map.

Tokens are lower-cased words and one end per text; each is a 64-bit hash. A task counts the n-grams of a few million
tokens at a time and sends each shard one block of them, so that n-grams seen often travel once a task. An n-gram
belongs to the shard of its context; contexts that end in a word with more than half a shard's share of all tokens are
spread by the n-gram itself and their totals put together, so no shard grows with one word. Counting runs down the orders
(each shard tells the next lower order which suffixes it has: these are its continuation counts), probabilities run up.

The model is a folder of arrays, one set for each order and shard: hashes of n-grams in order with the logarithm of
their interpolated probability, hashes of contexts with the logarithm of their back-off weight. To score, tasks send each
shard the n-grams of their texts and where they occur; a shard maps its arrays, answers what it knows and passes the rest,
weighed by the back-off, to the next lower order. Work and traffic follow the tokens; no task holds the whole model.

Nulls: a text that is null or empty is one end token. Rows without id are not held out. Repeated rows are counted and
scored as often as they occur. An empty table gives no rows; with nothing to learn from every token is unknown and
has probability 1. Texts and words of any length are read whole. Columns other than id and text do not matter.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.llm.common import discard, order_key, staged
from panelrec.llm.symbols import BASE, mix, pieces, word_hashes, words
from panelrec.session import checkpoint_root

END, START = mix(np.array([101, 202], np.uint64))
RAW = 0  # the order that holds plain word counts
SENT = "what string, k int, shard int, batch long, data binary"
NOTHING = np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Setup:
    """How a model is laid out: its order, shards, folder, the words whose contexts are spread, and discounts by order."""

    order: int
    shards: int
    folder: str
    flush_tokens: int
    rounds: int
    spread: np.ndarray = field(default_factory=lambda: NOTHING)


# ---- n-grams -------------------------------------------------------------------------------------------------------

def context_of(grams: np.ndarray) -> np.ndarray:
    """Hash of each n-gram's context; ``grams`` has a row for each place of the n-gram."""
    out = np.full(grams.shape[1], len(grams), np.uint64)
    for column in grams[:-1]:
        out = mix(out * np.uint64(BASE) + column)
    return out


def gram_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(BASE) + word)


def shard_of(grams: np.ndarray, setup: Setup) -> np.ndarray:
    """Shard of each n-gram: by word, by context, or by itself where the context is spread."""
    key = grams[0] if len(grams) == 1 else context_of(grams)
    if len(grams) > 1:
        wide = spread(grams, setup)
        key = np.where(wide, gram_of(key, grams[-1]), key)
    return ((key >> np.uint64(32)) * np.uint64(setup.shards) >> np.uint64(32)).astype(np.int64)


def spread(grams: np.ndarray, setup: Setup) -> np.ndarray:
    out = np.ones(grams.shape[1], bool)
    for column in grams[:-1]:
        out &= found_in(setup.spread, column)[0]
    return out


def found_in(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def distinct(grams: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams, sorted by context: ``(grams, summed weights, order of the input by n-gram, first of each there)``."""
    if not grams.shape[1]:
        return grams, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(grams) == 1:
        key = grams[0]
    else:  # the high bits are the context's, so that runs of one context lie together and in the order of shards
        context = context_of(grams)
        key = (context & np.uint64(0xFFFFFFFF00000000)) | (gram_of(context, grams[-1]) & np.uint64(0xFFFFFFFF))
    order = np.argsort(key)
    key = key[order]
    grams = np.stack([np.take(g, order) for g in grams])
    new = changes(grams)
    if len(grams) > 1 and (new[1:] & (key[1:] == key[:-1])).any():  # different n-grams may share the key and alternate
        exact = np.lexsort((*grams[::-1], key))
        order, grams = order[exact], grams[:, exact]
        new = changes(grams)
    first = np.flatnonzero(new)
    total = np.diff(np.append(first, len(order))) if weight is None else np.add.reduceat(weight[order], first)
    return np.stack([np.take(g, first) for g in grams]), total, order, first


def changes(grams: np.ndarray) -> np.ndarray:
    """Whether each n-gram differs from the one before it."""
    out = np.ones(grams.shape[1], bool)
    out[1:] = False
    for column in grams:
        out[1:] |= column[1:] != column[:-1]
    return out


def tokens(batches: Iterator[pa.RecordBatch], pads: int, flush: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of about ``flush`` tokens at a time: their rows, all tokens with ``pads`` starts before each text, places of
    the true tokens and the text of each."""
    held, parts, counts, n = [], [], [], 0

    def out():
        sizes = np.concatenate(counts)
        real = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(sizes) + 1) * pads, sizes)
        return pa.Table.from_batches(held), np.concatenate(parts), real, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    for texts in pieces(batches):
        found = words(texts)
        hashes = word_hashes(texts, found, lower=True)
        size = np.diff(found.starts) + 1
        padded = np.full(len(hashes) + len(size) * (pads + 1), START, np.uint64)
        text = np.repeat(np.arange(len(size)), size - 1)
        padded[np.arange(len(hashes)) + text + (text + 1) * pads] = hashes
        padded[np.cumsum(size) + np.arange(1, len(size) + 1) * pads - 1] = END
        held.append(texts.rows)
        parts.append(padded)
        counts.append(size)
        n += size.sum()
        if n >= flush:
            yield out()
            held, parts, counts, n = [], [], [], 0
    if held:
        yield out()


def grams_of(sequence: np.ndarray, real: np.ndarray, k: int) -> np.ndarray:
    return np.stack([sequence[real - j] for j in range(k - 1, -1, -1)])


# ---- blocks between tasks ------------------------------------------------------------------------------------------

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its type and size; whole numbers in as few bytes as the largest needs."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64 and (not len(a) or a.min() >= 0):
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out += [a.dtype.str.encode().ljust(8), np.int64(a.nbytes).tobytes(), np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 8)]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.dtype(data[at:at + 8].decode().strip()), int(np.frombuffer(data, np.int64, 1, at + 8)[0])
        out.append(np.frombuffer(data, kind, n // kind.itemsize, at + 16))
        at += 16 + n + -n % 8
    return out


def runs_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams as contexts, each once for a run of its followers, lengths of the runs, and last words."""
    first = np.flatnonzero(changes(grams[:-1])) if len(grams) > 1 and grams.shape[1] else np.arange(min(1, grams.shape[1]))
    return grams[:-1, first].ravel(), np.diff(np.append(first, grams.shape[1])), grams[-1]


def grams_from(contexts: np.ndarray, runs: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.repeat(contexts.reshape(k - 1, -1), runs, 1), last[None, :]]) if k > 1 else last[None, :]


def blocks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["what", "k", "shard", "batch", "data"])


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard's items, in order."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        yield int(shard[part[0]]), part


def counted(grams: np.ndarray, n: np.ndarray, what: str, setup: Setup, origin: int = -1) -> Iterator[tuple]:
    for shard, at in by_shard(shard_of(grams, setup)):
        yield what, len(grams), shard, origin, packed(*runs_of(grams[:, at]), n[at])


# ---- the folder of arrays ------------------------------------------------------------------------------------------

def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write one array under a name of its own and move it into place, so that a repeated task does no harm."""
    store, root = filesystems.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        np.save(out, array)
    store.move(own, f"{root}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Memory-map one array; from a store that is not a local or mounted folder, a copy of it that lives as long as the map."""
    store, root = filesystems.FileSystem.from_uri(folder)
    path = f"{root}/{name}.npy"
    if store.get_file_info(path).type == filesystems.FileType.NotFound:
        return NOTHING
    if isinstance(store, filesystems.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    handle, copy = tempfile.mkstemp()
    os.close(handle)
    filesystems.copy_files(path, copy, source_filesystem=store, destination_filesystem=filesystems.LocalFileSystem())
    out = np.load(copy, mmap_mode="r")
    os.unlink(copy)
    return out


def new_folder(spark: SparkSession) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/llm/model-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


# ---- counting ------------------------------------------------------------------------------------------------------

def _count(setup: Setup, k: int, this_round: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sequence, real, _ in tokens(batches, setup.order - 1, setup.flush_tokens):
            grams, n, _, _ = distinct(grams_of(sequence, real, max(k, 1)))
            mine = shard_of(grams, setup) % setup.rounds == this_round
            yield blocks([(what, k, *rest) for what, _, *rest in counted(grams[:, mine], n[mine], "count", setup)])

    return run


def _merge(setup: Setup):
    """Counts of one order and shard put together and saved; sent on are figures, suffixes and totals of spread contexts."""
    def run(table: pa.Table) -> pa.Table:
        k, shard = table["k"][0].as_py(), table["shard"][0].as_py()
        parts = [unpacked(d.as_py()) for d in table["data"]]
        grams = np.concatenate([grams_from(*g, max(k, 1)) for *g, _ in parts], 1)
        # a suffix's blocks come from different shards, one n-gram of each suffix and shard: their sum counts left words
        grams, n, _, _ = distinct(grams, np.concatenate([c.astype(np.int64) for *_, c in parts]))
        if k > 1:  # whole contexts together
            order = np.argsort(context_of(grams), kind="stable")
            grams, n = grams[:, order], n[order]
        figures = np.array([(n == 1).sum(), (n == 2).sum(), (n == 3).sum(), (n == 4).sum(), (n >= 3).sum(), n.sum(), len(n)], np.int64)
        rows = [("figures", k, shard, -1, packed(figures))]
        if k < 2:
            save(setup.folder, f"{k}-{shard}-words", grams[0])
            save(setup.folder, f"{k}-{shard}-n", n)
        else:
            first = np.flatnonzero(changes(grams[:-1]))
            counts = f"{setup.folder}/counts"
            for name, array in zip(("contexts", "runs", "words", "n"), (*runs_of(grams), n)):
                save(counts, f"{k}-{shard}-{name}", array if array.dtype == np.uint64 else array.astype(np.min_scalar_type(int(array.max()))))
            suffixes, left, _, _ = distinct(grams[1:])
            rows += counted(suffixes, left, "suffix", setup, shard)
            wide = spread(grams[:, first], setup)
            if wide.any():
                rows.append(("totals", k, shard, -1, packed(context_of(grams[:, first])[wide], totals(n, first)[:, wide].ravel())))
        return pa.Table.from_batches([blocks(rows)])

    return run


def _frequent(setup: Setup, limit: int):
    """Words counted more than ``limit`` times."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                names, n = load(setup.folder, f"0-{shard}-words"), load(setup.folder, f"0-{shard}-n")
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(names[n > limit]).view(np.int64))], names=["w"])

    return run


def totals(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each context: summed counts, and how many followers were counted once, twice and more often."""
    return np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (n, n == 1, n == 2, n >= 3)])


def discounts(figures: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from how many n-grams were counted 1 to 4 times."""
    n1, n2, n3, n4 = (int(x) for x in figures[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.array([0.0, *(min(max(d, 0.0), i + 1.0) for i, d in enumerate(raw))])


def _summed(rows: DataFrame, k: int) -> np.ndarray:
    """Figures of an order: seven numbers from each shard, added up."""
    parts = rows.where((F.col("k") == k) & (F.col("what") == "figures")).select("data").collect()
    return np.sum([unpacked(bytes(p.data))[0].astype(np.int64) for p in parts], 0) if parts else np.zeros(7, np.int64)


# ---- probabilities -------------------------------------------------------------------------------------------------

@dataclass
class Model:
    setup: Setup
    tokens: int
    words: int
    unknown: float  # log10 probability of a word not learnt


def _lowest(setup: Setup, figures: np.ndarray, unknown: float):
    """Order 1: save log probabilities of the words, and send each shard of order 2 those of the suffixes it named."""
    d = discounts(figures)

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        known, n = load(setup.folder, f"1-{shard}-words"), load(setup.folder, f"1-{shard}-n")
        p = (n - d[np.minimum(n, 3)]) / figures[5] + 10.0 ** unknown
        save(setup.folder, f"1-{shard}-p", np.log10(p).astype(np.float32))
        return pa.Table.from_batches([blocks(list(_answers(table, 1, known, p)))])

    return run


def _answers(table: pa.Table, k: int, known: np.ndarray, p: np.ndarray) -> Iterator[tuple]:
    for origin, data in zip(table["batch"].to_pylist(), table["data"]):
        grams = grams_from(*unpacked(data.as_py())[:3], k)
        keys = grams[0] if k == 1 else gram_of(context_of(grams), grams[-1])
        yield "lower", k + 1, origin, -1, packed(keys, p[found_in(known, keys)[1]].astype(np.float64))


def _interpolate(setup: Setup, k: int, figures: np.ndarray, wide: tuple[np.ndarray, np.ndarray]):
    """Order k of one shard: save the arrays that answer; ``lower`` rows bring the suffixes' probabilities."""
    d = discounts(figures)

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        contexts, runs, last, n = (load(f"{setup.folder}/counts", f"{k}-{shard}-{x}") for x in ("contexts", "runs", "words", "n"))
        runs = runs.astype(np.int64)
        grams = grams_from(contexts, runs, last, k)
        first = np.cumsum(runs) - runs
        stats, keys = totals(n, first), context_of(grams[:, first])
        hit, at = found_in(wide[0], keys)
        stats[:, hit] = wide[1][:, at[hit]]
        backoff = (d[1] * stats[1] + d[2] * stats[2] + d[3] * stats[3]) / stats[0]
        is_lower = np.array(table["what"].to_pylist()) == "lower"
        sent = [unpacked(x.as_py()) for x, low in zip(table["data"], is_lower) if low]
        names, values = (np.concatenate(x) for x in zip(*sent))
        order = np.argsort(names)
        tail = grams[1:]
        lower = values[order][found_in(names[order], tail[0] if k == 2 else gram_of(context_of(tail), tail[-1]))[1]]
        p = (n - d[np.minimum(n, 3)]) / np.repeat(stats[0], runs) + np.repeat(backoff, runs) * lower
        own = gram_of(context_of(grams), grams[-1])
        order = np.argsort(own)
        save(setup.folder, f"{k}-{shard}-grams", own[order])
        save(setup.folder, f"{k}-{shard}-p", np.log10(p[order]).astype(np.float32))
        order_c = np.argsort(keys)
        save(setup.folder, f"{k}-{shard}-keys", keys[order_c])
        save(setup.folder, f"{k}-{shard}-backoff", np.log10(np.maximum(backoff[order_c], 1e-300)).astype(np.float32))
        asked = table.filter(pa.array(~is_lower))
        return pa.Table.from_batches([blocks(list(_answers(asked, k, own[order], p[order])))])

    return run


def fit(docs: DataFrame, text: Column, order: int, shards: int, flush_tokens: int, rounds: int) -> Model:
    """Count ``docs`` and write the model's arrays to a new folder."""
    spark = docs.sparkSession
    texts = docs.select(text.alias("text"))
    setup = Setup(order, shards, new_folder(spark), flush_tokens, rounds)

    def merged(source: DataFrame) -> DataFrame:
        return staged(source.groupBy("k", "shard").applyInArrow(_merge(setup), SENT))

    plain = merged(texts.mapInArrow(_count(Setup(order, shards, setup.folder, flush_tokens, 1), RAW, 0), SENT))
    raw = _summed(plain, RAW)
    frequent = plain.where("what = 'figures'").select("shard").mapInArrow(_frequent(setup, int(raw[5]) // (2 * shards)), "w long")
    names = np.array([r.w for r in frequent.collect()], np.int64).view(np.uint64)  # at most two a shard, on average
    setup = Setup(order, shards, setup.folder, flush_tokens, rounds, np.sort(names))
    discard(plain)
    if not raw[5]:
        return Model(setup, 0, 0, 0.0)
    sent = {order: [merged(texts.mapInArrow(_count(setup, order, r), SENT)) for r in range(rounds)]}
    for k in range(order - 1, 0, -1):
        suffixes = _union(sent[k + 1]).where("what = 'suffix'").withColumn("what", F.lit("count"))
        sent[k] = [merged(suffixes)]
    figures = {k: sum(_summed(t, k) for t in sent[k]) for k in sent}
    d = discounts(figures[1])
    unknown = float(np.log10((d[1] * figures[1][0] + d[2] * figures[1][1] + d[3] * figures[1][4]) / figures[1][5] / (figures[1][6] + 1)))
    asked = _union(sent[2]).where("what = 'suffix'")
    answers = staged(asked.groupBy("shard").applyInArrow(_lowest(setup, figures[1], unknown), SENT))
    for k in range(2, order + 1):
        wide = _wide(_union(sent[k]), k)
        asked = _union(sent[k + 1]).where("what = 'suffix'").unionByName(answers) if k < order else answers
        next_answers = staged(asked.groupBy("shard").applyInArrow(_interpolate(setup, k, figures[k], wide), SENT))
        discard(answers)
        answers = next_answers
    discard(answers, *[t for tables in sent.values() for t in tables])
    remove(spark, f"{setup.folder}/counts")
    return Model(setup, int(raw[5]), int(raw[6]), unknown)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _wide(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals of spread contexts over all shards; there are at most four a shard for each place of a context."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                keys, stats = unpacked(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, stats.reshape(4, -1).astype(np.int64))], names=["c", "t", "a", "b", "m"])

    found = rows.where((F.col("k") == k) & (F.col("what") == "totals")).select("data").mapInArrow(listed, "c long, t long, a long, b long, m long")
    table = found.groupBy("c").agg(*[F.sum(x).alias(x) for x in "tabm"]).toArrow()
    keys = table["c"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([table[x].to_numpy()[order] for x in "tabm"])


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


# ---- scoring -------------------------------------------------------------------------------------------------------

def _ask(setup: Setup, k: int, this_round: int):
    """Send each shard the n-grams of some texts with the texts they are in; the texts' ids go along in a row of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        for rows, sequence, real, text in tokens(batches, setup.order - 1, setup.flush_tokens):
            ids = packed(rows["key"].to_numpy(), rows["th"].to_numpy().view(np.uint64), np.bincount(text, minlength=rows.num_rows))
            out = [("texts", k, batch % setup.shards, batch, ids)]
            grams, n, order, _ = distinct(grams_of(sequence, real, max(k, 1)))
            shard = shard_of(grams, setup)
            if setup.rounds > 1 and k > 1:
                keep = shard % setup.rounds == this_round
                order, grams, n, shard = order[np.repeat(keep, n)], grams[:, keep], n[keep], shard[keep]
            out += _occurring(grams, n, text[order], "ask", k, shard, batch)
            yield blocks(out)
            batch += 1

    return run


def _occurring(grams: np.ndarray, n: np.ndarray, text: np.ndarray, what: str, k: int, shard: np.ndarray, batch: int, owner: np.ndarray | None = None) -> Iterator[tuple]:
    """A row for each shard: n-grams, how often each occurs, and the texts it occurs in; ``owner`` is the batch of each n-gram
    where they are of several."""
    begin = np.cumsum(n) - n
    for s, at in by_shard(shard):
        m = n[at]
        places = np.repeat(begin[at] - np.cumsum(m) + m, m) + np.arange(m.sum())
        yield what, k, s, batch, packed(*runs_of(grams[:, at]), m, text[places], *([] if owner is None else [owner[at]]))


def _answer(model: Model, k: int):
    """Sums over texts of what a shard's arrays say about their n-grams; n-grams it does not know go to the order below,
    in one row for each shard there."""
    setup = model.setup

    def run(table: pa.Table) -> pa.Table:
        shard, rows, lost = table["shard"][0].as_py(), [], []
        if k < 2:
            known = load(setup.folder, f"{k}-{shard}-words")
            p = load(setup.folder, f"1-{shard}-p" if k else f"0-{shard}-n")
        else:
            known, p, contexts, backoff = (load(setup.folder, f"{k}-{shard}-{x}") for x in ("grams", "p", "keys", "backoff"))
        passed = []
        for what, batch, data in zip(table["what"].to_pylist(), table["batch"].to_pylist(), table["data"]):
            if what == "texts":
                rows.append((what, k, shard, batch, data.as_py()))
                continue
            *flat, n, text = unpacked(data.as_py())[:5]
            n, grams = n.astype(np.int64), grams_from(*flat, max(k, 1))
            context = context_of(grams)
            hit, at = found_in(known, grams[0] if k < 2 else gram_of(context, grams[-1]))
            value = np.full(len(hit), model.unknown if k else 0.0)
            owner = unpacked(data.as_py())[5].astype(np.int64) if what == "pass" else np.full(len(hit), batch)
            if k > 1:
                there, place = found_in(contexts, context)
                value = np.zeros(len(hit))
                value[there] = backoff[place[there]]
                if not hit.all():
                    lost.append((grams[1:, ~hit], n[~hit], text[np.repeat(~hit, n)].astype(np.int64), owner[~hit]))
            value[hit] = p[at[hit]]
            if k == RAW:
                value = np.log10((value + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            if what == "pass":
                passed.append((np.repeat(owner, n), text.astype(np.int64), np.repeat(value, n), np.repeat(hit, n)))
            else:
                rows.append(("sum", k, shard, batch, packed(*_by_text(text, np.repeat(value, n), np.repeat(hit, n)))))
        if passed:
            owner, text, value, hit = (np.concatenate(x) for x in zip(*passed))
            for batch, at in by_shard(owner):
                rows.append(("sum", k, shard, batch, packed(*_by_text(text[at], value[at], hit[at]))))
        if lost:
            grams, n, text, owner = (np.concatenate(x, -1) for x in zip(*lost))
            rows += _occurring(grams, n, text, "pass", k - 1, shard_of(grams, setup), -1, owner)
        return pa.Table.from_batches([blocks(rows)])

    return run


def _by_text(text: np.ndarray, value: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = np.flatnonzero(np.bincount(text))
    return texts, np.bincount(text, value)[texts], np.bincount(text, hit)[texts].astype(np.int64)


def _per_text(table: pa.Table) -> pa.Table:
    """Ids and sums of one batch of texts from all shards."""
    what, data = table["what"].to_pylist(), table["data"]
    keys, th, size = next(unpacked(d.as_py()) for w, d in zip(what, data) if w == "texts")
    total, seen = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
    for w, d in zip(what, data):
        if w == "sum":
            text, sums, hits = unpacked(d.as_py())
            total[text] += sums
            seen[text] += hits
    return pa.table({"key": keys.astype(np.int64), "th": th.view(np.int64), "n_tokens": size.astype(np.int64), "total": total, "seen": seen})


def _sums(model: Model, keyed: DataFrame, k: int, this_round: int) -> list[DataFrame]:
    """Rows ``(key, th, n_tokens, total, seen)`` of every text, from order ``k`` down."""
    asked = keyed.mapInArrow(_ask(model.setup, k, this_round), SENT)
    tables = []
    while True:
        tables.append(staged(asked.groupBy("shard").applyInArrow(_answer(model, k), SENT)))
        if k < 2:
            break
        k -= 1
        asked = tables[-1].where("what = 'pass'")
    found = staged(_union(tables).where("what != 'pass'").groupBy("batch").applyInArrow(_per_text, "key long, th long, n_tokens long, total double, seen long"))
    discard(*tables)
    return found


def scored(docs: DataFrame, held_out: Column, order: int = 2, shard_bytes: int = 5 << 20, flush_tokens: int = 400_000, rounds: int = 2,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; learnt from rows not held out; staged.

    ``shard_bytes`` of text make a shard, which fits in a task several times; ``rounds`` passes over the texts bound the
    disk that blocks of n-grams take at once.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = docs.select(order_key(id_col).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = table.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = fit(table.where("not held"), F.col("text"), order, max(1, -(-size // shard_bytes)), flush_tokens, rounds)
    inputs = table.select("key", "th", "text")
    base = _sums(model, inputs, RAW, 0)
    parts = [_sums(model, inputs, order, r) for r in range(rounds)] if model.tokens else []
    every = base.select("key", "th", "n_tokens", F.lit(1).alias("copies"), F.col("total").alias("base"), "seen", F.lit(0.0).alias("score"))
    for part in parts:
        every = every.unionByName(part.select(
            "key", "th", "n_tokens", F.lit(0).alias("copies"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("seen"), F.col("total").alias("score")))
    # rows of one id and text have equal sums in every pass: their mean is each one's own
    copies = F.sum("copies")
    sums = every.groupBy(F.col("key").alias("k"), F.col("th").alias("h")).agg(
        F.max("n_tokens").alias("n_tokens"), (F.sum("seen") / copies).cast("long").alias("n_known"),
        (F.sum("base") / copies).alias("base_score"), (F.sum("score") / copies).alias("score"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), order_key(id_col).alias("k"), F.xxhash64(text).alias("h"))
    out = staged(own.join(sums, ["k", "h"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")))
    discard(base, *parts)
    remove(spark, model.setup.folder)
    return out
