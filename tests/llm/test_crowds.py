"""Crowded signatures: groups of near copies of long documents whose members are only partly linked."""

import random

import numpy as np
import pyarrow as pa
import pytest

from panelrec.llm import jaccard, symbols
from panelrec.llm.common import keyed


def shingle_set(text, k):
    w = text.lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets, parent = {i: shingle_set(t, k) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in sets}


@pytest.fixture(scope="module")
def rows():
    """Copies of two long texts with 0 to 60 words changed: similarities on both sides of the threshold, many shared parts."""
    rng = random.Random(11)
    out = []
    for n, size in ((0, 1100), (1000, 300)):
        base = [f"b{n}w{rng.randrange(5000)}" for _ in range(size)]
        for i in range(45):
            w = list(base)
            for at in rng.sample(range(size), rng.choice([0, 3, size // 40, size // 25, size // 18])):
                w[at] = f"c{rng.randrange(10**6)}"
            out.append((n + i, " ".join(w)))
    return out


@pytest.mark.parametrize("crowd, block", [(1, 16), (32, 256)])
def test_components_of_partly_linked_groups(spark, rows, monkeypatch, crowd, block):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for join in (jaccard.Join(words=4, percent=85, shares=2), jaccard.Join(words=5, percent=80)):
        got = {r.key: r.component for r in jaccard.classes(keyed(table), join).collect()}
        want = brute(rows, join.words, join.percent)
        assert got == want and 10 < len(set(want.values())) < 90


def test_sketches_rule_out_unlinked_pairs_of_long_sets():
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (2000, 2000, 1900, 1100, 300)]
    sets.append(np.concatenate((sets[0][:1950], sets[1][:40])))
    u, v = np.triu_indices(len(sets), 1)
    n = np.array([len(s) for s in sets])
    most = (n[u] + n[v]) * 15 // 185
    sketches = [jaccard.sketch(s) for s in sets]
    keep = jaccard.near_sketches(sketches, u, v, most)
    assert [(int(u[k]), int(v[k])) for k in keep] == [(0, 5)]
    assert [int(k) for k in keep] == [k for k in range(len(u)) if jaccard.sketch_difference(sketches[u[k]], sketches[v[k]]) <= most[k]]


def test_long_words_that_a_running_hash_confuses():
    flip = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 1024:
        word += word.translate(flip)
    texts = [word, word.translate(flip)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    piece = next(symbols.pieces(iter([batch])))
    a, b = symbols.word_hashes(piece, symbols.words(piece))
    assert a != b
