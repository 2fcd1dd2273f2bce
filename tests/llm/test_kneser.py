"""Kneser-Ney scoring against a model kept in plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrec.llm import kneser

SCHEMA = "doc_id long, text string, key long, th string, held_out int, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Brute:
    def __init__(self, texts, order):
        self.order, self.counts = order, {k: Counter() for k in range(1, order + 1)}
        for text in texts:
            seq = ["<s>"] * (order - 1) + tokens(text)
            for i in range(order - 1, len(seq)):
                self.counts[order][tuple(seq[i - order + 1:i + 1])] += 1
        for k in range(order - 1, 0, -1):
            for gram in self.counts[k + 1]:
                self.counts[k][gram[1:]] += 1
        self.d, self.contexts = {}, {}
        for k, table in self.counts.items():
            n = Counter(table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            raw = [0] + [(i - (i + 1) * y * n[i + 1] / n[i]) if n[i] and n[i + 1] else i / 2 for i in (1, 2, 3)]
            self.d[k] = [min(max(x, 0), i) for i, x in enumerate(raw)]
            stats = self.contexts[k] = defaultdict(lambda: [0, 0.0])
            for gram, c in table.items():
                stats[gram[:-1]][0] += c
                stats[gram[:-1]][1] += self.d[k][min(c, 3)]
        self.words = len(self.counts[1])

    def p(self, context, word):
        lower = self.p(context[1:], word) if context else 1 / (self.words + 1)
        k = len(context) + 1
        if context not in self.contexts[k]:
            return lower
        total, mass = self.contexts[k][context]
        c = self.counts[k][(*context, word)]
        return (c - self.d[k][min(c, 3)]) / total + mass / total * lower

    def score(self, text):
        seq = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(seq[i - self.order + 1:i]), seq[i])) for i in range(self.order - 1, len(seq)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(80)] + ["Über", "naïve", "漢字", "A1"]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(0.06)), 83)] for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)).replace("w0 ", "w0\n")) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, text(4000)), (204, "x" * 3000 + " " + "x" * 3000), (205, "W1 w1"), (None, text(20)), (None, text(9))]
    rows += [(7, rows[7][1])] * 30 + [(300 + i, "the " + " the ".join(f"n{i}x{j}" for j in range(20))) for i in range(20)]
    return rows


@pytest.mark.parametrize("order, shard_bytes, flush, rounds", [(2, 1 << 24, 2_000_000, 1), (2, 3000, 700, 3), (3, 5000, 900, 2)])
def test_scores(spark, rows, order, shard_bytes, flush, rounds):
    table = spark.createDataFrame([(*r, 5, "x", 1, "y") for r in rows], SCHEMA).repartition(4)
    out = kneser.scored(table, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, order, shard_bytes, flush, rounds)
    assert out.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    learnt = [t for i, t in rows if not held(i)]
    model, words = Brute(learnt, order), Counter(w for t in learnt for w in tokens(t))
    total, want = words.total(), []
    for i, t in rows:
        seq = tokens(t)
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (len(words) + 1))) for w in seq)
        want.append((str(i), held(i), len(seq), sum(words[w] > 0 for w in seq), total, base, model.score(t)))
    got = [(str(r[0]), *r[1:7]) for r in out.collect()]
    order_of = lambda r: (*r[:5], round(r[5], 6))
    got, want = sorted(got, key=order_of), sorted(want, key=order_of)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    np.testing.assert_allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-5)
    contexts = [("w1",) * (order - 1), ("nowhere",) * (order - 1), ("the",) * (order - 1)]
    for context in contexts:
        assert sum(model.p(context, w) for w in words) + model.p(context, "unseen") == pytest.approx(1)


def test_frequent_context_is_spread(spark, rows):
    table = spark.createDataFrame([(f"the a{i} the b{i} the c{i}",) for i in range(400)], "text string")
    model = kneser.fit(table, F.col("text"), 2, 8, 300, 1)
    assert len(model.setup.spread) >= 1
    the = kneser.mix(np.zeros(1, np.uint64))  # any words will do for the shards of a context that is not spread
    grams = np.stack([np.repeat(model.setup.spread[:1], 1000), np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)])
    assert len(set(kneser.shard_of(grams, model.setup).tolist())) == 8
    grams[0] = the
    assert len(set(kneser.shard_of(grams, model.setup).tolist())) == 1
    kneser.remove(spark, model.setup.folder)


def test_nothing_to_learn_from_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = kneser.scored(one, F.lit(True)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)
    assert kneser.scored(one.limit(0), F.lit(False)).count() == 0
