"""Norm-bucket search against scores computed for all pairs in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from panelrec.llm import ranked

DOCS = "doc_id long, text string, n long, terms string, length int, score string"
QUERIES = "item_id long, text string, query int, rank string"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k=20):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n_docs, tokens = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in {(q[0], q[1]) for q in queries}:
        asked, found = Counter(terms(text)), []
        for doc, bag in bags:
            m = 75 + (25 * bag.total() * n_docs) // tokens
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t, r in asked.items() if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["Straße", "É", "漢字", "X9"]
    text = lambda n: " ".join(vocab[min(int(rng.expovariate(0.02)), 303)] for _ in range(n))
    docs = [(i, text(rng.randint(1, 120)).replace(" ", rng.choice(["  ", "-", "\n", " "]))) for i in range(500)]
    docs += [(600 + i, docs[3][1]) for i in range(60)] + [(600, docs[3][1])] * 3  # ties beyond k, repeated rows
    docs += [(700, None), (701, ""), (702, "... !?"), (None, docs[4][1]), (None, docs[5][1]), (703, text(60_000)), (704, "W1 w1 W1")]
    queries = [(i, text(rng.randint(1, 30))) for i in range(40)]
    queries += [(50, None), (51, ""), (52, "nowhere"), (53, docs[3][1]), (53, docs[3][1]), (53, "w1"), (None, "w2 w2 É é"), (54, text(3000))]
    return [(*d, 1, "x", 2, "y") for d in docs], [(*q, 3, "z") for q in queries]


@pytest.mark.parametrize("settings", [{}, {"bucket_rows": 16, "first_rows": 40}, {"block_bytes": 2000, "first_rows": 1}])
def test_best(spark, tables, settings):
    docs, queries = tables
    out = ranked.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(queries, QUERIES), **settings)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(docs, queries)


def test_buckets_are_left_out(spark, tables, monkeypatch):
    """Short vectors that cannot reach a query's floor are never scored."""
    docs, queries = tables
    block = next(ranked.blocks(spark.createDataFrame(queries, QUERIES), "item_id", "text", 1 << 20))
    table = ranked.profiles(spark.createDataFrame(docs, DOCS), block, "doc_id", "text").cache()
    scale = ranked.weigh(table, block)
    batch = ranked.with_lengths(table, block, scale).toArrow().combine_chunks().to_batches()[0]
    lengths = batch.column(4).to_numpy()
    assert (lengths[:-1] >= lengths[1:]).all()
    import numpy as np
    floor = np.full(len(block.ids), 1 << 60)
    none, open_ = np.zeros(0, np.int64), np.ones(len(block.ids), bool)
    best = [ranked.Best(none, none, none.astype(bool)) for _ in block.ids]
    ranked.search(ranked.vectors(batch, block.weights, scale), lengths, block, best, floor, open_, 20)
    assert not open_.any() and not any(len(b.score) for b in best)


def test_empty(spark, tables):
    docs, queries = spark.createDataFrame(tables[0], DOCS), spark.createDataFrame(tables[1], QUERIES)
    assert ranked.ranked(docs.limit(0), queries).count() == 0
    assert ranked.ranked(docs, queries.limit(0)).count() == 0
