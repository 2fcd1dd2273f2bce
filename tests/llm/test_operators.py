"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelrec.llm import chat, debruijn, jaccard, mixing, packing, quality, shards, substrings, toxicity, vectors

SCHEMA = "doc_id long, text string, source string, key string, th int, spans string"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["Ärger", "été", "漢字"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, out = make(60), []
    for i in range(60):
        out.append((i, make(rng.randint(1, 90)) + ("\n" + shared if i % 3 == 0 else "") + " " + make(20), f"s{i % 3}"))
    base = make(150)
    for i in range(60, 75):
        w = base.split()
        w[rng.randrange(150)] = "changed"
        out.append((i, " ".join(w), "hot"))
    out += [(80, None, None), (81, "", "s1"), (82, " \t\n", "s1"), (83, "one two", "s2"), (84, "One  two", None), (85, "a " * 3000, "s0"),
            (86, base, "hot"), (86, base, "hot"), (None, base, None), (87, make(5000), "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_debruijn(docs, rows, empty):
    first = {}
    order = lambda i: 1 << 62 if i is None else i
    for i, t, _ in rows:
        w = words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j:j + 13])
            first[k] = min(first.get(k, 1 << 62), order(i))
    want = Counter()
    for i, t, _ in rows:
        w, gone = words(t), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < order(i):
                gone.update(range(j, j + 13))
        kept = [x for j, x in enumerate(w) if j not in gone]
        want[(i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter(tuple(r) for r in debruijn.digests(docs).collect()) == want
    assert debruijn.digests(empty).count() == 0
    out = debruijn.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and debruijn.deduplicated(empty).count() == 0


def test_substrings(docs, rows, empty):
    count = Counter(b[j:j + 400] for _, t, _ in rows for b in [(t or "").encode()] for j in range(len(b) - 399))
    want = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 399):
            if count[b[j:j + 400]] > 1:
                gone[j:j + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for x in bytes(gone).split(b"\0") if x)
        want[(i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(tuple(r) for r in substrings.digests(docs).collect()) == want
    assert substrings.digests(empty).count() == 0


@pytest.mark.parametrize("crowd", [32, 1])
def test_jaccard(docs, rows, empty, crowd, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t, _ in rows:
        w = [x.translate(lower) for x in words(t)]
        sets.append({tuple(w[j:j + 4]) for j in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), 1 << 62), 1 << 62 if i is None else i)
    want = Counter((i, len(sets[a]), least[find(a)]) for a, (i, _, _) in enumerate(rows))
    got = Counter(tuple(r) for r in jaccard.digests(docs, jaccard.Join(words=4, percent=85)).collect())
    assert got == want
    assert jaccard.digests(empty, jaccard.Join()).count() == 0


def test_jaccard_keeps_one_of_each(docs, rows):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert {80, 81, 82} <= set(ids) and sum(60 <= i <= 75 or i == 86 for i in ids) == 1


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for percent in (80, 85):
        join = jaccard.Join(percent=percent)
        for _ in range(1500):
            x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 80))).astype(np.uint64))
            drop, add = rng.integers(0, 1 + len(x) // 5, 2)
            y = np.unique(np.concatenate((x[int(drop):], rng.integers(0, 1 << 63, int(add)).astype(np.uint64))))
            both = len(np.intersect1d(x, y))
            made, who, margin = jaccard.batch_signatures(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y)]), join)
            assert set(made[who == 0]) == set(jaccard.signatures(x, join))
            assert jaccard.sketch_difference(jaccard.sketch(x), jaccard.sketch(y)) <= len(x) + len(y) - 2 * both
            if len(y) and 100 * both >= percent * (len(x) + len(y) - both):
                shared = len(np.intersect1d(made[who == 0], made[who == 1]))
                assert shared >= max(1, *[min(m, 1 << 30) for m in margin])


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in quality.judged(docs.select("doc_id", "text")).collect()}
    for i, t, _ in rows:
        w = (t or "").split()
        seen = Counter(tuple(w[j:j + 8]) for j in range(len(w) - 7))
        again = set()
        for j in range(len(w) - 7):
            if seen[tuple(w[j:j + 8])] > 1:
                again.update(range(j, j + 8))
        lines = [x for x in (t or "").split("\n") if x.split()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (
            len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judged(empty.select("doc_id", "text")).count() == 0


def test_vote_model_orders_good_before_bad():
    model = quality.fit_votes([((1,) * 7, 900), ((-1, -1, 1, -1, -1, 1, 1), 40), ((0,) * 7, 10)])
    assert model.prior > 0.5 and min(model.accuracy()) > 0.5


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "a\\<|", "\\n\\\\", None, "", "tail<"]
    rows = [(1, n, r, t) for n, (t, r) in enumerate(zip(texts, ["user", "assistant", "sys\n<|im_end|>", "assistant", None, "assistant"]))]
    turns = chat.canonical_turns(chat.as_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    back = chat.parsed(chat.formatted(turns)).first()
    assert [(t.role, t.text) for t in back.turns] == [(r or "", t or "") for _, _, r, t in rows]
    assert back.loss_text == "a\\<|" + "" + "tail<"
    odd = spark.sql("select 5L conv_id, 'p' prompt, cast(null as string) completion union all select 6L, null, null")
    assert {(r.conv_id, r.layout) for r in chat.canonical_turns(odd).collect()} == {(5, "prompt"), (6, "unknown")}


def test_shards(docs, rows, empty):
    got = shards.shard(docs.select("doc_id", "source"), 7).collect()
    by = Counter(r.shard for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and len(got) == len(rows)
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert shards.shard(empty, 7).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation(spark, n):
    got = shards.permuted(spark.range(n).withColumnRenamed("id", "row_no"), n, 5).collect()
    assert sorted(r.position for r in got) == list(range(n))


def test_mixing(docs, rows, empty):
    sized = mixing.sized(docs)
    got = mixing.mixed(sized).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    total = sum(len(words(t)) for _, t, _ in rows)
    goal = {r.source: r.target for r in got}
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6
    longest = max(r.size for r in got)
    for s, t in goal.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= longest
    assert mixing.mixed(mixing.sized(empty)).count() == 0


def test_packing(docs, rows, empty):
    sized = docs.withColumn("size", mixing.F.size(mixing.word_list(mixing.F.col("text")))).withColumn("cluster", packing.cluster_of())
    got = packing.packed(sized, capacity=200, apart=(("s0", "s1"),)).collect()
    fill, ids = Counter(), {}
    for r in got:
        fill[r.bin_id] += r.n_words
        ids.setdefault(r.bin_id, []).append(r.doc_id)
    assert max(fill.values()) <= 200 and sum(fill.values()) == sum(len(words(t)) for _, t, _ in rows)
    source = {i: s for i, _, s in rows}
    assert all(not {"s0", "s1"} <= {source[i] for i in x} for x in ids.values())
    assert all(x.count(86) <= 1 for x in ids.values())
    assert packing.packed(sized.limit(0)).count() == 0


def test_segments_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        s = rng.normal(-0.3, 1, 30)
        found = toxicity.segments(s)
        best = max(max(s[i:j].sum() for j in range(i + 1, 31)) for i in range(30))
        if best > 0:
            assert max(x[2] for x in found) == pytest.approx(best)
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_toxicity_learns(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        w = [f"n{rng.randrange(300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(5):
                w[rng.randrange(60)] = f"bad{rng.randrange(6)}"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(None, None), (700, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.judged(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.judged(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.score for r in none.collect()}) == 1


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 8))
    x = [(i, [float(v) for v in base[i % 40] + 0.15 * rng.normal(size=8)]) for i in range(200)]
    x += [(300, None), (301, []), (302, [0.0] * 8), (303, [float("nan")] * 8), (304, [1.0, None] + [0.0] * 6), (305, [1.0, 2.0]), (306, x[0][1]), (306, x[0][1])]
    got = vectors.near_duplicates(spark.createDataFrame(x, "vec_id long, embedding array<double>")).collect()
    u = np.array([v for _, v in x[:200]] + [x[0][1]] * 2)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum() - len(u)
    assert sum(r.n_links for r in got if r.vec_id < 300 or r.vec_id == 306) >= 0.9 * links
    assert all(r.n_links == 0 and r.kept for r in got if 300 <= r.vec_id <= 305) and len(got) == len(x)
