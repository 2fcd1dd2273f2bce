"""The pipeline's stages against brute force, with many rows without an id, repeated ids and equal rows."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from panelrec.llm import jaccard

SCHEMA = "doc_id long, text string, source string"


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups_of(rows):
    """Rows by group of linked texts; a text without words is a group of its own."""
    sets, top = [shingle_set(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                top[find(a)] = find(b)
    out = {}
    for a, row in enumerate(rows):
        out.setdefault(find(a), []).append(row)
    return list(out.values())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    out = [(None, make(40), f"s{i % 3}") for i in range(12)] + [(7, make(30), "s0") for _ in range(5)] + [(None, "one two", None)]
    out += [(i, make(rng.randint(5, 60)), f"s{i % 3}") for i in range(20, 60)]
    base = make(120).split()
    for i in (None, None, 70, 71):
        w = list(base)
        w[rng.randrange(120)] = "changed"
        out.append((i, " ".join(w), "s1"))
    shared = make(20)
    out += [(i, f"{make(30)} {shared} {make(30)}", "s2") for i in (80, 81, 81, None)]
    out += [(90, None, None), (91, "", "s1"), (None, None, "s1"), (None, " \n", "s1"), (92, out[3][1], "s0"), out[20], out[20], out[2]]
    return out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_only_linked_or_equal_texts_replace_each_other(spark, rows):
    order = lambda i: 1 << 62 if i is None else i
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    left = pairs(jaccard.representatives(docs))
    for group in groups_of(rows):
        if not shingle_set(group[0][1]):
            continue
        least = {(i, t) for i, t, _ in group if order(i) == min(order(x[0]) for x in group)}
        assert sum(left.get(x, 0) for x in {(i, t) for i, t, _ in group}) == 1 and any(left.get(x) for x in least)
    assert Counter(x for x in left.elements() if not shingle_set(x[1])) == Counter((i, t) for i, t, _ in rows if not shingle_set(t))


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    rng = random.Random(9)
    clean = [(1000 + i, " ".join(f"w{rng.randrange(900)}" for _ in range(40)), "s0") for i in range(200)]
    toxic = [(2000 + i, " ".join(f"bad{rng.randrange(6)}" if 10 <= j < 20 else f"w{rng.randrange(900)}" for j in range(40)), "s1") for i in range(60)]
    rows = rows + clean + toxic + [(None, toxic[0][1], None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0) for i, _, _ in clean] + [(i, 1) for i, _, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen[name] = at = spark.read.parquet(f"{tmp_path}/{name}")

    mild = [r for r in rows if "bad" not in (r[1] or "")]
    assert pairs(seen["toxicity"]) == Counter((i, t) for i, t, _ in mild)

    one = pairs(seen["ngram_jaccard_join"])
    groups = groups_of(mild)
    assert sum(one.values()) == len(groups)
    assert all(sum(one.get(x, 0) for x in {(i, t) for i, t, _ in g}) == 1 for g in groups if shingle_set(g[0][1]))

    order, first = (lambda i: 1 << 62 if i is None else i), {}
    for (i, t), n in one.items():
        w = (t or "").split()
        for j in range(len(w) - 12):
            first[tuple(w[j:j + 13])] = min(first.get(tuple(w[j:j + 13]), 1 << 62), order(i))
    want = Counter()
    for (i, t), n in one.items():
        w, gone = (t or "").split(), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < order(i):
                gone.update(range(j, j + 13))
        want[(i, tuple(x for j, x in enumerate(w) if j not in gone))] += n
    cut = Counter((r.doc_id, tuple((r.text or "").split())) for r in seen["substring_dedup"].collect())
    assert cut == want

    mix = Counter((r.doc_id, tuple((r.text or "").split())) for r in seen["mixing"].collect())
    assert set(mix) <= set(cut) and all(n <= 2 * cut[x] for x, n in mix.items())
    packed = seen["best_fit_packing"].collect()
    fill = Counter()
    for r in packed:
        fill[r.bin_id] += r.n_words
    assert max(fill.values()) <= 4096 and sum(fill.values()) == sum(len(w) * n for (_, w), n in mix.items())
    result = Counter((r.doc_id, r.n_words) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert result == Counter((r.doc_id, r.n_words) for r in packed) == Counter({k: n for k, n in sum(
        (Counter({(i, len(w)): n}) for (i, w), n in mix.items()), Counter()).items()})


def test_mixing_stage_with_clashing_names_and_no_rows(spark, rows):
    names = ("size", "quality", "target", "source_size", "copies", "taken", "__key", "__w", "__c", "row")
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], SCHEMA + "".join(f", {n} int" for n in names)).repartition(3)
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= {(*r, *range(len(names))) for r in rows}
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), "").count() == 0


def test_draws_of_rows_without_id_do_not_depend_on_partitions(spark):
    rows = [(None, f"text number {i}", "s", 10 + i % 7) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").selectExpr("*", "1.0 as quality")
    from panelrec.llm import mixing
    taken = [sorted(map(tuple, mixing.mixed(table.repartition(n)).select("text", "copies").collect())) for n in (2, 7)]
    assert taken[0] == taken[1] and len({c for _, c in taken[0]}) > 1
