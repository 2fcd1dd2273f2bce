"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from panelrec.llm import merkle

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, n int, pos string, digest string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, text, source, lang, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def walk(levels, i, digest, proof):
    for level in levels[:-1]:
        run = level[i // 3 * 3:i // 3 * 3 + 3]
        at = i % 3
        proof += run[:at] + run[at + 1:]
        digest = sha("".join(run[:at] + [digest] + run[at + 1:]))
        i //= 3
    return digest


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf(*r[:5]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = {name: tree([x for x, _ in groups[name]]) for name in names}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for q, name in enumerate(names):
        for i, (own, (doc_id, text, source, lang, n_chars, *_)) in enumerate(groups[name]):
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            proof = []
            folded = walk(trees[name], i, leaf(doc_id, text, source, lang, n_chars), proof)
            folded = walk(top, q, folded, proof)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rows = [(i, f"line {i}\nmore\n" if i % 3 else f"no feed {i}", "hot" if i % 2 else f"s{i % 7}", "en", i) for i in range(120)]
    rows += [(500, None, "s1", None, None), (501, "", "s2", "en", 0), (502, "é漢\n", None, "de", 3), (None, "x\n", None, "en", 1), (None, "y\n", None, "en", 1)]
    rows += [(7, "again\n", "hot", "en", 5)] * 4 + [(600, "long\n" * 50_000, "alone", "en", 250_000)]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_proofs(spark, rows, stride):
    out = merkle.verified(spark.createDataFrame(rows, SCHEMA).repartition(5), stride)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert {x[-1] for x in want} == {True, False}


def test_one_row_and_none(spark, rows):
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert [tuple(r) for r in merkle.verified(one).collect()] == brute(rows[:1])
    assert merkle.verified(one.limit(0)).count() == 0


def test_numbers_are_gapless_and_setting_comes_back(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "12345")
    table = spark.range(5000).selectExpr("if(id < 3000, 'a', null) as g", "id div 500 as k")
    got = merkle.numbered(table, ["g"], ["k"]).groupBy("g", "n").agg({"pos": "max", "k": "count"}).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 3000, 2999, 3000), (None, 2000, 1999, 2000)]
    merkle.verified(spark.createDataFrame([(1, "a", "s", "en", 1, 1, "", "")], SCHEMA))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "12345"
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
