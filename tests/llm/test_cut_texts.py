"""op4's operator returns spans and texts, and the query's digests come from them."""

import hashlib
import random
from collections import Counter

from panelrec.llm import queries, substrings


def brute(texts, size):
    count = Counter(b[j:j + size] for b in texts for j in range(len(b) - size + 1))
    for b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if count[b[j:j + size]] > 1:
                gone[j:j + size] = b"\1" * size
        yield gone


def cut(b, gone):
    """Maximal spans, kept bytes, and the text of the characters that lose no byte."""
    edges = [j for j in range(len(b) + 1) if (j < len(b) and gone[j]) != (j > 0 and bool(gone[j - 1]))]
    text, at = "", 0
    for c in b.decode():
        n = len(c.encode())
        text, at = text + ("" if any(gone[at:at + n]) else c), at + n
    return list(zip(edges[::2], edges[1::2])), bytes(x for x, g in zip(b, gone) if not g), text


def test_spans_and_texts(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdé漢😀 ") for _ in range(n))
    shared = make(60)
    # 'é' and 'ã' share their first byte, '漢' and '漣' their first two: matches begin and end inside characters
    texts = [make(30) + "é" + shared + "漢" + make(20), make(10) + "ã" + shared + "漣" + make(40), make(150), None, "", shared, shared,
             make(25) + shared + "x" + shared, "漢" * 120, "a" * 45]
    want = {}
    raw = [(t or "").encode() for t in texts]
    for i, (b, gone) in enumerate(zip(raw, brute(raw, 50))):
        want[i] = (len(b), *cut(b, gone))
    assert any(len(w[2]) > len(w[3].encode()) for w in want.values()) and sum(len(w[1]) > 0 for w in want.values()) > 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept), r.text) for r in substrings.deduplicated(docs, 50, 20).collect()}
    assert got == want


def test_query_shows_what_it_digests(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in queries.read(spark, sf, "documents").collect()}
    rows = queries.op4_suffix_array_dedup(spark, sf).collect()
    assert rows[0].__fields__ == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
    assert len(rows) == len(docs) and sum(r.n_removed > 0 for r in rows) > 0
    for r in rows:
        b, gone = docs[r.doc_id], bytearray(len(docs[r.doc_id]))
        for lo, hi in r.spans:
            gone[lo:hi] = b"\1" * (hi - lo)
        spans, kept, text = cut(b, gone)
        assert ([tuple(s) for s in r.spans], r.text) == (spans, text)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest())
