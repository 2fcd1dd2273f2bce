"""Windows of differing paths are counted an equal part of the anchors at a time, and nothing of it stays on disk."""

import random

from panelrec.llm import repeats
from panelrec.llm.common import keyed


def test_no_pass_holds_all_windows(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    shared = [word(rng.randrange(20, 40)) for _ in range(60)]
    texts = [" ".join(word(15) + rng.choice(shared) + word(15) + rng.choice(shared) + word(15)) for _ in range(150)]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    held, kept, gone = [], repeats.staged, []

    def watched(table):
        out = kept(table)
        if "w" in out.columns:
            held.append((out.count(), {r.a for r in out.select("a").distinct().collect()}))
        return out

    monkeypatch.setattr(repeats, "staged", watched)
    monkeypatch.setattr(repeats, "discard", lambda *tables, drop=repeats.discard: (gone.extend(t.columns for t in tables), drop(*tables)))
    rule = repeats.Rule("word", 13, 5, earlier=True)
    found = {r.key: r.spans for r in repeats.repeated_spans(docs, rule).collect()}
    assert len(held) == 2 and not held[0][1] & held[1][1]
    total = sum(n for n, _ in held)
    assert total > 1000 and max(n for n, _ in held) < 0.7 * total
    assert sum("w" in columns for columns in gone) == 2
    seen = {}
    for i, text in enumerate(texts):
        words = text.split()
        windows = [tuple(words[j:j + 13]) for j in range(len(words) - 12)]
        want = {p for j, w in enumerate(windows) if seen.setdefault(w, i) < i for p in range(j, j + 13)}
        assert {p for s in found.get(i, []) for p in range(s.start, s.end)} == want
