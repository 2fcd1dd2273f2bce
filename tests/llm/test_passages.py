"""Toxic passages that repeat words said before in the same text."""

import random

from panelrec.llm import toxicity


def test_later_passages_count_in_full(spark):
    rng = random.Random(5)
    clean = lambda n: [f"n{rng.randrange(300)}" for _ in range(n)]
    bad = [f"bad{i}" for i in range(10)]
    rows = [(i, " ".join(clean(25) + (rng.sample(bad, 10) if i % 5 == 0 else clean(10)) + clean(25))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    stray = [w for b in bad for w in [b, *clean(60)]]
    texts = {
        1: clean(300) + bad + clean(600) + bad + clean(300),
        2: bad[:1] + clean(120) + bad + clean(120) + bad + clean(50),
        3: stray + clean(2000) + bad + clean(100),
        4: clean(400),
    }
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    holds = lambda i, at: any(p.start <= at and at + 10 <= p.end for p in got[i].passages)
    assert holds(1, 300) and holds(1, 910) and holds(2, 121) and holds(2, 251) and holds(3, len(stray) + 2000)
    assert min(got[i].score for i in (1, 2, 3)) >= 0.3 > got[4].score and not got[4].passages
