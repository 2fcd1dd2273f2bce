"""A passage that most documents hold is dealt out over tasks when its paths meet their anchor."""

import random

import pytest

from panelrec.llm import repeats
from panelrec.llm.common import keyed

CONF = {
    "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("earlier", [True, False])
def test_hot_anchor_is_split(spark, small_splits, monkeypatch, capsys, earlier):
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    hot = word(14)
    texts = [" ".join(word(9) + hot + word(9)) if i % 10 else " ".join(word(30)) for i in range(1500)]
    docs = keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    plans, kept = [], repeats.staged

    def watched(table):
        if {"mixed", "key"} <= set(table.columns):
            table.collect()
            capsys.readouterr()
            table.explain()
            plans.append(capsys.readouterr().out)
        return kept(table)

    monkeypatch.setattr(repeats, "staged", watched)
    found = {r.key: r.spans for r in repeats.repeated_spans(docs, repeats.Rule("word", 13, 5, earlier=earlier)).collect()}
    assert len(plans) == 1 and "isFinalPlan=true" in plans[0] and "skew=true" in plans[0]
    starts = {}
    for i, text in enumerate(texts):
        words = text.split()
        for j in range(len(words) - 12):
            starts.setdefault(tuple(words[j:j + 13]), []).append((i, j))
    want = {}
    for at in starts.values():
        for i, j in at:
            if (min(at)[0] < i) if earlier else len(at) > 1:
                want.setdefault(i, set()).update(range(j, j + 13))
    assert {i: {p for s in spans for p in range(s.start, s.end)} for i, spans in found.items()} == want
