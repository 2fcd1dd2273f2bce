"""Many equal rows in the packing."""

from collections import Counter

from panelrec.llm import packing


def test_equal_rows_spread_over_groups(spark):
    n, limit = 6000, 200
    docs = spark.range(n).selectExpr(
        "if(id % 3 = 0, null, id) doc_id", "'s' source", "if(id % 3 = 0, 5L, id % 50) size", "if(id % 3 = 0, 7L, id) cluster").repartition(4)
    got = packing.packed(docs, capacity=100, rows_per_group=limit).collect()
    groups = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(got) == n and max(groups.values()) <= 2 * limit
    equal = Counter(r.bin_id for r in got if r.doc_id is None)
    assert sum(equal.values()) == n // 3 and max(equal.values()) == 1
    assert Counter(r.doc_id for r in got if r.doc_id is not None) == Counter({i: 1 for i in range(n) if i % 3})
