"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelrec.plans import QUERIES, TWINS  # noqa: E402
from tools.parity import compare  # noqa: E402


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_parity(spark, con, sf, name):
    _, note, _, _ = compare(spark, con, name, QUERIES[name], TWINS.get(name), sf)
    assert note.startswith("ok") or note == "rows only", note


def test_entry_runs(spark, sf):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["regime", "action", "n", "avg_p_buy"] and out.count() > 0
