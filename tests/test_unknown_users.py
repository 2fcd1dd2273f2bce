"""Users without a score row keep their events in every decision path, on Spark and in the SQL twins."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from panelrec.plans import QUERIES, TWINS  # noqa: E402
from panelrec.plans import views as V  # noqa: E402
from tools.parity import compare  # noqa: E402

PATHS = ("cascade_route", "cascade_on_events", "decision_payload", "replay_report", "audit_matches", "regime_mix", "latency_percentiles",
         "recs_latest", "recs_stored", "daily_telemetry", "stream_telemetry", "audit_trail", "action_relevance", "held_decisions")


@pytest.fixture(scope="module")
def half(spark, sf, tmp_path_factory):
    """The benchmark's tables, with score rows for every other user only."""
    folder = str(tmp_path_factory.mktemp("half"))
    for name in os.listdir(sf):
        if name != "embeddings.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 2 = 0").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for name in os.listdir(sf):
        where = f"{folder}/{name}" + ("/*.parquet" if name == "embeddings.parquet" else "")
        con.execute(f"create view {name[:-8]} as select * from '{where}'")
    return folder, con


@pytest.mark.parametrize("name", PATHS)
def test_same_on_both_sides(spark, half, name):
    _, note, _, _ = compare(spark, half[1], name, QUERIES[name], TWINS[name], half[0])
    assert note.startswith("ok"), note


def test_unknown_users_are_kept_and_flagged(spark, half, sf):
    out = V.decisions(spark, half[0])
    assert out.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    unknown = out.where("is_unknown")
    assert 0 < unknown.count() == out.where("user_id % 2 = 1").count()
    row = unknown.first()
    assert row.p_buy == 0.5 and row.held == [] and row.y is None and row.recs == list(range(1, 8))
