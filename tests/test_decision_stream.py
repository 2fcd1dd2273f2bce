"""The decision stream with held items, newest recommendations, telemetry and latency; keyed table; sessions."""

import glob
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrec.streaming import jobs as J
from panelrec.streaming.keyed import KeyedTable
from panelrec.streaming.state import session_stream, sessions
from panelrec.streaming.telemetry import Tail, last_decisions, telemetry_of

T0 = datetime(2024, 1, 1)
SHAPE = "event_id long, ts timestamp, user_id long, action string, item int"
STORE = "user_id long, vector array<double>, held array<int>, updated_at timestamp"


def at(hours):
    return T0 + timedelta(hours=hours)


def append(spark, rows, path, shape=SHAPE):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None


@pytest.fixture
def job(spark, tmp_path):
    probs = spark.createDataFrame([(7, [0.1] + [0.02] * 2 + [0.5, 0.2] + [0.16 / 11] * 11)], "user_id long, probs array<double>")
    store = spark.createDataFrame([(7, [0.9], [1], at(0)), (8, [0.1], [], at(0))], STORE)
    paths = {n: str(tmp_path / n) for n in ("src", "log", "recs", "tail", "latency", "ckpt")}
    outputs = J.Outputs(paths["log"], J.recs_table(paths["recs"], 4), Tail(paths["tail"], 3), paths["latency"])
    sink = J.decision_sink(
        outputs, lambda s: store, {"purchase": (3, 4)},
        lambda df: df.join(probs, "user_id", "left").select(*df.columns, "probs"), lambda df: df.withColumn("p_buy", F.get("vector", F.lit(0))), 1)

    def run():
        events = J.held_items(J.event_stream(spark, paths["src"]))
        finish(J.start_decisions(events, sink, paths["ckpt"]))

    return run, sink, outputs, paths


def test_claimed_items_are_not_recommended_again(spark, job):
    run, sink, outputs, paths = job
    append(spark, [(1, at(1), 7, "purchase", None), (2, at(2), 7, "claim_offer", 3), (3, at(3), 7, "purchase", None)], paths["src"])
    run()
    append(spark, [(4, at(4), 7, "purchase", None), (5, at(4), 8, "purchase", None), (6, at(5), 9, "purchase", None)], paths["src"])
    run()  # a new query from the same checkpoint: state and read position are found again
    rows = {r.event_id: r for r in J.read_log(spark, paths["log"]).collect()}
    assert rows[1].prediction == 3 and rows[1].held == [1] and 1 not in rows[1].recs
    assert rows[2].held == [1]  # an acquisition is held from the next event on
    assert rows[3].prediction == 4 and rows[3].held == [1, 3] and 3 not in rows[3].recs
    assert rows[4].prediction == 4 and rows[4].held == [1, 3] and 3 not in rows[4].recs
    assert rows[6].source == "unknown" and rows[6].regime == "stage1_cpu_hold"

    newest = {r.user_id: r for r in outputs.recs.read(spark).collect()}
    assert {u: r.event_id for u, r in newest.items()} == {7: 4, 8: 5, 9: 6}
    assert newest[7].expires_at == at(5) and newest[7].recs[0] == 4
    now = F.lit(at(5.5)).cast("timestamp")
    assert [r.user_id for r in J.current(outputs.recs.read(spark), now).collect()] == [9]

    told = outputs.tail.telemetry(spark).first()
    assert (told.n_events, told.total_events) == (3, 6) and told.active_pct == pytest.approx(100 / 3)
    delays = {r.batch_id: r for r in J.read_log(spark, paths["latency"]).collect()}
    assert [delays[b].n_events for b in (0, 1)] == [3, 3]
    age = (delays[1].decided_at - at(4)).total_seconds() * 1000
    assert delays[1].max_ms == pytest.approx(age, abs=1) and delays[1].mean_ms == pytest.approx(age - 1_200_000, abs=1)

    before = sorted(map(str, outputs.recs.read(spark).collect()))
    batch = spark.createDataFrame([(*e, h) for e, h in zip(
        [(4, at(4), 7, "purchase", None), (5, at(4), 8, "purchase", None), (6, at(5), 9, "purchase", None)], [[3], [], []])], SHAPE + ", held array<int>")
    sink(batch, 1)  # the same batch again
    assert J.read_log(spark, paths["log"]).count() == 6
    assert sorted(map(str, outputs.recs.read(spark).collect())) == before
    assert outputs.tail.telemetry(spark).first().total_events == 6


def test_expired_recommendations_go_with_compaction(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), J.RECS_COLUMNS, ("user_id",), ("ts", "event_id"), 2)
    for b in range(4):
        rows = [(u, 10 * b + u, at(b + u), "a", 1, [1], True, "r", at(b + u + 1)) for u in (1, 2)]
        table.write(spark.createDataFrame(rows, J.RECS_COLUMNS), b)
    now = F.lit(at(5.5)).cast("timestamp")
    assert table.compact(spark, above=2, keep=F.col("expires_at") > now)
    stored = spark.read.parquet(table.path)
    assert [(r.user_id, r.event_id) for r in stored.collect()] == [(2, 32)]


# ----------------------------------------------------------------- keyed table

ROW = "k long, s string, t int, v string"


def test_keyed_table_reads_touched_buckets_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ROW, ("k", "s"), ("t",), 16)
    assert table.read(spark).count() == 0
    want = {}
    rng = random.Random(1)
    for b in range(6):
        rows = [(rng.randrange(200), None if i % 9 == 0 else "x", rng.randrange(3), f"{b}-{i}") for i in range(150)]
        rows = list({(r[0], r[1]): r for r in rows}.values())
        table.write(spark.createDataFrame(rows, ROW), b)
        for r in rows:
            if (r[0], r[1]) not in want or r[2] >= want[r[0], r[1]][2]:
                want[r[0], r[1]] = r
    key = lambda r: str(r)
    assert sorted(map(tuple, table.read(spark).collect()), key=key) == sorted(want.values(), key=key)

    asked = spark.createDataFrame([(k, "x") for k in (3, 4)] + [(9999, "x")], "k long, s string")
    found = table.read(spark, asked)
    files = found.inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= 3 and len(files) <= 3 * 6 < len(glob.glob(f"{table.path}/*/*/*.parquet"))
    assert sorted(r.k for r in found.collect()) == [k for k in (3, 4) if (k, "x") in want]

    table.write(spark.createDataFrame(rows, ROW), 5)  # a replay replaces its own part
    assert len(table.compact(spark, above=3)) == 16 and table.compact(spark, above=3) == []
    assert len(glob.glob(f"{table.path}/*/*")) == 16
    assert sorted(map(tuple, table.read(spark).collect()), key=key) == sorted(want.values(), key=key)
    table.write(spark.createDataFrame([(3, "x", 9, "new")], ROW), 6)
    assert [r.v for r in table.read(spark, asked.where("k = 3")).collect()] == ["new"]


# ------------------------------------------------------------------- telemetry

DECISION = "event_id long, ts timestamp, action string, regime string, is_active boolean, latency_ms double"


def test_tail_equals_the_newest_of_the_whole_log(spark, tmp_path):
    tail, rng = Tail(str(tmp_path / "tail"), 25), random.Random(2)
    zeros = tail.telemetry(spark).first()
    assert tuple(zeros) == (0, 0, 0.0, 0.0, 0.0, 0.0, "", "")
    log = []
    for b in range(4):
        rows = [(100 * b + i, at(rng.randrange(40)), rng.choice(["view", "buy", None]), rng.choice("ab"), rng.random() < 0.4, float(rng.randrange(90))) for i in range(20)]
        log += rows
        tail.add(spark.createDataFrame(rows, DECISION), b)
    tail.add(spark.createDataFrame(rows, DECISION), 3)
    got = tail.telemetry(spark).first()
    whole = telemetry_of(last_decisions(spark.createDataFrame(log, DECISION), 25), F.lit(80)).first()
    assert got == whole
    kept = sorted(log, key=lambda r: (r[1], r[0]))[-25:]
    assert got.p95 == pytest.approx(np.percentile([r[5] for r in kept], 95)) and got.total_events == 80
    assert got.active_pct == pytest.approx(np.mean([r[4] for r in kept]) * 100) and got.active_pct + got.silent_pct == 100
    names = [r[2] or "unknown" for r in kept]
    assert got.action_mix == ",".join(f"{a}:{names.count(a)}" for a in sorted(set(names), key=lambda a: (-names.count(a), a)))
    assert len(glob.glob(f"{tail.path}/version=*")) <= 3


# -------------------------------------------------------------------- sessions

def brute_sessions(rows, gap):
    out = []
    for user in {r[2] for r in rows}:
        times = sorted((r[1], r[4] is not None) for r in rows if r[2] == user)
        for t, got in times:
            if out and out[-1][0] == user and (t - out[-1][2]).total_seconds() <= gap:
                out[-1] = (user, out[-1][1], t, out[-1][3] + 1, out[-1][4] + got)
            else:
                out.append((user, t, t, 1, int(got)))
    return sorted(out, key=str)


def test_sessions_stream_and_batch(spark, tmp_path):
    rng, src, ckpt = random.Random(4), str(tmp_path / "src"), str(tmp_path / "ckpt")
    rows = [(i, T0 + timedelta(seconds=rng.randrange(40_000)), rng.choice([1, 2, 3]), "a", rng.choice([None, 5])) for i in range(120)]
    rows += [(200, at(20), 4, "a", None), (201, at(20.5), 4, "a", None), (202, at(20.5) + timedelta(seconds=1801), 4, "a", 1)]
    want = brute_sessions(rows, 1800)
    batch = sessions(spark.createDataFrame(rows, SHAPE))
    assert sorted(map(tuple, batch.collect()), key=str) == want
    assert sessions(spark.createDataFrame([(1, None, 1, "a", None)], SHAPE)).count() == 0

    def run():
        stream = session_stream(J.event_stream(spark, src), delay="24 hours")
        finish(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())

    late = [r for r in rows if r[0] % 7 == 0]
    append(spark, [r for r in rows if r[0] % 7], src)
    run()
    append(spark, late, src)  # late events extend and join open sessions
    run()
    append(spark, [(999, at(24 * 30), 9, "a", None)], src)
    run()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got, key=str) == want
