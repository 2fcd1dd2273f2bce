"""One bundle of fits for batch and stream: newest snapshot to vector, held list and upsert."""

import pytest
from pyspark.sql import functions as F
from test_jobs import job  # noqa: F401  the batch job's fixture

from panelrec import config as C
from panelrec.operators import clean as K
from panelrec.serving import Bundle, history_table, materialize_vectors, snapshot_sink, vector_table


@pytest.fixture(scope="module")
def bundle(spark, job, tmp_path_factory):  # noqa: F811
    path = str(tmp_path_factory.mktemp("bundle"))
    fitted = Bundle.fit(job)
    fitted.save(path)
    spark.range(1).write.parquet(f"{path}/version=7/medians")  # a bundle that was never finished
    return Bundle.load(spark, path)


def rows_of(table):
    return sorted((r["customer_id"], r["updated_at"], tuple(r["held"]), tuple(r["vector"])) for r in table.collect())


def test_stream_and_batch_give_equal_vectors(spark, job, bundle, tmp_path):  # noqa: F811
    assert bundle.version == 1
    panel = job.clean()
    kind = dict(panel.dtypes)["customer_id"]
    whole = vector_table(str(tmp_path / "whole"), kind=kind, buckets=4)
    materialize_vectors(bundle, panel, whole)
    want = rows_of(whole.read(spark))
    assert len(want) == 60 and all(len(v) == C.VECTOR_WIDTH and max(map(abs, v)) <= C.CLIP for *_, v in want)
    assert {d.month for _, d, _, _ in want} == {6} and any(h for _, _, h, _ in want)

    table = vector_table(str(tmp_path / "stream"), kind=kind, buckets=4)
    sink = snapshot_sink(lambda s: bundle, history_table(str(tmp_path / "history"), panel, buckets=4), table)
    src, ckpt = str(tmp_path / "src"), str(tmp_path / "ckpt")
    for months in ((1, 2, 3), (4, 5), (6,)):
        panel.where(F.month("snapshot_date").isin(*months)).coalesce(1).write.mode("append").parquet(src)
        q = spark.readStream.schema(panel.schema).parquet(src).writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    assert rows_of(table.read(spark)) == want
    sink(panel.where(F.month("snapshot_date") == 6), 2)  # the last batch again
    assert rows_of(table.read(spark)) == want


def test_vectors_agree_with_the_batch_job(spark, job, bundle):  # noqa: F811
    """On the training snapshots the serving path gives the batch job's normalised, clipped features."""
    train = job.clean().where(F.month("snapshot_date") < 6)
    names = K.feature_columns(job.features())
    newest = job.normalized().where(F.month("snapshot_date") == 5).dropDuplicates(["customer_id"])
    want = {r["customer_id"]: [max(-C.CLIP, min(C.CLIP, r[c])) for c in names] for r in newest.collect()}
    got = {r["customer_id"]: r["vector"] for r in bundle.vectors(train).collect()}
    assert set(got) == set(want) and len(want) == 60
    for who, cells in want.items():
        assert got[who][:len(names)] == pytest.approx(cells, abs=1e-5) and not any(got[who][len(names):])
