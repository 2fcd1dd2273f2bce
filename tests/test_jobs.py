import csv
import random

import pytest
from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.jobs import BatchJob
from panelrec.operators import clean as K


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    rng = random.Random(3)
    back = {v: k for k, v in C.RAW_TO_CLEAN.items()}
    path = root / "raw.csv"
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(list(C.RAW_TO_CLEAN))
        for person in range(60):
            held = set()
            for month in range(1, 7):
                held |= {rng.choice(C.TARGET_ITEMS)} if rng.random() < 0.4 else set()
                row = dict.fromkeys(C.RAW_TO_CLEAN.values(), "0")
                row.update(
                    snapshot_date=f"2016-0{month}-28", customer_id=str(person), join_date="2014-05-01",
                    gender=rng.choice(["H", "V", "NA"]), age=str(20 + person), seniority_months=str(month + person),
                    province_code=rng.choice(["28", "08", ""]), gross_household_income=rng.choice(["NA", "50000.5", " 90000 "]),
                    entry_channel=rng.choice(["KAT", "KFC"]), residence_country="ES", is_active=rng.choice("01"),
                    customer_relation_primary=rng.choice(["1", "99"]), customer_segment="02", residence_status="S",
                    customer_type_month_start="1.0", relation_type_month_start="A", employee_index="N",
                )
                row.update({i: str(int(i in held)) for i in C.TARGET_ITEMS + C.OTHER_ITEMS})
                out.writerow([row[C.RAW_TO_CLEAN[c]] for c in C.RAW_TO_CLEAN])
    assert back["customer_id"] == "ncodpers"
    return BatchJob(spark, str(path), str(root / "out"), "2016-06-28")


def test_batch_run(job):
    context = job.run()
    rows = context.collect()
    assert rows and all(len(r["vector"]) == C.VECTOR_WIDTH for r in rows)
    assert all(-10.0 <= x <= 10.0 for r in rows for x in r["vector"])
    features = job.features()
    assert len(K.feature_columns(features)) == 81
    assert features.agg(F.max("snapshot_date")).first()[0].month == 5
    assert len(rows) == features.count()
    assert job.targets().count() == 60


def test_normalized_has_zero_mean(job):
    names = K.feature_columns(job.features())
    table = job.normalized()
    total = table.agg(F.avg(sum(F.col(c) for c in names)), F.avg(sum(F.col(c) * F.col(c) for c in names))).first()
    assert total[0] / len(names) == pytest.approx(0.0, abs=1e-9)
    assert total[1] / len(names) == pytest.approx(1.0)


def test_outputs_are_reused(job):
    assert job.features().inputFiles() == job.features().inputFiles()
    assert job.stats().first()["nulls"] == 0
    assert set(job.codes().select("column").distinct().toPandas()["column"]) >= {"gender", "province_code"}
