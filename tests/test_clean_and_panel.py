from datetime import date

import pytest
from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.operators import clean as K
from panelrec.operators import panel as P

USUAL = {c: "0" for c in C.RAW_TO_CLEAN.values()} | {
    "join_date": "2013-06-30", "gender": "NA", "province_code": "41", "employee_index": "B",
    "residence_country": "PT", "entry_channel": "KHE", "customer_segment": "03 - U",
}


@pytest.fixture(scope="module")
def raw(spark):
    """Three months of one customer, one month of another without a join date."""
    rows = [
        USUAL | {
            "customer_id": "55", "snapshot_date": "2015-10-28", "gender": "V", "age": "  61 ", "seniority_months": "-99",
            "customer_type_month_start": "2.0", "relation_type_month_start": "P", "residence_status": "s",
            "is_foreigner": "S", "gross_household_income": " 40000.5", "funds": "1",
        },
        USUAL | {
            "customer_id": "55", "snapshot_date": "2015-11-28", "gender": "H", "age": "sixty", "seniority_months": "7",
            "customer_type_month_start": " NULL ", "relation_type_month_start": "nan", "residence_status": "N",
            "is_foreigner": "", "gross_household_income": "nan", "funds": "1", "taxes": "1",
        },
        USUAL | {
            "customer_id": "55", "snapshot_date": "2015-12-28", "age": "", "seniority_months": "8",
            "customer_type_month_start": "3", "relation_type_month_start": "A", "residence_status": "S",
            "is_foreigner": "N", "gross_household_income": "60000.5", "taxes": "1", "employee_index": "NA",
        },
        USUAL | {"customer_id": "77", "snapshot_date": "2015-12-28", "join_date": "30/06/2013", "province_code": "50"},
    ]
    names = list(USUAL)
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} string" for c in names))


def test_clean_panel(raw):
    clean = K.clean_panel(raw)
    kinds = dict(clean.dtypes)
    got = clean.orderBy("snapshot_date").select(
        "customer_id", "gender", "age", "seniority_months", "customer_type_month_start", "relation_type_month_start",
        "residence_status", "is_foreigner", "gross_household_income", "employee_index",
    )
    assert [tuple(r) for r in got.collect()] == [
        ("55", "M", 61, 0, "2", "P", 1, 1, 40000.5, "B"),
        ("55", "F", None, 7, "UNKNOWN", "I", 0, 0, 50000.5, "B"),
        ("55", "Unknown", None, 8, "3", "A", 1, 0, 60000.5, "N"),
    ]
    assert {kinds[c] for c in ("snapshot_date", "join_date", "last_date_primary_customer")} == {"date"}
    assert {kinds[i] for i in C.TARGET_ITEMS + C.OTHER_ITEMS} == {"tinyint"}


def test_clean_to_features_has_catalog_columns(raw):
    features = P.panel_features(K.clean_panel(raw), C.BANK_PANEL)
    names = K.feature_columns(features)
    assert len(names) == 81
    rows = features.orderBy("snapshot_date").collect()
    assert [r["target_class"] for r in rows] == [15, 0]
    assert (rows[1]["has_taxes_lag1"], rows[1]["has_funds_lag1"], rows[1]["has_taxes_lag2"]) == (1, 1, 0)
    roles = K.column_roles(features)
    assert "province_code" in roles["categorical"] and "age" in roles["numeric"]


def _month(spark, months):
    base = dict(
        customer_id="c1", join_date=date(2015, 1, 15), address_type="1", province_name="M",
        province_code="28", gross_household_income=100000.0, age=35, is_active=1, last_date_primary_customer=None,
    )
    rows = []
    for m, held in months.items():
        row = {**base, "snapshot_date": date(2016, m, 28), "seniority_months": 12 + m}
        row.update({i: int(i in held) for i in C.TARGET_ITEMS + C.OTHER_ITEMS})
        rows.append(row)
    order = sorted(rows[0])
    kinds = {"customer_id": "string", "join_date": "date", "snapshot_date": "date", "address_type": "string",
             "province_name": "string", "province_code": "string", "gross_household_income": "double",
             "last_date_primary_customer": "date"}
    return spark.createDataFrame(
        [tuple(r[c] for c in order) for r in rows], ", ".join(f"{c} {kinds.get(c, 'int')}" for c in order))


def test_feature_values(spark):
    t = _month(spark, {2: {"mortgage"}, 3: {"mortgage", "payroll_account"}, 4: {"mortgage", "payroll_account", "loans", "securities"}})
    rows = {r["snapshot_date"].month: r for r in P.panel_features(t, C.BANK_PANEL).collect()}
    assert set(rows) == {3, 4} and (rows[3]["target_class"], rows[4]["target_class"]) == (2, 6)
    april = rows[4]
    assert (april["has_mortgage_lag1"], april["has_securities_lag1"], april["has_payroll_account_lag2"]) == (1, 0, 0)
    assert (april["total_products_lag1"], april["total_products_lag2"], april["delta_payroll_account"]) == (2, 0, 1)
    assert april["credit_bundle_lag1"] == pytest.approx(1 / 3) and april["payroll_eligible"] == april["pensions_eligible"] == 1
    assert april["income_to_province_ratio"] == 1.0 and april["is_tax_season"] == 1 and april["is_summer_season"] == 0
    assert april["months_as_customer"] == pytest.approx(15.4) and april["age_at_join"] == pytest.approx(33.7)
    assert (april["sin_month"], april["cos_month"]) == (0.866, -0.5)


def test_two_acquisitions_do_not_shift_lags(spark):
    t = _month(spark, {1: set(), 2: {"funds", "taxes"}, 3: {"funds", "taxes"}, 4: {"funds"}})
    rows = P.panel_features(t, C.BANK_PANEL).collect()
    by = sorted((r["snapshot_date"].month, r["target_class"]) for r in rows)
    assert by == [(2, 9), (2, 15), (3, 0), (4, 0)]
    march = next(r for r in rows if r["snapshot_date"].month == 3)
    assert march["has_taxes_lag1"] == 1 and march["has_taxes_lag2"] == 0


def test_gap_guard_and_history_flag(spark):
    t = _month(spark, {1: {"funds"}, 6: {"funds"}})
    plain = P.panel_features(t, C.BANK_PANEL, explode=False).collect()
    assert [r["target_class"] for r in plain] == [0]
    guarded = P.panel_features(t, C.BANK_PANEL, max_gap_months=2).collect()
    assert [r["target_class"] for r in guarded] == [9]
    first = P.panel_features(t, C.BANK_PANEL, require_history=False).orderBy("snapshot_date").first()
    assert first["target_class"] == 9


def test_holdout_targets(spark):
    def month(m, held):
        rows = [(who, date(2015, m, 28), *[int(i in h) for i in C.TARGET_ITEMS]) for who, h in held.items()]
        return spark.createDataFrame(rows, "customer_id string, snapshot_date date, " + ", ".join(f"{i} int" for i in C.TARGET_ITEMS))

    now = month(9, {"x": {"funds", "taxes", "pensions"}, "y": {"funds"}, "z": {"e_account"}})
    before = month(8, {"x": {"funds"}, "y": {"funds", "taxes"}})
    rows = {r["customer_id"]: r for r in P.holdout_targets(now, before, C.BANK_PANEL).collect()}
    assert {k: r["target_class"] for k, r in rows.items()} == {"x": 4, "y": 0, "z": 13}
    assert rows["x"]["target_classes"] == [4, 15] and rows["x"]["added_products"] == ["pensions", "taxes"]
    assert (rows["x"]["added_taxes"], rows["x"]["added_funds"]) == (1, 0) and rows["y"]["added_products"] == []


def test_cap_categories(spark):
    t = spark.createDataFrame([("a", "u"), ("b", None), (None, "v")], "channel string, region string")
    tops = {"channel": spark.createDataFrame([("a",)], "channel string")}
    rows = K.cap_categories(t, tops, fill=["region"]).collect()
    assert [tuple(r) for r in rows] == [("a", "u"), ("OTHER", "UNKNOWN"), ("OTHER", "v")]


def test_impute_falls_back_to_overall_median(spark):
    t = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 10.0), (None, None)], "g string, x double")
    got = sorted(((r[0] or "-"), r[1]) for r in K.impute_by_group(t, "x", "g").collect())
    assert got == [("-", 10.0), ("-", 10.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 3.0)]


def test_latest_keeps_ties(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "k int, t int")
    assert sorted(tuple(r) for r in K.latest_snapshot(t, "k", "t").collect()) == [(1, 2), (1, 2), (2, 5)]
    assert sorted(tuple(r) for r in K.latest_snapshot(t, "k", "t", unique=True).collect()) == [(1, 2), (2, 5)]
