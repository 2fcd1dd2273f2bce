"""Catalogs, quotas and thresholds shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Everything in this block must equal the published catalog and
# settings for results to agree; none of it is derived.
# ---------------------------------------------------------------------------

RAW_TO_CLEAN = {
    "fecha_dato": "snapshot_date",
    "ncodpers": "customer_id",
    "ind_empleado": "employee_index",
    "pais_residencia": "residence_country",
    "sexo": "gender",
    "age": "age",
    "fecha_alta": "join_date",
    "ind_nuevo": "is_new_customer",
    "antiguedad": "seniority_months",
    "indrel": "customer_relation_primary",
    "ult_fec_cli_1t": "last_date_primary_customer",
    "indrel_1mes": "customer_type_month_start",
    "tiprel_1mes": "relation_type_month_start",
    "indresi": "residence_status",
    "indext": "is_foreigner",
    "conyuemp": "spouse_employee_index",
    "canal_entrada": "entry_channel",
    "indfall": "is_deceased",
    "tipodom": "address_type",
    "cod_prov": "province_code",
    "nomprov": "province_name",
    "ind_actividad_cliente": "is_active",
    "renta": "gross_household_income",
    "segmento": "customer_segment",
    "ind_ahor_fin_ult1": "saving_account",
    "ind_aval_fin_ult1": "guarantees",
    "ind_cco_fin_ult1": "current_account",
    "ind_cder_fin_ult1": "derivative_account",
    "ind_cno_fin_ult1": "payroll_account",
    "ind_ctju_fin_ult1": "junior_account",
    "ind_ctma_fin_ult1": "more_particular_account",
    "ind_ctop_fin_ult1": "particular_account",
    "ind_ctpp_fin_ult1": "particular_plus_account",
    "ind_deco_fin_ult1": "short_term_deposits",
    "ind_deme_fin_ult1": "medium_term_deposits",
    "ind_dela_fin_ult1": "long_term_deposits",
    "ind_ecue_fin_ult1": "e_account",
    "ind_fond_fin_ult1": "funds",
    "ind_hip_fin_ult1": "mortgage",
    "ind_plan_fin_ult1": "pensions_plan",
    "ind_pres_fin_ult1": "loans",
    "ind_reca_fin_ult1": "taxes",
    "ind_tjcr_fin_ult1": "credit_card",
    "ind_valo_fin_ult1": "securities",
    "ind_viv_fin_ult1": "home_account",
    "ind_nomina_ult1": "payroll",
    "ind_nom_pens_ult1": "pensions",
    "ind_recibo_ult1": "direct_debit",
}

# Class id = position + 1; class 0 is "do_nothing".
TARGET_ITEMS = (
    "current_account", "payroll_account", "credit_card", "pensions", "mortgage",
    "securities", "particular_plus_account", "particular_account", "funds",
    "direct_debit", "payroll", "more_particular_account", "e_account",
    "long_term_deposits", "taxes",
)
OTHER_ITEMS = (
    "saving_account", "guarantees", "derivative_account", "junior_account",
    "short_term_deposits", "medium_term_deposits", "pensions_plan", "loans",
    "home_account",
)
LAG2_ITEMS = (
    "current_account", "payroll_account", "credit_card", "direct_debit", "payroll",
    "pensions", "particular_account", "e_account", "long_term_deposits", "taxes",
)
DELTA_ITEMS = (
    "current_account", "payroll_account", "credit_card", "direct_debit", "payroll",
    "particular_account", "e_account",
)
BUNDLES = {
    "payroll_bundle_lag1": ("payroll", "payroll_account", "direct_debit"),
    "investment_bundle_lag1": ("funds", "securities", "pensions_plan"),
    "credit_bundle_lag1": ("credit_card", "loans", "mortgage"),
    "savings_bundle_lag1": (
        "particular_account", "particular_plus_account", "more_particular_account",
    ),
}
ELIGIBILITY = {
    "payroll_eligible": ("payroll_account", "payroll"),
    "pensions_eligible": ("payroll_account", "pensions"),
}
HOLD_LABEL = "do_nothing"
NULL_TOKENS = ("NA", "", "nan", "NULL")
NON_FEATURE_COLUMNS = ("customer_id", "snapshot_date", "target_class")
EXPLICIT_CATEGORICALS = ("province_code", "customer_relation_primary")
CODE_OVERRIDES = {"customer_relation_primary": {"1": 0, "99": 1, "0": 2}}
SEASONS = {
    "is_tax_season": (4, 5, 6),
    "is_pension_season": (11, 12),
    "is_academic_season": (9, 10),
    "is_summer_season": (6, 7),
}
TOP_CHANNELS = 80
TOP_COUNTRIES = 30
VECTOR_WIDTH = 128
CLIP = 10.0
COLD_MONTHS = 3

GAMMA_CACHE = 0.20
GAMMA_LIVE = 0.30
THETA_NOISY = 6.0
THETA_CLEAN = 1.8
NOISY_CLASSES = (1, 7, 9, 14, 15)

RECS_TTL_SECONDS = 3600
FEATURE_TTL_SECONDS = 30 * 86400

ACTION_ITEMS = {
    "salary_deposit": ("direct_debit", "credit_card", "pensions", "payroll_account", "payroll"),
    "large_deposit": (
        "long_term_deposits", "funds", "securities", "mortgage", "particular_plus_account",
    ),
    "branch_inquiry": ("mortgage", "loans", "credit_card", "particular_account"),
    "tax_season_login": ("taxes", "pensions_plan", "funds"),
    "dormant_reactivation": ("current_account", "e_account", "particular_account"),
    "card_payment": (),
}
ACQUISITION_ACTIONS = ("claim_offer", "product_acquired")
REGIMES = (
    "stage1_cpu_hold", "stage2_gate1c_hold", "candidate_a_silent_cache",
    "candidate_c_live_push",
)
PRECISION_TIERS = {
    "moderate": ((70.0, 1.0), (45.0, 1.5), (30.0, 2.5), (None, 3.5)),
    "strict": ((70.0, 1.0), (45.0, 1.5), (30.0, 3.0), (None, 4.5)),
}
ASCENT_THETAS = (1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0)
SIX_STRATA_QUOTAS = {
    "buyer_recent": 3000, "buyer_old": 1000, "active_recent": 21000,
    "active_old": 9000, "inactive_recent": 7000, "inactive_old": 3000,
}
# ------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of an entity-by-snapshot panel.

    A panel holds one row per entity and snapshot date, so an entity never has
    more rows than there are snapshots; every entity window relies on that.
    """

    entity: str
    time: str
    targets: tuple[str, ...]
    others: tuple[str, ...] = ()
    lag2: tuple[str, ...] = ()
    deltas: tuple[str, ...] = ()
    bundles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    eligibility: dict[str, tuple[str, str]] = field(default_factory=dict)
    activity: str | None = None
    amount: str | None = None
    group: str | None = None
    joined: str | None = None
    age: str | None = None
    tenure: str | None = None
    drop: tuple[str, ...] = ()

    @property
    def items(self) -> tuple[str, ...]:
        return self.targets + self.others


BANK_PANEL = PanelSpec(
    entity="customer_id",
    time="snapshot_date",
    targets=TARGET_ITEMS,
    others=OTHER_ITEMS,
    lag2=LAG2_ITEMS,
    deltas=DELTA_ITEMS,
    bundles=BUNDLES,
    eligibility=ELIGIBILITY,
    activity="is_active",
    amount="gross_household_income",
    group="province_code",
    joined="join_date",
    age="age",
    tenure="seniority_months",
    drop=(
        "join_date", "last_date_primary_customer", "address_type", "province_name",
        "is_active", "gross_household_income",
    ),
)


@dataclass(frozen=True)
class CascadeSpec:
    """Thresholds of the score, gate and route cascade."""

    gamma_cache: float = GAMMA_CACHE
    gamma_live: float = GAMMA_LIVE
    theta_noisy: float = THETA_NOISY
    theta_clean: float = THETA_CLEAN
    noisy: tuple[int, ...] = NOISY_CLASSES
    top_k: int = 7
    gate_on: str = "candidate"
