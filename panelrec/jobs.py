"""Batch jobs from the raw panel to encoded features and context vectors.

Each stage writes Parquet under one output folder and is skipped when its output
exists. Fits read the training part only and are written as small tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.config import BANK_PANEL, PanelSpec
from panelrec.functions import arrays as A
from panelrec.functions.scalars import draw_key
from panelrec.operators import clean as K
from panelrec.operators import encode as E
from panelrec.operators import panel as P
from panelrec.operators.sample import six_strata_sample
from panelrec.sources.tables import load_raw_panel, materialize, write_parquet

ROW_KEY = "row_key"


@dataclass(frozen=True)
class BatchJob:
    """Where a run reads and writes, and its holdout snapshot."""

    spark: SparkSession
    raw: str
    out: str
    holdout: str
    spec: PanelSpec = BANK_PANEL
    reuse: bool = True

    def _table(self, name: str, build, partition_by=()) -> DataFrame:
        return materialize(self.spark, build, f"{self.out}/{name}", self.reuse, partition_by)

    # ----------------------------------------------------------- clean, split

    def clean(self) -> DataFrame:
        def build() -> DataFrame:
            return K.clean_panel(load_raw_panel(self.spark, self.raw), self.spec.items)

        return self._table("clean", build, [self.spec.time])

    def targets(self) -> DataFrame:
        """Labels of the holdout snapshot against the month before."""
        def build() -> DataFrame:
            day = F.lit(self.holdout).cast("date")
            panel = self.clean()
            now = panel.where(F.col(self.spec.time) == day)
            before = panel.where(F.col(self.spec.time) == F.add_months(day, -1))
            return P.holdout_targets(now, before, self.spec)

        return self._table("targets", build)

    # --------------------------------------------------------------- features

    def features(self) -> DataFrame:
        def build() -> DataFrame:
            train, _ = K.temporal_split(self.clean(), self.spec.time, self.holdout)
            tops = {
                "entry_channel": K.top_categories(train, "entry_channel", C.TOP_CHANNELS),
                "residence_country": K.top_categories(train, "residence_country", C.TOP_COUNTRIES),
            }
            for name, top in tops.items():
                write_parquet(top, f"{self.out}/top_{name}")
            capped = K.cap_categories(train, tops, fill=["province_code"])
            medians = K.group_medians(capped, self.spec.group, self.spec.amount)
            write_parquet(medians, f"{self.out}/province_medians")
            fitted = self.spark.read.parquet(f"{self.out}/province_medians")
            return P.panel_features(capped, self.spec, medians=fitted)

        return self._table("features", build)

    # ----------------------------------------------------------------- encode

    def codes(self) -> DataFrame:
        roles = K.column_roles(self.features())
        return self._table("codes", lambda: E.fit_frequency_codes(self.features(), roles["categorical"]))

    def encoded(self) -> DataFrame:
        features = self.features()
        roles = K.column_roles(features)
        return E.apply_frequency_codes(features, self.codes(), roles["categorical"], C.CODE_OVERRIDES)

    def stats(self) -> DataFrame:
        names = K.feature_columns(self.features())
        return self._table("stats", lambda: E.global_stats(self.encoded(), names))

    def normalized(self) -> DataFrame:
        def build() -> DataFrame:
            row = self.stats().first()
            names = K.feature_columns(self.features())
            return E.apply_zscore(self.encoded(), names, row["mean"], row["std"])

        return self._table("normalized", build)

    # ----------------------------------------------------------------- export

    def context(self) -> DataFrame:
        """Stratified sample as (target_class, vector): clipped, padded, single precision."""
        def build() -> DataFrame:
            table = self.normalized()
            names = K.feature_columns(table)
            keyed = table.withColumn(
                ROW_KEY, draw_key(0, F.col(self.spec.entity), F.col(self.spec.time), F.col("target_class"))
            )
            sample = six_strata_sample(
                keyed, "target_class", f"{self.spec.activity}_lag1", self.spec.time, [ROW_KEY]
            )
            vector = A.pad(
                A.clip_vector(A.assemble([F.col(c) for c in names]), -C.CLIP, C.CLIP), C.VECTOR_WIDTH, strict=True
            )
            return sample.select("target_class", "stratum", vector.cast("array<float>").alias("vector"))

        return self._table("context", build)

    def run(self) -> DataFrame:
        self.targets()
        return self.context()
