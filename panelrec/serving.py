"""Serving features: all fits of the panel in one versioned bundle, the same for whole tables and for streams.

A bundle turns clean panel rows into the vector and held list of each entity's newest snapshot: capped categories, lags,
fitted medians and codes, the fitted z-score, clipping, padding. A batch job upserts the whole panel's vectors; the stream
sink keeps each entity's history and upserts the vectors of the entities a batch touches, by the same code.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec import config as C
from panelrec.config import BANK_PANEL, PanelSpec
from panelrec.functions import arrays as A
from panelrec.jobs import BatchJob
from panelrec.operators import clean as K
from panelrec.operators import encode as E
from panelrec.operators import panel as P
from panelrec.streaming.keyed import KeyedTable

VECTOR_COLUMNS = "vector array<float>, held array<int>, updated_at date"


@dataclass(frozen=True)
class Bundle:
    """Fits of one version; ``features`` is the order of a vector's cells."""

    spec: PanelSpec
    version: int
    tops: dict[str, DataFrame]
    medians: DataFrame
    codes: DataFrame
    categorical: tuple[str, ...]
    features: tuple[str, ...]
    mean: float
    std: float

    # ---- keeping

    @staticmethod
    def fit(job: BatchJob, version: int = 1) -> Bundle:
        """The fits a batch job made on its training part."""
        features, stats = job.features(), job.stats().first()
        tops = {c: job.spark.read.parquet(f"{job.out}/top_{c}") for c in ("entry_channel", "residence_country")}
        return Bundle(
            job.spec, version, tops, job.spark.read.parquet(f"{job.out}/province_medians"), job.codes(),
            tuple(K.column_roles(features)["categorical"]), tuple(K.feature_columns(features)), stats["mean"], stats["std"])

    def save(self, path: str) -> str:
        """Write the bundle as ``path/version=<n>``; its list of contents comes last, so a part of a bundle is never loaded."""
        folder = f"{path}/version={self.version}"
        for name, table in {**{f"top_{c}": t for c, t in self.tops.items()}, "medians": self.medians, "codes": self.codes}.items():
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
        told = json.dumps({"tops": list(self.tops), "categorical": self.categorical, "features": self.features, "mean": self.mean, "std": self.std})
        spark = self.codes.sparkSession
        spark.createDataFrame([(told,)], "contents string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/contents")
        return folder

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None, spec: PanelSpec = BANK_PANEL) -> Bundle:
        """A version of the bundle, the newest complete one unless named."""
        if version is None:
            version = max(_versions(spark, path))
        folder = f"{path}/version={version}"
        told = json.loads(spark.read.parquet(f"{folder}/contents").first()["contents"])
        tops = {c: spark.read.parquet(f"{folder}/top_{c}") for c in told["tops"]}
        return Bundle(
            spec, version, tops, spark.read.parquet(f"{folder}/medians"), spark.read.parquet(f"{folder}/codes"),
            tuple(told["categorical"]), tuple(told["features"]), told["mean"], told["std"])

    # ---- applying

    def vectors(self, panel: DataFrame) -> DataFrame:
        """``(entity, vector, held, updated_at)`` of each entity's newest snapshot in ``panel`` (clean rows, all its history)."""
        capped = K.cap_categories(panel, self.tops, fill=["province_code"])
        rows = P.serving_features(capped, self.spec, self.medians)
        held = A.flagged([(F.col(f"has_{i}_lag1"), F.lit(n)) for n, i in enumerate(self.spec.targets, 1)])
        marked = rows.withColumn("_held", held).withColumn("_day", F.col(self.spec.time))
        scaled = E.encode_and_scale(marked, self.codes, self.categorical, self.features, self.mean, self.std, C.CODE_OVERRIDES, C.CLIP)
        cells = A.pad(A.assemble([F.col(c) for c in self.features]), C.VECTOR_WIDTH, strict=True)
        return scaled.select(
            self.spec.entity, cells.cast("array<float>").alias("vector"), F.col("_held").alias("held"), F.col("_day").cast("date").alias("updated_at"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath() for f in store.listStatus(root)]
    whole = [p for p in names if p.getName().startswith("version=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "contents/_SUCCESS"))]
    return [int(p.getName().split("=")[1]) for p in whole]


def vector_table(path: str, spec: PanelSpec = BANK_PANEL, kind: str = "string", buckets: int = 64) -> KeyedTable:
    """Newest vector of every entity."""
    return KeyedTable(path, f"{spec.entity} {kind}, {VECTOR_COLUMNS}", (spec.entity,), ("updated_at",), buckets)


def history_table(path: str, panel: DataFrame, spec: PanelSpec = BANK_PANEL, buckets: int = 64) -> KeyedTable:
    """All snapshots of every entity, those of one entity in one bucket; a snapshot sent again replaces the earlier one."""
    schema = ", ".join(f"`{name}` {kind}" for name, kind in panel.dtypes)
    return KeyedTable(path, schema, (spec.entity, spec.time), (spec.time,), buckets, (spec.entity,))


def materialize_vectors(bundle: Bundle, panel: DataFrame, table: KeyedTable, batch_id: int = 0) -> None:
    """Vectors of every entity of a whole panel, in one job, upserted."""
    table.write(bundle.vectors(panel), batch_id)


def snapshot_sink(bundles: Callable[[SparkSession], Bundle], history: KeyedTable, table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """Batch function for a stream of clean snapshots: keep them, then upsert the vectors of the entities they belong to.

    The bundle is looked up for each batch, so a new version is taken up without a restart. Both tables take a batch that
    is sent again as the same batch.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history.write(batch, batch_id)
        bundle = bundles(spark)
        table.write(bundle.vectors(history.read(spark, batch)), batch_id)

    return run
