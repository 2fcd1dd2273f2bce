"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelrec", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; on a cluster leave ``master`` unset and let submit decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # list state inside streams needs this store
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staged(df: DataFrame) -> DataFrame:
    """Write an intermediate that several passes read, and read it back.

    The table goes to the shared checkpoint folder as Parquet, so later passes prune
    columns, know its size, and start from it when an executor is lost.
    """
    path = f"{checkpoint_root(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and cut lineage, taken from ``spark.checkpoint.dir``.

    A local folder is used only when the session names none and runs in local mode.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = os.path.join(tempfile.gettempdir(), "panelrec-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named
