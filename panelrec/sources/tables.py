"""Readers and writers of panels, lookups and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelrec.config import RAW_TO_CLEAN


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_csv_strings(
    spark: SparkSession, path: str, columns: Sequence[str] = tuple(RAW_TO_CLEAN), null_value: str = "NA"
) -> DataFrame:
    """CSV with a header, every column text; further null tokens go through cleaning."""
    return (
        spark.read.schema(string_schema(columns)).option("header", True).option("nullValue", null_value)
        .csv(path)
    )


def load_raw_panel(spark: SparkSession, path: str) -> DataFrame:
    """The raw customer panel with its catalog column names."""
    return scan_csv_strings(spark, path).withColumnsRenamed(RAW_TO_CLEAN)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, reuse: bool = True,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Write ``build()`` to ``path`` unless it is there, and read it back."""
    if not (reuse and path_exists(spark, path)):
        write_parquet(build(), path, partition_by)
    return spark.read.parquet(path)


def stream_tail(df: DataFrame, n: int, time: str, key: str) -> DataFrame:
    """Newest ``n`` entries of a log, newest first."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)
