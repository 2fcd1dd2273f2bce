"""A keyed table as a log in hash buckets: batch-wise upserts, lookups that read touched buckets, compaction in place.

Layout: ``path/bucket=<n>/part=<batch>-<kind>``. A batch writes one part into each bucket it has keys of, so writing it again
replaces what it wrote; the newest row of a key wins, then the later part. A lookup lists and reads only the buckets
of the keys it asks for. Compaction adds one part that holds the newest rows of a bucket up to a batch, then deletes the parts
it covers; a stop between the two leaves rows twice, which readers reduce to the newest anyway. Nothing is moved
through the driver but names of folders.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.operators.scale import newest

WRITTEN, COMPACTED = 0, 1


def part_name(batch_id: int, kind: int) -> str:
    return f"{batch_id:019d}-{kind}"


@dataclass(frozen=True)
class KeyedTable:
    """``schema`` lists the columns as DDL; ``order`` names those that make a row newer; buckets go by ``by``, some of the keys,
    so that one lookup of those finds all their rows together."""

    path: str
    schema: str
    keys: Sequence[str]
    order: Sequence[str]
    buckets: int = 64
    by: Sequence[str] | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Upsert one batch; its newest row of each key is kept. The same batch must bring the same keys again."""
        self._store(newest(rows, self.keys, self.order), part_name(batch_id, WRITTEN))

    def read(self, spark: SparkSession, asked: DataFrame | None = None) -> DataFrame:
        """The newest row of every key, or of those that agree with ``asked`` in the columns buckets go by, which limits the
        buckets that are read."""
        rows = self._rows(spark, self._touched(asked) if asked is not None else None)
        found = newest(rows, self.keys, [*self.order, "part"]).drop("bucket", "part")
        if asked is None:
            return found
        by = list(self.by or self.keys)
        return found.join(asked.select(*by).distinct(), by, "left_semi")

    def compact(self, spark: SparkSession, above: int = 8, keep: Column | None = None) -> list[int]:
        """Reduce buckets of more than ``above`` parts to one part each, dropping rows that ``keep`` rules out; their numbers."""
        parts = {b: p for b, p in self._parts(spark).items() if len(p) > above}
        if not parts:
            return []
        upto = max(int(name.split("-")[0]) for names in parts.values() for name in names)
        rows = newest(self._rows(spark, sorted(parts)), self.keys, [*self.order, "part"]).drop("bucket", "part")
        own = part_name(upto, COMPACTED)
        self._store(rows if keep is None else rows.where(keep), own)
        store, root = self._files(spark)
        for b, names in parts.items():
            for name in names:
                if name != own:
                    store.delete(self._path(spark, f"bucket={b}/part={name}"), True)
        return sorted(parts)

    # ---- files

    def _store(self, rows: DataFrame, part: str) -> None:
        tagged = rows.select(*[F.col(c) for c in rows.columns], self.bucket().alias("bucket"), F.lit(part).alias("part"))
        tagged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "part").parquet(self.path)

    def _rows(self, spark: SparkSession, buckets: Sequence[int] | None) -> DataFrame:
        parts = self._parts(spark, buckets)
        schema = f"{self.schema}, bucket int, part string"
        if not parts:
            return spark.createDataFrame([], schema)
        return spark.read.option("basePath", self.path).schema(schema).parquet(*[f"{self.path}/bucket={b}" for b in sorted(parts)])

    def _touched(self, asked: DataFrame) -> list[int]:
        return [r.b for r in asked.select(self.bucket().alias("b")).distinct().collect()]  # at most one row a bucket

    def _parts(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> dict[int, list[str]]:
        store, root = self._files(spark)
        out = {}
        for b in range(self.buckets) if buckets is None else buckets:
            folder = self._path(spark, f"bucket={b}")
            if store.exists(folder):
                names = [f.getPath().getName() for f in store.listStatus(folder)]
                if found := sorted(n[len("part="):] for n in names if n.startswith("part=")):
                    out[b] = found
        return out

    def _path(self, spark: SparkSession, name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _files(self, spark: SparkSession):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root
