"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all that the one before it kept and returns the columns of documents; the last returns the
packing. Extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.llm import debruijn, jaccard, mixing, packing, toxicity
from panelrec.llm.common import read
from panelrec.session import checkpoint_root

APART = (("src1", "src2"),)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.3; the model learns from all labelled documents of this stage's input."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    names = docs.columns
    body = docs.select(*[F.col(c).alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)])
    kept = toxicity.scored(body, model).where("score < 0.3")
    return kept.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(names)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard.representatives(docs, jaccard.Join(words=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too; no document goes."""
    return debruijn.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; those it does not reach go."""
    held = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # columns of any name travel in the row
    mixed = mixing.mixed(mixing.sized(held)).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 4,096 words; copies of one document never share a bin."""
    sized = docs.withColumn("size", F.size(mixing.word_list(F.col("text")))).withColumn("cluster", packing.cluster_of())
    return packing.packed(sized, apart=APART)


STAGES = [
    ("toxicity", drop_toxic), ("ngram_jaccard_join", one_of_each_group), ("substring_dedup", cut_repeats),
    ("mixing", mix_sources), ("best_fit_packing", pack),
]
#: Learned scores and hashed draws are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
