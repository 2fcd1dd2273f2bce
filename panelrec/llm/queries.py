"""Registered queries of the operators, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelrec.llm import chat, debruijn, jaccard, kneser, merkle, mixing, packing, quality, ranked, shards, substrings, toxicity, vectors
from panelrec.llm.common import read
from panelrec.llm.twins import TWINS  # noqa: F401  registered beside the queries

SHARDS = 24
APART = (("src1", "src2"),)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one planted conversation, through layout fingerprints, template and loss mask."""
    table = chat.canonical_turns(chat.as_records(read(spark, sf_dir, "conversations")))
    planted = chat.canonical_turns(chat.planted_record(spark))
    return chat.digests(chat.formatted(table.unionByName(planted)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_good", 6).alias("p_good"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the deduplicated texts, then the removed spans and the texts themselves."""
    return substrings.digested(substrings.deduplicated(read(spark, sf_dir, "documents")), "spans", "text")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digests(read(spark, sf_dir, "documents"), jaccard.Join(words=4, percent=85, shares=2))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized(read(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "quality", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return mixing.mixed(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.judged(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("cluster", packing.cluster_of())
    return packing.packed(docs.withColumn("size", F.size(mixing.word_list(F.col("text")))), apart=APART)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shards.shard(facts, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves, each with its proof and the root folded from it, half of them tampered with."""
    return merkle.verified(read(spark, sf_dir, "documents"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of word pairs learnt from four fifths of them."""
    return kneser.scored(read(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


QUERIES = {f.__name__: f for f in (
    op1_chat_formatting, op2_embedding_near_dedup, op3_quality_rules, op4_suffix_array_dedup, op5_ngram_jaccard_join,
    op6_mixing, op7_toxicity, op8_best_fit_packing, op9_substring_dedup, op10_sharding, op11_merkle_manifest, op12_lm_scoring,
    op13_ranked_search)}
