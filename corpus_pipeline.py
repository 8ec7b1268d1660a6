"""The corpus pipeline: five stages over documents, each written and read again.

language ID -> exact dedup -> SimHash near-dedup -> benchmark decontamination -> source mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, language_id, mixing, simhash_dedup
from lodestone.llm.common import checked_broadcast, stored, table, text_batches, text_or_empty


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; rejected are those that no language explains."""
    text_batches(spark)
    mark = F.xxhash64(text_or_empty())
    rows = docs.select("doc_id", mark.alias("mark"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    names, model = language_id.fit(rows.select(F.col("doc_id").alias("key"), "text", F.col("declared").alias("label")))
    found = language_id.identify(rows, names, model)
    out = found.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(checked_broadcast(out, 32), F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left_anti")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the largest id."""
    text_batches(spark)
    arrived = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return exact_dedup.keep_one(docs, stored(exact_dedup.dedup(docs, arrived)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of linked fingerprints, the one with the smallest id."""
    text_batches(spark)
    found = stored(simhash_dedup.dedup(docs))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    decided = found.select("doc_id", F.col("fingerprint").alias("mark"), kept.alias("kept"))
    return exact_dedup.keep_one(docs, decided, simhash_dedup.fingerprint_hex(text_or_empty()), "mark")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark passage leaks."""
    text_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("source_mix", mixed),
]

#: Trained likelihoods, fingerprints and chance are not SQL; tests/llm compares the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
