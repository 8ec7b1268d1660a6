"""Registered queries of this subpackage, and the SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import byte_bpe, decontaminate, exact_dedup, fill_in_middle, html_main, language_id, license_scan, mixing, pii, simhash_dedup, suffix_dedup, url_filter, vector_codes
from lodestone.llm.common import table


def op1_html_main_text(spark, sf_dir):
    return html_main.extract(table(spark, sf_dir, "pages"))


def op2_decontamination(spark, sf_dir):
    """The documents that hold a benchmark passage, and which."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    """Every document (host: its source) and every page (main text, markup language, host of its url)."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = docs.select("doc_id", none.alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    rows = rows.unionByName(
        pages.select(
            none.alias("doc_id"),
            "page_id",
            html_main.main_texts(F.coalesce("html", F.lit(""))).alias("text"),
            language_id.declared_language(F.col("html")).alias("declared"),
            F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1).alias("host"),
        )
    )
    names, model = language_id.fit(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    return language_id.identify(rows, names, model)


def op5_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_personal_data(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark, sf_dir):
    """Half of the documents, by a hash of the id, are the snapshot; the rest is the new batch."""
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)


def op9_simhash_dedup(spark, sf_dir):
    return simhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark, sf_dir):
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text,
        op2_decontamination,
        op3_suffix_dedup,
        op4_language_id,
        op5_source_mix,
        op6_personal_data,
        op7_url_filter,
        op8_exact_dedup,
        op9_simhash_dedup,
        op10_license_scan,
        op11_vector_codes,
        op12_fill_in_middle,
        op13_byte_bpe,
        pipeline,
    )
}

SQL = {
    "op8_exact_dedup": """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, max(doc_id) AS keep_id FROM folded GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM folded JOIN g USING (text_sha256)""",
    "op11_vector_codes": vector_codes.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
}


def queries():
    return dict(QUERIES)


def sql():
    return dict(SQL)
