"""Context blurbs: one sentence that situates a chunk in its artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def template_blurb() -> Column:
    part = F.when(
        F.col("n_chunks") > 1,
        F.format_string(", part %d of %d", F.col("ordinal") + 1, F.col("n_chunks")),
    ).otherwise("")
    return F.concat(
        F.lit("From the "), F.col("kind"), F.lit(" '"), F.col("head"), F.lit("' ("),
        F.col("source_kind"), F.lit("/"), F.col("external_id"), part, F.lit(")."),
    )


def with_blurbs(chunks: DataFrame, generator: Column | None = None) -> DataFrame:
    """Add ``blurb``; ``generator`` is any column over the chunk row (see plug-ins)."""
    return chunks.withColumn("blurb", generator if generator is not None else template_blurb())
