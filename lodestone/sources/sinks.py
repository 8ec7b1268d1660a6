"""Report and skills sinks: JSON and markdown as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _signed(c: str):
    return F.format_string("%+.4f", c)


def retrieval_report(deltas: DataFrame, worst: DataFrame, mode: str, split: str, ran_at: str, n_queries: int) -> DataFrame:
    """Markdown lines (line_no, line): metric table with deltas, then the worst queries.

    ``worst``: query, mrr and a position ``rank``.
    """
    spark = deltas.sparkSession
    head = [
        f"# Search quality: {mode} search, {split} queries", "", f"{n_queries} queries, measured {ran_at}", "",
        "| measure | now | change since the run before |", "|:--|--:|--:|",
    ]
    fixed = [(f"0-{i}", t) for i, t in enumerate(head)] + [("2-0", ""), ("2-1", "## Queries whose first relevant hit comes last"), ("2-2", "")]
    rows = deltas.select(
        F.concat(F.lit("1-"), "metric").alias("line_no"),
        F.concat(F.lit("| "), "metric", F.lit(" | "), F.format_string("%.4f", "value"), F.lit(" | "), F.when(F.col("delta").isNull(), "new").otherwise(_signed("delta")), F.lit(" |")).alias("line"),
    )
    tail = worst.select(
        F.format_string("3-%03d", "rank").alias("line_no"),
        F.concat(F.lit("1. "), F.format_string("%.2f", "mrr"), F.lit(": "), "query").alias("line"),
    )
    return spark.createDataFrame(fixed, "line_no string, line string").unionByName(rows).unionByName(tail)


def ab_report(deltas: DataFrame, verdict: DataFrame) -> DataFrame:
    """Markdown lines of the A/B comparison."""
    title = F.when(F.col("passed"), "adopt the candidate").otherwise("keep the base model")
    head = verdict.select(
        F.posexplode(
            F.array(F.concat(F.lit("# Two embedders compared: "), title), F.lit(""), F.lit("| measure | base | candidate | change |"), F.lit("|:--|--:|--:|--:|"))
        ).alias("n", "line")
    ).select(F.format_string("0-%d", "n").alias("line_no"), "line")
    body = deltas.select(
        F.concat(F.lit("1-"), "metric").alias("line_no"),
        F.concat(F.lit("| "), "metric", F.lit(" | "), F.format_string("%.4f", "base"), F.lit(" | "), F.format_string("%.4f", "candidate"), F.lit(" | "), _signed("delta"), F.lit(" |")).alias("line"),
    )
    listed = F.concat(F.array(F.lit(""), F.lit("## Gains that were too small")), F.transform("reasons", lambda r: F.concat(F.lit("- "), r)))
    tail = verdict.filter(F.size("reasons") > 0).select(F.posexplode(listed).alias("n", "line")).select(F.format_string("2-%03d", "n").alias("line_no"), "line")
    return head.unionByName(body).unionByName(tail)


def write_lines(lines: DataFrame, path: str, order: str = "line_no", text: str = "line") -> None:
    """A short report as one text file; its size is set by metrics and worst-n, not by data."""
    lines.orderBy(order).coalesce(1).select(text).write.mode("overwrite").text(path)


def write_skills(lines: DataFrame, path: str) -> None:
    """Skills lines in tenant folders, ordered; range partitioning splits a very large tenant."""
    ordered = lines.repartitionByRange("tenant_id", "line_no", "name").sortWithinPartitions("tenant_id", "line_no", "name")
    ordered.select("tenant_id", "json").write.mode("overwrite").partitionBy("tenant_id").text(path)
