"""Step precision and recall, actor accuracy, and citation validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import coverage, salient
from lodestone.operators.process import step_coverage
from lodestone.session import broadcast_if_small


def best_process(golden: DataFrame, processes: DataFrame) -> DataFrame:
    """Per golden row the first process, by name, that contains the needle.

    ``golden`` (golden_id, tenant_id, name_contains, steps, actors) is a
    hand-made set, and is broadcast where it is counted to be small.
    """
    named = F.contains(F.lower("name"), F.lower("name_contains"))
    needles = broadcast_if_small(golden.select("golden_id", F.col("tenant_id").alias("_t"), "name_contains"))
    pairs = processes.select("tenant_id", "name").join(needles, (F.col("tenant_id") == F.col("_t")) & named)
    # names alone are compared; the steps of the chosen ones are fetched after
    first = pairs.groupBy("golden_id", "tenant_id").agg(F.min("name").alias("name"))
    found = first.join(processes.groupBy("tenant_id", "name").agg(F.min("steps").alias("found_steps")), ["tenant_id", "name"])
    return golden.join(found.select("golden_id", "found_steps"), "golden_id", "left").withColumn(
        "found_steps", F.coalesce("found_steps", F.expr("slice(found_steps, 1, 0)"))
    )


def step_precision_recall(golden: DataFrame, processes: DataFrame, threshold: float = fv.MATCH_THRESHOLD) -> DataFrame:
    """Micro-averaged (precision, recall) over the golden rows, and how many steps were wanted and found."""
    phrases = F.transform("steps", lambda p: salient(p))
    actions = F.coalesce(F.transform("found_steps", lambda s: salient(s["action"])), F.array().cast("array<array<string>>"))
    tokens = best_process(golden, processes).select(phrases.alias("p"), actions.alias("a"))

    def hits(outer: str, inner: str, flip: bool):
        def one(x):
            return F.exists(inner, lambda y: (coverage(y, x) if flip else coverage(x, y)) >= threshold)

        return F.size(F.filter(outer, one))

    sums = tokens.select(
        F.size("p").alias("gt"), hits("p", "a", False).alias("gh"), F.size("a").alias("et"), hits("a", "p", True).alias("eh")
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("gt", "gh", "et", "eh")])
    return sums.select(
        F.when(F.col("et") > 0, F.col("eh") / F.col("et")).otherwise(0.0).alias("precision"),
        F.when(F.col("gt") > 0, F.col("gh") / F.col("gt")).otherwise(0.0).alias("recall"),
        "gt",
        "et",
    )


def actor_accuracy(golden: DataFrame, processes: DataFrame) -> DataFrame:
    """Share of golden rows with actors whose process has one of them; 1.0 if there are none."""
    asked = best_process(golden, processes).filter(F.size("actors") > 0)
    attached = F.transform("found_steps", lambda s: F.lower(F.coalesce(s["actor"], F.lit(""))))
    hit = F.coalesce(F.arrays_overlap(F.transform("actors", F.lower), attached), F.lit(False))
    return asked.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(1.0)).alias("accuracy"))


def citation_validity(steps: DataFrame, chunks: DataFrame, threshold: float = fv.FAITH_THRESHOLD) -> DataFrame:
    """Share of steps whose citations all exist and support the action; 1.0 without steps."""
    judged = step_coverage(steps, chunks, same_artifact=False)
    ok = (F.size("citations") > 0) & F.coalesce("all_found", F.lit(False)) & (F.col("coverage") >= threshold)
    return judged.agg(
        F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("validity"), F.count("*").alias("n_steps")
    )
