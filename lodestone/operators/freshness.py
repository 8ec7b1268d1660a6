"""Freshness of tracked objects: upserts, stale marks and time-to-live sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["tenant_id", "object_type", "object_id"]


def set_freshness(stored: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Next freshness table.  ``updates``: key, state, reason, ttl_seconds, seq.

    The last update per key counts.  State and reason are overwritten, the ttl
    only when given; the validation time moves on insert and on turning fresh.
    """
    last = updates.groupBy(*KEY).agg(
        F.max_by(F.struct("state", "reason"), "seq").alias("u"),
        F.max_by("ttl_seconds", F.when(F.col("ttl_seconds").isNotNull(), F.col("seq"))).alias("_ttl"),
        F.bool_or(F.col("state") == "fresh").alias("_validated"),
    )
    both = stored.join(last, KEY, "full_outer")
    touched = F.col("u").isNotNull()
    return both.select(
        *KEY,
        F.when(touched, F.col("u.state")).otherwise(F.col("state")).alias("state"),
        F.when(touched, F.col("u.reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(touched & (F.col("last_validated_at").isNull() | F.col("_validated")), now)
        .otherwise(F.col("last_validated_at"))
        .alias("last_validated_at"),
        F.coalesce("_ttl", "ttl_seconds").alias("ttl_seconds"),
    )


def with_freshness(objects: DataFrame, freshness: DataFrame, object_type: str, id_col: str) -> DataFrame:
    """Add ``freshness``; an untracked object counts as fresh."""
    known = freshness.filter(F.col("object_type") == object_type).select(
        "tenant_id", F.col("object_id").alias(id_col), F.col("state").alias("_state")
    )
    joined = objects.join(known, ["tenant_id", id_col], "left")
    return joined.withColumn("freshness", F.coalesce("_state", F.lit("fresh"))).drop("_state")


def citing_processes(versions: DataFrame, chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """(tenant, process, external_id): processes with any version citing a chunk of a changed artifact.

    ``changed`` holds the artifact ids about to be replaced; run this before
    their chunks are dropped.
    """
    doomed = chunks.join(changed.select("artifact_id").distinct(), "artifact_id", "left_semi").select("chunk_id", "external_id")
    cited = versions.select(
        "tenant_id", "process_id", F.explode(F.flatten(F.transform("steps", lambda s: s["citations"]["chunk_id"]))).alias("chunk_id")
    )
    return cited.join(doomed, "chunk_id").select("tenant_id", "process_id", "external_id").distinct()


def stale_updates(citing: DataFrame) -> DataFrame:
    return citing.groupBy("tenant_id", F.col("process_id").alias("object_id")).agg(
        F.concat(F.lit("source artifact "), F.max("external_id"), F.lit(" changed")).alias("reason")
    ).select(
        "tenant_id", F.lit("process").alias("object_type"), "object_id", F.lit("stale").alias("state"), "reason",
        F.lit(None).cast("long").alias("ttl_seconds"), F.lit(0).alias("seq"),
    )


def expires(as_of: Column) -> Column:
    due = F.col("last_validated_at") + F.make_dt_interval(secs=F.col("ttl_seconds").cast("decimal(18,6)")) < as_of
    return (F.col("state") != "expired") & F.col("ttl_seconds").isNotNull() & due


def ttl_sweep(freshness: DataFrame, as_of: Column) -> DataFrame:
    """Every row past its ttl becomes expired, whatever its tenant."""
    return freshness.withColumn("state", F.when(expires(as_of), "expired").otherwise(F.col("state")))


def swept(freshness: DataFrame, as_of: Column) -> DataFrame:
    return freshness.agg(F.count_if(expires(as_of)).alias("expired"))
