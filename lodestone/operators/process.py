"""Process synthesis: cited steps out of procedural sentences, and their gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import coverage, is_procedural, salient, sentences


def synthesize_steps(chunks: DataFrame, cues=fv.ACTION_CUES) -> DataFrame:
    """One step per procedural sentence, in chunk order, citing its chunk."""
    said = chunks.select(
        "tenant_id", "artifact_id", "head", "chunk_id", F.col("ordinal").alias("chunk_ordinal"),
        F.posexplode_outer(sentences("text")).alias("pos", "action"),
    ).filter(F.col("action").isNotNull() & is_procedural("action", cues))
    order = Window.partitionBy("artifact_id").orderBy("chunk_ordinal", "pos")
    return said.select(
        "tenant_id", "artifact_id", F.col("head").alias("name"),
        F.concat(F.lit(fv.TRIGGER_PREFIX), "head").alias("trigger"),
        F.row_number().over(order).cast("long").alias("ordinal"), "action",
        F.array(F.struct("chunk_id", F.col("action").alias("quote"))).alias("citations"),
    )


def step_coverage(steps: DataFrame, chunks: DataFrame, same_artifact: bool = True, stopwords=fv.FAITH_STOPWORDS) -> DataFrame:
    """Add ``coverage`` and ``all_found``: how far the cited chunks support each action.

    With ``same_artifact`` a citation outside the step's own artifact counts as
    missing text.  A chunk's words are met where the chunk is; only those that the
    action has as well travel on.
    """
    keys = ["artifact_id", "ordinal"]
    cited = steps.select(
        "tenant_id", *keys, salient("action", stopwords).alias("_asked"), F.explode_outer("citations.chunk_id").alias("chunk_id")
    )
    on = ["tenant_id", "chunk_id", *(["artifact_id"] if same_artifact else [])]
    texts = chunks.select(*on, salient("text", stopwords).alias("_words"))
    support = (
        cited.join(texts, on, "left")
        .select("tenant_id", *keys, F.array_intersect("_asked", "_words").alias("_met"), F.col("_words").isNotNull().alias("_found"))
        .groupBy("tenant_id", *keys)
        .agg(F.flatten(F.collect_list("_met")).alias("_cited"), F.bool_and("_found").alias("all_found"))
    )
    joined = steps.join(support, ["tenant_id", *keys], "left")
    return joined.withColumn(
        "coverage", coverage(salient("action", stopwords), F.col("_cited"))
    ).drop("_cited")


def gate_steps(steps: DataFrame, chunks: DataFrame, threshold: float = fv.FAITH_THRESHOLD) -> DataFrame:
    """Drop unsupported steps and renumber; a process without steps disappears."""
    kept = step_coverage(steps, chunks).filter(F.col("coverage") >= threshold)
    order = Window.partitionBy("artifact_id").orderBy("ordinal")
    return kept.withColumn("ordinal", F.row_number().over(order).cast("long")).drop("coverage", "all_found")


def assemble(steps: DataFrame) -> DataFrame:
    """One row per process with its ordered steps."""
    if "actor" not in steps.columns:
        steps = steps.withColumn("actor", F.lit(None).cast("string"))
    if "decision" not in steps.columns:
        steps = steps.withColumn("decision", F.lit(None).cast("map<string,string>"))
    return steps.groupBy("tenant_id", "artifact_id", "name", "trigger").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "action", "actor", "citations", F.to_json("decision").alias("decision")))).alias("steps")
    )


def check_invariants(processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): each process has a step, each step a citation."""
    reason = F.when(F.size("steps") <= 0, "no steps").when(
        F.exists("steps", lambda s: F.coalesce(F.size(s["citations"]), F.lit(0)) <= 0),
        "a step without a citation",
    )
    judged = processes.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def detect_actors(steps: DataFrame, entities: DataFrame) -> DataFrame:
    """Actor of a step: the entity whose longest alias occurs in the action."""
    spread = entities.select(
        "artifact_id", "name", F.struct("type", "name").alias("_e"),
        F.posexplode(F.concat(F.array("name"), "aliases")).alias("_p", "_a"),
    )
    once = spread.groupBy("artifact_id", F.lower("_a").alias("alias")).agg(
        F.max_by("name", "_e").alias("name"), F.min(F.struct("_e", "_p")).alias("_at")
    )
    held = once.groupBy("artifact_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.length("alias")).alias("n"), "_at", "alias", "name"))).alias("_known")
    )
    named = F.filter("_known", lambda a: F.contains(F.lower("action"), a["alias"]))
    return (
        steps.drop("actor").join(held, "artifact_id", "left")
        .withColumn("actor", F.get(named, F.lit(0))["name"])
        .drop("_known")
    )
