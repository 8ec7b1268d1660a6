"""Versioned processes: append-only bodies, contradiction reports, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.ids import joined_key
from lodestone.functions.text import coverage, let, salient

STEPS = (
    "array<struct<ordinal:bigint,action:string,actor:string,"
    "citations:array<struct<chunk_id:string,quote:string>>,decision:string>>"
)
HEADS = "tenant_id string, process_id string, name string, trigger string, current_version bigint, status string"
VERSIONS = f"tenant_id string, process_id string, version bigint, trigger string, steps {STEPS}, created_by string, review_reason string"


def process_id(tenant: str = "tenant_id", name: str = "name") -> Column:
    return F.md5(joined_key(tenant, name))


def _body_hash() -> Column:
    return F.md5(F.concat(F.col("trigger"), F.lit("|"), F.to_json("steps")))


def _quoted(c: Column) -> Column:
    """A string as a quoted literal: double quotes only when it holds single ones."""
    esc = F.regexp_replace(c, r"\\", r"\\\\\\\\")
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(c.isNull(), "None").when(double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def contradictions(pairs: DataFrame, threshold: float = fv.MATCH_THRESHOLD) -> DataFrame:
    """Add ``conflicts`` and ``summary`` to rows holding ``old_steps`` and ``new_steps``.

    Each new step is matched to the old step that covers it best (the first on
    ties); a matched pair conflicts on every field that differs.
    """
    old = F.transform("old_steps", lambda s: s.withField("words", salient(s["action"])))
    new = F.transform("new_steps", lambda s: s.withField("words", salient(s["action"])))

    def judged(n: Column, steps: Column) -> Column:
        best = F.array_max(
            F.transform(steps, lambda o, i: F.struct(coverage(n["words"], o["words"]).alias("c"), (-i).alias("i"), o["actor"].alias("actor"), o["decision"].alias("decision")))
        )
        return F.struct(n.alias("n"), best.alias("b"))

    def fields(x: Column) -> Column:
        def field(name):
            return F.struct(
                x["n"]["action"].alias("action"), F.lit(name).alias("field"), x["b"][name].alias("old"), x["n"][name].alias("new")
            )

        return F.array(field("actor"), field("decision"))

    # the old steps are bound once: the optimiser would copy their column into the step over the new ones, words and all
    pairs_of = let(old, lambda steps: F.transform(new, lambda n: judged(n, steps)))
    matched = F.filter(pairs_of, lambda x: x["b"]["c"] >= threshold)
    diff = F.filter(F.flatten(F.transform("_matched", fields)), lambda f: ~f["old"].eqNullSafe(f["new"]))
    line = F.transform("conflicts", lambda f: F.concat(f["field"], F.lit(": "), _quoted(f["old"]), F.lit(" -> "), _quoted(f["new"])))
    return (
        pairs.withColumn("_matched", matched)
        .withColumn("conflicts", diff)
        .withColumn("summary", F.when(F.size("conflicts") > 0, F.array_join(line, "; ")).otherwise("no contradiction"))
        .drop("_matched")
    )


def save_processes(heads: DataFrame, versions: DataFrame, extracted: DataFrame, keep=lambda rows: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Save extracted bodies in ``seq`` order; returns (heads, new versions, freshness updates).

    A body equal to the one before it changes nothing.  The order of bodies
    under one name is found on hashes alone, so that step never carries text.
    All three come from the judged bodies; ``keep`` may write these, so that they
    are judged once.
    """
    new = extracted.withColumns({"process_id": process_id(), "hash": _body_hash()})
    latest = versions.groupBy("process_id").agg(
        F.max("version").alias("version"), F.max_by(F.struct("trigger", "steps"), "version").alias("_b")
    ).select("process_id", "version", F.col("_b.trigger").alias("trigger"), F.col("_b.steps").alias("steps"))
    stored = latest.withColumn("hash", _body_hash())
    line = new.select("process_id", "seq", "hash").unionByName(
        stored.select("process_id", F.lit("").alias("seq"), "hash")
    )
    w = Window.partitionBy("process_id").orderBy("seq")
    moves = line.withColumn("_moved", ~F.lag("hash").over(w).eqNullSafe(F.col("hash"))).withColumn(
        "_step", F.sum((F.col("_moved") & (F.col("seq") != "")).cast("long")).over(w)
    ).withColumn("_before", F.lag("seq").over(w))
    kept = moves.filter(F.col("_moved") & (F.col("seq") != "")).select("process_id", "seq", "_step", "_before")
    bodies = new.join(kept, ["process_id", "seq"]).join(
        stored.select("process_id", F.col("version").alias("_v0"), F.col("steps").alias("_s0")), "process_id", "left"
    )
    prior = new.select("process_id", F.col("seq").alias("_before"), F.col("steps").alias("_s1"))
    chained = bodies.join(prior, ["process_id", "_before"], "left").withColumns(
        {"version": F.coalesce("_v0", F.lit(0)) + F.col("_step"), "old_steps": F.coalesce("_s1", "_s0"), "new_steps": F.col("steps")}
    )
    judged = contradictions(chained).withColumn("conflict", F.coalesce(F.size("conflicts") > 0, F.lit(False)))
    judged = keep(judged.select("tenant_id", "process_id", "name", "version", "trigger", "steps", "summary", "conflict"))
    first = F.col("version") == 1
    conflict = F.col("conflict") & ~first
    added = judged.select(
        "tenant_id", "process_id", "name", "version", "trigger", "steps", F.lit("extractor").alias("created_by"),
        F.when(conflict, F.col("summary")).alias("review_reason"),
    )
    top = added.groupBy("tenant_id", "process_id", "name").agg(
        F.max("version").alias("_v"), F.max_by("trigger", "version").alias("_t")
    )
    merged = heads.join(top, ["tenant_id", "process_id", "name"], "full_outer").select(
        "tenant_id", "process_id", "name", F.coalesce("_t", "trigger").alias("trigger"),
        F.coalesce("_v", "current_version").alias("current_version"),
        F.when(F.col("_v") == 1, "active").when(F.col("_v").isNotNull(), "draft").otherwise(F.col("status")).alias("status"),
    )
    reason = F.when(first, F.lit(None)).when(conflict, F.concat(F.lit("contradiction: "), "summary")).otherwise("source changed")
    updates = judged.select(
        "tenant_id", F.lit("process").alias("object_type"), F.col("process_id").alias("object_id"),
        F.when(first, "fresh").otherwise("stale").alias("state"), reason.alias("reason"),
        F.when(first, F.lit(fv.PROCESS_TTL_SECONDS)).cast("long").alias("ttl_seconds"), F.col("version").alias("seq"),
    )
    return merged, added.drop("name"), updates


def version_rows(versions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per (version, step, citation); actor ids by lower-cased name when given."""
    rows = versions.select("tenant_id", "process_id", "version", F.explode("steps").alias("s")).select(
        "tenant_id", "process_id", "version", "s.ordinal", "s.action", "s.actor", F.explode_outer("s.citations").alias("c")
    )
    rows = rows.select("*", "c.chunk_id", "c.quote").drop("c")
    if aliases is None:
        return rows
    index = aliases.select("tenant_id", F.col("alias").alias("_a"), "entity_id")
    joined = rows.withColumn("_a", F.lower("actor")).join(index, ["tenant_id", "_a"], "left")
    return joined.withColumnRenamed("entity_id", "actor_entity_id").drop("_a")


def review(heads: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply approve / reject decisions: (heads, freshness updates, decisions without a process)."""
    bad = decisions.filter(~F.col("action").isin("approve", "reject")).select("action").limit(1).collect()
    if bad:
        raise ValueError(f"unknown review action: {bad[0]['action']!r}")
    last = decisions.groupBy("tenant_id", "process_id").agg(F.max_by("action", "seq").alias("_a"), F.max("seq").alias("seq"), F.bool_or(F.col("action") == "approve").alias("_ok"))
    status = F.when(F.col("_a") == "approve", "active").when(F.col("_a") == "reject", "deprecated").otherwise(F.col("status"))
    joined = heads.join(last, ["tenant_id", "process_id"], "left")
    updates = joined.filter("_ok").select(
        "tenant_id", F.lit("process").alias("object_type"), F.col("process_id").alias("object_id"), F.lit("fresh").alias("state"),
        F.lit(None).cast("string").alias("reason"), F.lit(fv.PROCESS_TTL_SECONDS).cast("long").alias("ttl_seconds"), "seq",
    )
    unknown = decisions.join(heads.select("tenant_id", "process_id"), ["tenant_id", "process_id"], "left_anti")
    return joined.withColumn("status", status).select(*heads.columns), updates, unknown


def history(versions: DataFrame, tenant: str, process: str) -> DataFrame:
    from lodestone.functions.ids import scoped

    return scoped(versions, tenant).filter(F.col("process_id") == process).orderBy(F.desc("version"))
