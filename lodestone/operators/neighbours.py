"""What lies around entities in the graph: neighbourhoods by hops, edges valid at a time, and conflicting intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

HUB_EDGES = 10_000


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(tenant_id, seed, node, hop): every node within ``hops`` of a seed, with its least distance; the seed itself is hop 0.

    ``edges``: tenant_id, source, target, taken both ways; ``seeds``: tenant_id, node.
    Each round joins only the nodes that the round before found first.  The edges
    of a hub are dealt into parts of about ``hub_edges``, and a frontier row goes
    to all parts of its node, so no task holds a hub.
    """
    both = edges.select("tenant_id", F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select("tenant_id", F.col("target").alias("a"), F.col("source").alias("b")))
    both = cut_lineage(both.filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    parts = cut_lineage(both.groupBy("tenant_id", "a").agg(F.ceil(F.count("*") / hub_edges).cast("int").alias("parts")))
    dealt = both.join(parts, ["tenant_id", "a"]).withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    found = cut_lineage(seeds.select("tenant_id", F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct())
    frontier = found
    for hop in range(1, hops + 1):
        spread = frontier.join(parts.withColumnRenamed("a", "node"), ["tenant_id", "node"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        met = spread.withColumnRenamed("node", "a").join(dealt, ["tenant_id", "a", "part"]).select("tenant_id", "seed", F.col("b").alias("node")).distinct()
        frontier = cut_lineage(met.join(found.select("tenant_id", "seed", "node"), ["tenant_id", "seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        found = found.unionByName(frontier.select(*found.columns))
    return found


def with_validity(assertions: DataFrame, keys: list[str], at: str = "asserted_at", until: str | None = None) -> DataFrame:
    """Edges with ``valid_from`` and ``valid_to``: an assertion holds until the next one about the same keys, or its own end.

    ``valid_to`` is exclusive and null while nothing ends it.  Of assertions at one
    time the last by all columns counts.
    """
    once = assertions.groupBy(*keys, at).agg(F.max(F.struct(*[c for c in assertions.columns if c not in (*keys, at)])).alias("_r")).select(*keys, at, "_r.*")
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    end = following if until is None else F.when(following.isNull() | (F.col(until) < following), F.col(until)).otherwise(following)
    rows = once.withColumn("valid_to", end).withColumnRenamed(at, "valid_from")
    return rows.filter(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def as_of(edges: DataFrame, moments: DataFrame, keys: list[str], width_s: int = 86_400) -> DataFrame:
    """(moments, edge columns): for each moment (keys, moment_id, moment) the edges valid then.

    Intervals and moments meet by key and time bucket of ``width_s`` seconds; an
    interval goes into each bucket that it touches, an open or long one into one
    row of its own kind, which is met by key alone.
    """
    long_s = 366 * width_s
    start, end = F.unix_timestamp("valid_from"), F.unix_timestamp("valid_to")
    short = end.isNotNull() & (end - start <= long_s)
    bucketed = edges.filter(short).withColumn("_bucket", F.explode(F.sequence(F.floor(start / width_s), F.floor(end / width_s))))
    lasting = edges.filter(~F.coalesce(short, F.lit(False)))
    asked = moments.withColumn("_bucket", F.floor(F.unix_timestamp("moment") / width_s))
    holds = "valid_from <= moment AND (valid_to IS NULL OR moment < valid_to)"
    near = asked.join(bucketed, [*keys, "_bucket"]).filter(holds).drop("_bucket")
    far = moments.join(lasting, keys).filter(holds)
    return near.unionByName(far.select(*near.columns))


def overlaps(edges: DataFrame, keys: list[str], id_col: str = "edge_id") -> DataFrame:
    """(keys, id, other): intervals of one key that begin inside another one, each with the latest-ending one before it.

    A sweep in order of start: a row conflicts when a row before it ends after it
    begins.  One row per conflicting interval, not all pairs.
    """
    open_end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp"))
    before = Window.partitionBy(*keys).orderBy("valid_from", id_col).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.struct(open_end.alias("end"), F.col(id_col).alias("id"))).over(before)
    return edges.withColumn("_b", latest).filter(F.col("_b.end") > F.col("valid_from")).select(*keys, id_col, F.col("_b.id").alias("other"))
