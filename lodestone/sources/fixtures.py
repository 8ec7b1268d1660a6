"""A fixed corpus of artifacts as a source: the package's own, or JSON lines of the same shape."""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "external_id string, kind string, content string"
#: Every item carries this time, so that a replay changes nothing.
SEEDED_AT = "2026-01-01 00:00:00"


def _items(rows: DataFrame, tenant: str) -> DataFrame:
    filled = rows.filter("coalesce(external_id, '') <> '' AND content IS NOT NULL")
    return filled.select(F.lit(tenant).alias("tenant_id"), "external_id", F.coalesce("kind", F.lit("doc")).alias("kind"), "content", F.lit(SEEDED_AT).cast("timestamp").alias("created_at"))


def packaged_items(spark: SparkSession, tenant: str) -> DataFrame:
    """The eight items that come with the package."""
    lines = resources.files("lodestone").joinpath("data/fixture_corpus.jsonl").read_text().splitlines()
    rows = [tuple(json.loads(line)[k] for k in ("external_id", "kind", "content")) for line in lines]
    return _items(spark.createDataFrame(rows, ITEM), tenant)


def fixture_items(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    """Items of JSON lines (external_id, kind, content); broken lines and lines without an id are left out."""
    return _items(spark.read.schema(ITEM).json(path), tenant)


def poll_items(items: DataFrame) -> DataFrame:
    """A fixture brings nothing new after its backfill."""
    return items.limit(0)
