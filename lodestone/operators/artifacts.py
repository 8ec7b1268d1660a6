"""Canonical artifact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions.text import content_hash, head

COLUMNS = ["tenant_id", "source_kind", "external_id", "kind", "content", "created_at"]


def canonical(df: DataFrame) -> DataFrame:
    """Add the derived identity columns (artifact id, content hash, head)."""
    return df.withColumns(
        {
            "artifact_id": ids.artifact_id(),
            "content_hash": content_hash("content"),
            "head": head("content"),
        }
    )
