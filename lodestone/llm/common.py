"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import dropped, kept_until_end, shared_dir  # noqa: F401

BROADCAST_BYTES = 32 << 20
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession) -> None:
    """At most TEXT_ROWS rows per Arrow batch in this session: whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if held <= 0 or held > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lost executors replay nothing before it.

    The table goes when the application ends.
    """
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, with the table's path for a caller that can let go of it earlier."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if at most ``limit / row_bytes`` rows are counted; else join by shuffle.

    ``row_bytes`` bounds one row, so it is meant for tables of numbers.  Both
    ways give the same rows.
    """
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    """As many tasks as the session shuffles to, and more when a task would get over ``per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
