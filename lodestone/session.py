"""Session helpers: local sessions, small-side checks, durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 50_000


def local_session(name: str = "lodestone", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def broadcast_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the side is small.

    The count stops at ``limit + 1`` rows.  A larger side is returned as it is
    and joins by shuffle, with adaptive skew handling.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Hint how a written side joins by its counted rows; Spark would go by its bytes, of which a well packed table has one or two a row."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def pinned_if_small(df: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Compute a side that is counted to be small once, and keep it as local rows.

    At most ``limit + 1`` rows are fetched.  A larger side is returned as it is,
    with False: the caller then joins it by shuffle.
    """
    held = df.limit(limit + 1).toArrow()
    if held.num_rows > limit:
        return df, False
    return df.sparkSession.createDataFrame(held, schema=df.schema), True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session (tests) gets a fresh folder; on a cluster
    that is an error, since executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base


def _place(spark: SparkSession, path: str):
    """The file system of a path, as the session's Hadoop settings give it, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def kept_until_end(spark: SparkSession, path: str) -> None:
    """Mark an intermediate table: its file system deletes it when the application ends."""
    files, place = _place(spark, path)
    files.deleteOnExit(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none where there is no such folder."""
    files, place = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(place)) if not n.startswith(("_", ".")))


def name_list(spark: SparkSession, path: str, names: list[str]) -> None:
    """Publish a folder of empty files with these names, all at once: it is made aside and renamed."""
    files, place = _place(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_{uuid.uuid4().hex}")
    files.mkdirs(aside)
    for name in names:
        files.create(spark._jvm.org.apache.hadoop.fs.Path(aside, name)).close()
    if not files.rename(aside, place):
        raise OSError(f"{path} was not published")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    files, place = _place(spark, path)
    files.delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, so a lost executor costs no replay.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table held in fewer files than cores; larger tables stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
