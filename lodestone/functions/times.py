"""Lenient timestamps: unreadable or missing values become the run timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import col


def _or_run(value: Column, run_ts: Column | None) -> Column:
    return F.coalesce(value, run_ts if run_ts is not None else F.current_timestamp())


def iso(c: Column | str, run_ts: Column | None = None) -> Column:
    c = col(c)
    looks_iso = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return _or_run(F.when(looks_iso, F.try_to_timestamp(c)), run_ts)


def epoch_seconds(c: Column | str, run_ts: Column | None = None) -> Column:
    micros = (col(c).try_cast("decimal(30,9)") * 1_000_000).try_cast("bigint")
    return _or_run(F.timestamp_micros(micros), run_ts)


def epoch_millis(c: Column | str, run_ts: Column | None = None) -> Column:
    return _or_run(F.timestamp_millis(col(c).try_cast("bigint")), run_ts)
