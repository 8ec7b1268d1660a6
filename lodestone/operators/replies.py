"""Model plug-ins: prompts as columns, batched functions, reply salvage, side errors."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import fixed_values as fv
from lodestone.session import cut_lineage


def best_effort(fn, value: Column | str) -> Column:
    """``fn(list of str) -> list of str`` per batch; a failing row yields its error instead.

    A failing batch is retried row by row, so one bad row costs only itself.
    """
    @F.pandas_udf("result string, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        items = values.tolist()
        try:
            return pd.DataFrame({"result": fn(items), "error": [None] * len(items)})
        except Exception:  # noqa: BLE001
            rows = []
            for item in items:
                try:
                    rows.append((fn([item])[0], None))
                except Exception as exc:  # noqa: BLE001
                    rows.append((None, str(exc)))
            return pd.DataFrame(rows, columns=["result", "error"])

    return run(value)


def apply_model(df: DataFrame, prompt: Column, fn) -> tuple[DataFrame, DataFrame]:
    """(rows with ``reply``, rows with ``error``) after one batched model call per row.

    The replies are written once to the shared folder; both results read them there.
    """
    called = cut_lineage(df.withColumn("_r", best_effort(fn, prompt)))
    done = called.filter(F.col("_r.error").isNull()).withColumn("reply", F.col("_r.result")).drop("_r")
    failed = called.filter(F.col("_r.error").isNotNull()).withColumn("error", F.col("_r.error")).drop("_r")
    return done, failed


@F.arrow_udf(T.StringType())
def json_span(replies: pa.Array) -> pa.Array:
    """The part of each reply that is strict JSON: all of it, else its widest brace span.

    The JVM parser stops at the end of the first value, so it cannot tell.
    """
    out = []
    for text in replies.to_pylist():
        text = text or ""
        found = None
        for span in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
            try:
                json.loads(span)
            except ValueError:
                continue
            found = span
            break
        out.append(found)
    return pa.array(out, pa.string())


def salvage(reply: str = "reply") -> Column:
    """Parsed reply: strict JSON, else the widest brace span, else null."""
    return F.try_parse_json(json_span(F.col(reply)))


def _either(item: str, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(item, f"$.{n}", "string"), F.lit("")) for n in names])


def _items(replies: DataFrame, field: str, keep: list[str]) -> DataFrame:
    listed = F.try_variant_get(salvage(), f"$.{field}", "array<variant>")
    return replies.select(*keep, F.posexplode_outer(listed).alias("_at", "_i")).filter(F.col("_i").isNotNull())


def reply_entities(replies: DataFrame, keep: list[str]) -> DataFrame:
    return (
        _items(replies, "entities", keep)
        .select(*keep, _either("_i", "name", "entity").alias("name"), F.coalesce(_either("_i", "type"), F.lit("unknown")).alias("type"), F.lit(fv.REPLY_CONFIDENCE).alias("confidence"))
        .filter(F.col("name").isNotNull())
    )


def reply_relations(replies: DataFrame, keep: list[str]) -> DataFrame:
    return (
        _items(replies, "relations", keep)
        .select(
            *keep, _either("_i", "subject", "source").alias("subject"), _either("_i", "predicate", "relation").alias("predicate"),
            _either("_i", "object", "target").alias("object"), F.lit(fv.REPLY_CONFIDENCE).alias("confidence"),
        )
        .dropna(subset=["subject", "predicate", "object"])
    )


def reply_steps(replies: DataFrame, keep: list[str]) -> DataFrame:
    """Steps of one reply, renumbered after incomplete ones are dropped.  One row per reply in."""
    whole = F.expr("filter(transform(_l, (x, i) -> named_struct('at', i, 'action', x.action, 'actor', x.actor, 'chunk_id', x.chunk_id)), x -> x.action IS NOT NULL AND x.chunk_id IS NOT NULL)")
    listed = F.try_variant_get(salvage(), "$.steps", "array<variant>")
    fields = F.transform(
        listed,
        lambda v: F.struct(
            F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in ("$.action", "$.step")]).alias("action"),
            F.try_variant_get(v, "$.actor", "string").alias("actor"),
            F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in ("$.chunk_id", "$.citation")]).alias("chunk_id"),
        ),
    )
    return (
        replies.select(*keep, fields.alias("_l"))
        .select(*keep, F.posexplode(whole).alias("_n", "s"))
        .select(*keep, (F.col("_n") + 1).cast("long").alias("ordinal"), "s.action", "s.actor", F.array(F.struct("s.chunk_id", F.lit(None).cast("string").alias("quote"))).alias("citations"))
    )


def chosen(options: dict, name: str, what: str):
    """Mode factory: the option of that name, else a ValueError."""
    if name.lower() not in options:
        raise ValueError(f"unknown {what}: {name!r}")
    return options[name.lower()]
