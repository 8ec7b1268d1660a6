"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

A snapshot keeps one row per distinct digest, dealt into shards by digest, and
one static 3-wise binary-fuse filter per shard.  A new batch is first grouped by
digest on its own, so a text that makes up a third of the batch is one row from
then on.  Its digests meet the filters shard by shard; only positives are joined
to the exact buckets, and the texts behind every such pair are compared byte by
byte.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty.  Of equal texts the row with the largest doc_id stays; null ids are
smaller than any other, and of repeated rows with one id and one text exactly
one stays.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import checked_broadcast, stored, text_or_empty

KEYS_PER_SHARD = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTER_SCHEMA = "shard long, seed long, segments long, width long, slots binary"


@F.pandas_udf(T.StringType())
def folded_sha256(texts: pd.Series) -> pd.Series:
    """Hex SHA-256 of the text with A-Z lower-cased, in UTF-8."""
    return texts.map(lambda t: hashlib.sha256(t.encode().lower()).hexdigest())


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of each row."""
    return docs.select("doc_id", folded_sha256(text_or_empty()).alias("text_sha256"))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(hashed: np.ndarray, segments: int, width: int) -> np.ndarray:
    """Three slots of each key, in consecutive segments."""
    low = np.uint64(width - 1)
    first = ((hashed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    return np.stack(
        [
            ((first + np.uint64(i)) * np.uint64(width) + ((hashed >> np.uint64(9 * i)) & low)).astype(np.int64)
            for i in range(3)
        ]
    )


def _marks(hashed: np.ndarray) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segments, width, slots) of a binary-fuse filter over distinct 64-bit keys.

    Slots that hold one key only are peeled in rounds; the rounds are then
    filled in reverse.  Another seed is tried when some keys cannot be peeled.
    """
    n = len(keys)
    width = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 1.0)))
    room = n * max(1.15, 0.9 + 0.3 * np.log(1e6) / np.log(max(n, 2))) + 16
    for seed in range(1, 1000):
        segments = max(1, int(np.ceil(room / width)) - 2)
        hashed = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 63))
        at = _places(hashed, segments, width)
        size = (segments + 2) * width
        load = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)
        for row in at:
            np.add.at(held, row, np.arange(n))
        left, rounds = n, []
        single = np.flatnonzero(load == 1)
        while len(single):
            who, pick = np.unique(held[single], return_index=True)
            slots = single[pick]
            rounds.append((who, slots))
            left -= len(who)
            for row in at:
                np.subtract.at(load, row[who], 1)
                np.subtract.at(held, row[who], who)
            touched = np.unique(at[:, who])
            single = touched[load[touched] == 1]
        if left == 0:
            filled, marks = np.zeros(size, np.uint8), _marks(hashed)
            for who, slots in reversed(rounds):
                others = filled[at[0, who]] ^ filled[at[1, who]] ^ filled[at[2, who]]
                filled[slots] = marks[who] ^ others
            return seed, segments, width, filled.tobytes()
        room *= 1.05
    raise ValueError("keys are not distinct")


def may_hold(keys: np.ndarray, seed: int, segments: int, width: int, slots: bytes) -> np.ndarray:
    """True for every key of the filter, and for about 1 in 256 others."""
    filled = np.frombuffer(slots, np.uint8)
    hashed = _mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 63))
    at = _places(hashed, segments, width)
    return filled[at[0]] ^ filled[at[1]] ^ filled[at[2]] == _marks(hashed)


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest of a batch: how many rows hold it, and the largest id."""
    return rows.groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("doc_id").alias("top_id"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("text_sha256")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))


def snapshot_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of a snapshot's digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segments, width, slots = build_filter(np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64)))
        return pd.DataFrame([[pdf["shard"].iloc[0], seed, segments, width, slots]], columns=["shard", "seed", "segments", "width", "slots"])

    return _sharded(groups, shards).select("shard", "key").groupBy("shard").applyInPandas(build, FILTER_SCHEMA)


def screened(groups: DataFrame, filters: DataFrame, shards: int, parts: int = 1) -> DataFrame:
    """The batch's digests that a snapshot may hold.

    A large batch against a small snapshot is dealt, shard by shard, into
    ``parts``, each with a copy of the shard's filter.
    """

    def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = rows[["text_sha256", "n", "top_id"]]
        if held.empty or rows.empty:
            return out.iloc[:0]
        f = held.iloc[0]
        return out[may_hold(rows["key"].to_numpy(np.int64).view(np.uint64), int(f.seed), int(f.segments), int(f.width), f.slots)]

    part = F.pmod(F.xxhash64("key", F.lit(parts)), F.lit(parts))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return (
        _sharded(groups, shards)
        .withColumn("part", part)
        .groupBy("shard", "part")
        .cogroup(copies.groupBy("shard", "part"))
        .applyInPandas(probe, "text_sha256 string, n long, top_id long")
    )


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """text_sha256, same: whether the texts behind a digest in both sides are the same bytes.

    ``pairs`` has text_sha256 and the two ids that stand for it.  Only those
    rows' texts are read on; the ids are broadcast when counted to be few.
    """
    ids = pairs.select("text_sha256", F.explode(F.array("batch_id", "held_id")).alias("doc_id")).filter("doc_id IS NOT NULL")
    few = checked_broadcast(ids.select("doc_id").distinct(), 16)
    folded = F.translate(text_or_empty(), UPPER, LOWER)
    texts = (
        docs.select("doc_id", "text")
        .join(few, "doc_id", "left_semi")
        .select(folded_sha256(text_or_empty()).alias("text_sha256"), "doc_id", folded.alias("folded"))
    )
    return (
        texts.join(ids, ["text_sha256", "doc_id"], "left_semi")
        .groupBy("text_sha256")
        .agg((F.min("folded") == F.max("folded")).alias("same"))
    )


def dedup(docs: DataFrame, arrived) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    ``arrived`` is a boolean column over the input: false rows are the
    immutable snapshot, true rows the new batch.  Null means false.
    """
    spark = docs.sparkSession
    new = F.coalesce(arrived, F.lit(False))
    rows = stored(
        docs.select("doc_id", "text", new.alias("arrived")).select(
            "doc_id", "arrived", folded_sha256(text_or_empty()).alias("text_sha256")
        )
    )
    held = stored(grouped(rows.filter(~F.col("arrived"))))
    batch = stored(grouped(rows.filter("arrived")))
    shards = max(1, -(-held.count() // KEYS_PER_SHARD))
    parts = max(1, -(-batch.count() // (shards * KEYS_PER_SHARD)))
    positive = screened(batch, snapshot_filters(held, shards), shards, parts)
    pairs = stored(
        positive.select("text_sha256", F.col("top_id").alias("batch_id")).join(
            held.select("text_sha256", F.col("top_id").alias("held_id")), "text_sha256"
        )
    )
    same = confirmed(docs, pairs)
    met = pairs.select("text_sha256").join(same, "text_sha256", "left").select("text_sha256", F.coalesce("same", F.lit(True)).alias("same"))

    b, h = batch.alias("b"), held.alias("h")
    both = (
        h.join(b, F.col("h.text_sha256") == F.col("b.text_sha256"), "full")
        .select(
            F.coalesce("h.text_sha256", "b.text_sha256").alias("text_sha256"),
            *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "hb" for c in ("n", "top_id")),
        )
        .join(met, "text_sha256", "left")
    )
    total = F.struct((F.coalesce("h_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))).alias("group_size"), F.greatest("h_top_id", "b_top_id").alias("keep_id"))
    own = {s: F.struct(F.col(f"{s}_n").alias("group_size"), F.col(f"{s}_top_id").alias("keep_id")) for s in "hb"}
    sides = [
        F.when(F.col(f"{s}_n").isNotNull(), F.struct(F.lit(s == "b").alias("arrived"), F.when(F.col("same") | F.col("h_n").isNull() | F.col("b_n").isNull(), total).otherwise(own[s]).alias("g")))
        for s in "hb"
    ]
    groups = both.select("text_sha256", F.explode(F.array_compact(F.array(*sides))).alias("s")).select("text_sha256", "s.arrived", "s.g.*")
    first = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")) == 1
    return rows.join(groups, ["text_sha256", "arrived"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, decided: DataFrame, mark=None, column: str = "text_sha256") -> DataFrame:
    """The rows of ``docs`` that stay: one for each kept (doc_id, mark) of ``decided``.

    ``mark`` is the expression over ``docs`` that ``column`` of ``decided`` holds.
    Ids that no other row shares are decided by id alone: those to drop are taken
    out where the rows lie when they are counted to be few, by shuffle otherwise.
    Only rows under a repeated id are marked again and numbered.
    """
    names = docs.columns
    mark = folded_sha256(text_or_empty()) if mark is None else mark
    by_id = F.col("doc_id").eqNullSafe(F.col("__id"))
    per_id = decided.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"), F.max("kept").alias("__kept"))
    out = docs.join(checked_broadcast(per_id.filter("__n > 1 OR NOT __kept").select("__id"), 16), by_id, "left_anti")
    repeated = per_id.filter("__n > 1 AND __kept").select("__id")
    if repeated.isEmpty():
        return out
    kept = decided.filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col(column).alias("__kept_mark")).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy(F.xxhash64(*[F.col(n) for n in names])))
    again = docs.join(checked_broadcast(repeated, 16), by_id).withColumn("__mark", mark).withColumn("__row", first).filter("__row = 1")
    again = again.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")) & (F.col("__mark") == F.col("__kept_mark")), "left_semi")
    return out.unionByName(again.select(*names))
