"""SimHash near-duplicates: sharded BK-trees over distinct fingerprints.

The fingerprint of a text is the bitwise majority of the XXH64 hashes (seed 42)
of its word shingles.  Two fingerprints link at ``radius`` or fewer differing
bits; documents are grouped by the components of these links.

Rows of one fingerprint are one node, so exact copies cost one row.  The 64 bits
are cut into ``blocks`` parts.  Fingerprints within the radius agree on at least
``blocks - radius`` whole parts, so each node goes to one shard per choice of
that many parts, and every link lies inside some shard.  A shard's BK-tree keys
children by their integer distance to the parent; a search follows only edges
within the radius of the distance just measured.  A task builds the trees of all
its shards together and returns a spanning forest, at most one edge per node
and shard, whatever the number of links.  A shard over ``shard_rows`` nodes is
cut into pieces, and each pair of pieces becomes a shard of its own.

No sharding loses a link; the number of parts only follows the number of nodes
so that shards stay small.  Components are joined by alternating star steps,
each written to the shared folder.

A null or empty text has fingerprint zero and links like any other.  A null id
never becomes a component's id unless the component has no other.  An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import partitions_for, stored, text_or_empty

BITS = 64
RADIUS = 4
SHINGLE = 4
SHARD_ROWS = 32_768
SHARD_TARGET = 64
TASK_ROWS = 400_000


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Bitwise majority of the shingle hashes; words are split at ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-width])).tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        hashes = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 1 << 16):
        ones += np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprint_hex(text):
    """The fingerprint as 16 hex digits."""
    return as_hex(fingerprints(text))


def as_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Forest:
    """BK-trees of many shards at once, as arrays of (parent, edge) keys."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        order = np.argsort(shard, kind="stable")
        self.value, shard = value[order], shard[order]
        self.order = order
        n = len(value)
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
        root = np.repeat(first, np.diff(np.concatenate((first, [n]))))
        self.root = root
        parent_edge = np.full(n, -1, np.int64)
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = root[waiting]
        while len(waiting):
            d = np.bitwise_count(self.value[waiting] ^ self.value[at]).astype(np.int64)
            key = at * (BITS + 1) + d
            uniq, lead, back = np.unique(key, return_index=True, return_inverse=True)
            parent_edge[waiting[lead]] = uniq
            at = waiting[lead][back]
            stay = np.ones(len(waiting), bool)
            stay[lead] = False
            waiting, at = waiting[stay], at[stay]
        nodes = np.flatnonzero(parent_edge >= 0)
        nodes = nodes[np.argsort(parent_edge[nodes], kind="stable")]
        self.child, self.edge = nodes, parent_edge[nodes]

    def near(self, query: np.ndarray, radius: int):
        """Pairs (query node, found node) within the radius, one tree level at a time."""
        at = self.root[query]
        while len(query):
            d = np.bitwise_count(self.value[query] ^ self.value[at]).astype(np.int64)
            hit = (d <= radius) & (at != query)
            yield query[hit], at[hit]
            base = at * (BITS + 1)
            lo = np.searchsorted(self.edge, base + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, base + np.minimum(d + radius, BITS), side="right")
            many = hi - lo
            query = np.repeat(query, many)
            if len(query):
                step = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many)
                at = self.child[np.repeat(lo, many) + step]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of linked nodes to their smallest, in place."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def shard_edges(shard: np.ndarray, value: np.ndarray, radius: int = RADIUS, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(value, value of its root) for a spanning forest of the links inside each shard."""
    forest = Forest(shard, value)
    label = np.arange(len(value))
    for at in range(0, len(value), block):
        for q, found in forest.near(np.arange(at, min(at + block, len(value))), radius):
            _merge(label, q, found)
    moved = np.flatnonzero(label != np.arange(len(value)))
    return forest.value[moved], forest.value[label[moved]]


def parts_for(nodes: int, radius: int = RADIUS) -> int:
    """Fewest parts for which an evenly filled shard holds about SHARD_TARGET nodes."""
    parts = radius + 1
    while nodes >> (BITS * (parts - radius) // parts) > SHARD_TARGET:
        parts += 1
    return parts


def _masks(parts: int, radius: int) -> list[int]:
    cuts = [BITS * i // parts for i in range(parts + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    sums = [sum(c) for c in combinations(pieces, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Edges (a, b) that span the links between distinct fingerprints ``fp``."""
    spark = nodes.sparkSession
    count = nodes.count()
    masks = _masks(parts_for(count, radius), radius)
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("held")) for i, m in enumerate(masks)]))
    dealt = nodes.select("fp", choice.alias("c")).select("fp", "c.*")
    crowded = (
        dealt.groupBy("choice", "held")
        .count()
        .filter(F.col("count") > shard_rows)
        .select("choice", "held", F.ceil(F.col("count") / (shard_rows // 2)).alias("pieces"))
    )
    piece = F.pmod(F.xxhash64("fp"), F.coalesce("pieces", F.lit(1)))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.coalesce("pieces", F.lit(1)).cast("long") - 1),
        lambda other: F.struct(F.least("piece", other).alias("low"), F.greatest("piece", other).alias("high")),
    )
    dealt = (
        dealt.join(crowded, ["choice", "held"], "left")
        .withColumn("piece", piece.cast("long"))
        .select("fp", "choice", "held", F.explode(pairs).alias("p"))
        .select("fp", F.xxhash64("choice", "held", "p.low", "p.high").alias("shard"))
    )
    tasks = partitions_for(spark, count * len(masks), TASK_ROWS)

    def search(batches):
        got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if got:
            value = np.concatenate([g[0] for g in got]).view(np.uint64)
            shard = np.concatenate([g[1] for g in got])
            a, b = shard_edges(shard, value, radius)
            for at in range(0, len(a), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(a[part].view(np.int64)), pa.array(b[part].view(np.int64))], names=["a", "b"])

    return dealt.repartition(tasks, "shard").mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node (as a signed number) of each linked set, by alternating star steps.

    Nodes without an edge are not listed.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    pairs, before = stored(pairs), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before or state[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(small.unionAll(small_low.select("a", F.col("m").alias("b"))).distinct())


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = stored(docs.select("doc_id", fingerprints(text_or_empty()).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
