"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is split by the vocabulary's pattern; each piece is encoded by itself.  A
piece that is a token is that token.  Otherwise every byte position is a leaf of
a segment tree that holds the rank of the pair which begins there, and an inner
node holds the smallest of its leaves, the leftmost on ties: the root names the
next merge.  A merge takes one position out and changes the pairs of at most two
live neighbours, so it is three point updates of logarithmic depth, and a piece
of n bytes takes O(n log n) however long it is.

Pieces repeat, so each Python worker remembers the ids of short pieces up to a
bound; beyond the bound it begins anew.  The bound changes time, not ids.  The
vocabulary is a file the driver reads once (its size is checked) and broadcasts.

A null text counts as empty and has no ids.  Rows never meet: repeated rows are
encoded alike, an empty table gives an empty result, other columns do not
matter.  ``decode`` of null is null, and an id that the vocabulary does not have
is an error, since leaving it out would change the text.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lodestone.llm.common import text_or_empty

VOCABULARY_BYTES = 64 << 20
REMEMBERED = 1_000_000
SHORT_CHARS = 48
#: a tree of so many leaves and more is kept in packed arrays
PACKED = 4096
NEVER = (1 << 63) - 1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always the pair of smallest rank merges, the leftmost of equals."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    leaves = 1 << (n - 1).bit_length()
    after, before = range(1, n + 1), range(-1, n - 1)
    if leaves < PACKED:
        tree, after, before = [NEVER] * (2 * leaves), list(after), list(before)
    else:
        tree, after, before = array("q", [NEVER]) * (2 * leaves), array("q", after), array("q", before)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r * leaves + i
    for node in range(leaves - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    half = leaves >> 1
    while tree[1] != NEVER:
        at = tree[1] & (leaves - 1)
        gone = after[at]
        end = after[gone]
        after[at] = end
        tree[leaves + gone] = tree[leaves + at] = NEVER
        changed = [gone, at]
        if end < n:
            before[end] = at
            r = rank(piece[at : after[end]])
            if r is not None:
                tree[leaves + at] = r * leaves + at
        ahead = before[at]
        if ahead >= 0:
            r = rank(piece[ahead:end])
            tree[leaves + ahead] = NEVER if r is None else r * leaves + ahead
            changed.append(ahead)
        # the three leaves' ancestors, as far up as their minimum changes
        for position in changed:
            node = half + (position >> 1)
            while node:
                left, right = tree[2 * node], tree[2 * node + 1]
                if right < left:
                    left = right
                if tree[node] == left:
                    break
                tree[node] = left
                node >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class Codec(dict):
    """piece -> ids, filled as pieces come; and the bytes of each id."""

    def __init__(self, vocabulary: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = tuple(merged(data, self.ranks)) if whole is None else (whole,)
        if len(piece) <= SHORT_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str):
        return chain.from_iterable(map(self.__getitem__, self.pieces(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(vocabulary: bytes, pattern: str) -> Codec:
    return Codec(vocabulary, pattern)


def _ids(codec: Codec, texts: pa.Array) -> pa.Array:
    flat, offsets = array("i"), [0]
    for text in texts:
        flat.extend(codec.encode(text.as_py()))
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))


def _data(codec: Codec, rows: pa.Array) -> pa.Array:
    ids, ends = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_pylist()
    there = rows.is_valid().to_pylist()
    return pa.array([codec.decode(ids[a:b].tolist()) if t else None for a, b, t in zip(ends, ends[1:], there)], pa.binary())


class Tokenizer:
    """The column functions of one vocabulary file (lines of base64 token and rank) and its pattern."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        size = Path(path).stat().st_size
        if size > VOCABULARY_BYTES:
            raise ValueError(f"{path} has {size} bytes; a vocabulary of up to {VOCABULARY_BYTES} is broadcast")
        self._file = spark.sparkContext.broadcast(Path(path).read_bytes())
        self._pattern = pattern

    def encode(self, text: Column) -> Column:
        """The ids of each text, array<int>."""
        file, pattern = self._file, self._pattern

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            return _ids(_codec(file.value, pattern), texts)

        return ids(text)

    def round_trip(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """key, ids of each row, and ``data``, the bytes that the ids decode to.

        One step of its own: column functions over ids would hold all ids of a
        task aside, on disk, while they are decoded.
        """
        file, pattern = self._file, self._pattern

        def run(batches):
            for batch in batches:
                codec = _codec(file.value, pattern)
                ids = _ids(codec, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, _data(codec, ids)], [key, "ids", "data"])

        rows = docs.select(key, text_or_empty(text))
        made = [StructField("ids", ArrayType(IntegerType())), StructField("data", BinaryType())]
        return rows.mapInArrow(run, StructType([rows.schema[0], *made]))

    def decode(self, ids: Column) -> Column:
        """The bytes that the ids stand for; they are UTF-8 where the ids are those of a text."""
        file, pattern = self._file, self._pattern

        @F.arrow_udf("binary")
        def data(rows: pa.Array) -> pa.Array:
            return _data(_codec(file.value, pattern), rows)

        return data(ids)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return Tokenizer(docs.sparkSession, path, pattern).round_trip(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
