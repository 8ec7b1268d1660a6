"""Embedders: a deterministic hashing vectoriser and model-backed batch functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import fixed_values as fv
from lodestone.functions.text import col, hash_tokens, let

_CACHE_LIMIT = 500_000
_ROWS = 1024
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True


def _tokens(texts: list) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of every run of ``[a-z0-9]`` in the lower-cased texts, in order; null is empty."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = b"\0".join([*parts, b""])
    inside = np.concatenate([[False], _LETTERS[np.frombuffer(raw, dtype=np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edges[::2], edges[1::2]
    ends = np.cumsum([len(p) + 1 for p in parts])
    sizes = last - first
    # the bytes of the tokens alone, one after the other
    letters = np.frombuffer(raw, dtype=np.uint8)[inside[1:-1]]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    tokens = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters)))
    return np.searchsorted(ends, first, side="right"), tokens


def hashing_vector(text: Column | str, dim: int = fv.EMBED_DIM) -> Column:
    """Signed token counts per hash slot, as ``array<float>``.

    The counts are whole numbers, so dot products and squared norms are exact;
    scaling to unit length is left to the cosine (or to :func:`unit_vector`).
    """
    slots: dict[str, int] = {}

    def slot(token: str) -> int:
        """Place in a row of two parts: the counts to add, then those to take away."""
        found = slots.get(token)
        if found is None:
            digest = hashlib.md5(token.encode()).digest()
            found = int.from_bytes(digest[:4], "big") % dim + (0 if digest[4] & 1 else dim)
            if len(slots) < _CACHE_LIMIT:
                slots[token] = found
        return found

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for start in range(0, len(texts), _ROWS):
            rows, tokens = _tokens(texts.slice(start, _ROWS).to_pylist())
            words = tokens.dictionary_encode()
            known = np.array([slot(t) for t in words.dictionary.to_pylist()], dtype=np.int64)
            n = min(_ROWS, len(texts) - start)
            at = rows * (2 * dim) + known[words.indices.to_numpy()]
            counts = np.bincount(at, minlength=n * 2 * dim).reshape(n, 2, dim)
            out[start : start + n] = counts[:, 0] - counts[:, 1]
        offsets = np.arange(0, (len(texts) + 1) * dim, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return embed(col(text))


def sparse_counts(df: DataFrame, text: str, key: str, dim: int = fv.EMBED_DIM) -> DataFrame:
    """The same vectoriser as a relation ``(key, slot, value)``, without Python."""
    digest = F.md5("token")
    slot = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).alias("slot")
    odd = F.conv(F.substring(digest, 9, 2), 16, 10).cast("int").bitwiseAND(1)
    sign = F.when(odd == 1, F.lit(1)).otherwise(F.lit(-1)).alias("sign")
    return (
        df.select(key, F.explode(hash_tokens(text)).alias("token"))
        .select(key, slot, sign)
        .groupBy(key, "slot")
        .agg(F.sum("sign").alias("value"))
        .filter(F.col("value") != 0)
    )


def unit_vector(vector: Column | str) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    v = col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    # bound once: as a plain column it would be computed anew for every component
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def model_vector(make_predict_fn, text: Column | str, batch_size: int = 64) -> Column:
    """A model embedder: ``make_predict_fn()`` loads once per worker, then encodes batches."""
    udf = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    return udf(col(text))


def embedder(name: str = "hashing", make_predict_fn=None, dim: int = fv.EMBED_DIM):
    """Column function by name: ``hashing``, ``bge`` or ``finetuned``."""
    choice = name.lower()
    if choice == "hashing":
        return lambda text: hashing_vector(text, dim)
    if choice in ("bge", "finetuned"):
        if make_predict_fn is None:
            raise ValueError(f"embedder {choice!r} needs a model loader (make_predict_fn)")
        return lambda text: model_vector(make_predict_fn, text)
    raise ValueError(f"unknown embedder: {choice!r}")
