"""Benchmark decontamination by spaced-seed hashing.

A text is contaminated by a benchmark item when, on one alignment, some window
of ``WINDOW`` consecutive words of the item has at least ``SIMILARITY`` of them
equal in the text (substitutions only; an item under ``WINDOW`` words has to
occur whole).  Words are runs of letters and digits, compared in lower case.

Seeds ignore fixed positions: each mask names the words of a span whose hashes
are combined, so a substituted word at an ignored position does not hide the
hit.  The masks below hit every window of 13 words with at most 2 substitutions
(tests try all of them).  Item seeds are the held side of a hash join: they are
cut into blocks of bounded size, and each block is met with the texts where they
lie, so texts are never shuffled.  Hits are verified along their alignment.

The benchmark is a stated query set: blocks of items against all texts.  Null or
empty texts and items match nothing; null ids are carried; repeated rows give
repeated results; an empty table gives an empty result; only the columns
doc_id, text and item_id, text are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_or_empty

WINDOW = 13
SIMILARITY = 0.8
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
BLOCK_WORDS = 1_000_000
#: pairs of places expanded at once, and alignments remembered of one text
HIT_PAIRS, KNOWN_ALIGNMENTS = 1 << 20, 20_000
PIECE = 1 << 20
SCHEMA = "doc_id long, item_id long, first_word long, n_matched long, similarity double"

_PUNCTUATION = re.compile("[\u0080-©«-´¶-¹»-¿ -⁯　-〿]+")
_BASE, _UNDO = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[np.r_[48:58, 97:123, 128:256]] = True


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _UNDO, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _piece_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = _WORD_BYTE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(1 << max(10, int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word; long texts are read in pieces cut between words."""
    lowered = text.lower()
    if not lowered.isascii():
        lowered = _PUNCTUATION.sub(" ", lowered)
    data = lowered.encode("utf-8", "replace")
    out, at = [], 0
    while len(data) - at > PIECE:
        cut = next((m.start() for m in re.compile(rb"[^0-9a-z\x80-\xff]").finditer(data, at + PIECE)), len(data))
        out.append(_piece_hashes(data[at:cut]))
        at = cut
    out.append(_piece_hashes(data[at:]))
    return np.concatenate(out)


def _seeds(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 1000 + mask[-1], np.uint64)
    for k, offset in enumerate(mask):
        total = _mix(total + words[offset : offset + n] * np.uint64(2 * k + 3))
    return total


class Block:
    """Seeds of some items: sorted, with a bitmap of their low bits in front."""

    def __init__(self, ids: list, texts: list[str]):
        words = [word_hashes(t or "") for t in texts]
        pairs = [(i, w) for i, w in zip(ids, words, strict=True) if len(w)]
        self.ids, self.words = [p[0] for p in pairs], [p[1] for p in pairs]
        short = {len(w) for w in self.words if len(w) < WINDOW}
        self.masks = [*MASKS, *(tuple(range(n)) for n in sorted(short))]
        seeds, items, places = [], [], []
        for k, w in enumerate(self.words):
            for mask in self.masks if len(w) < WINDOW else MASKS:
                if len(w) < WINDOW and mask != tuple(range(len(w))):
                    continue
                s = _seeds(w, mask)
                seeds.append(s)
                items.append(np.full(len(s), k))
                places.append(np.arange(len(s)))
        self.seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(self.seed, kind="stable")
        self.seed = self.seed[order]
        self.item = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.place = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.low = np.uint64((1 << max(16, len(self.seed).bit_length() + 4)) - 1)
        self.bitmap = np.zeros(int(self.low) + 1, bool)
        self.bitmap[(self.seed & self.low).astype(np.int64)] = True

    def _hits(self, words: np.ndarray):
        """Distinct (item, alignment) pairs that share a seed with the text."""
        found = []
        for mask in self.masks:
            s = _seeds(words, mask)
            at = np.flatnonzero(self.bitmap[(s & self.low).astype(np.int64)])
            lo = np.searchsorted(self.seed, s[at])
            many = np.searchsorted(self.seed, s[at], side="right") - lo
            # a repeated seed meets a repeated seed in many pairs of few alignments: bounded pieces, each reduced
            pieces = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + HIT_PAIRS, HIT_PAIRS), side="left"))
            for a, b in zip(pieces, [*pieces[1:], len(at)]):
                n, low = many[a:b], lo[a:b]
                if n.any():
                    where = np.repeat(at[a:b], n)
                    k = np.repeat(low, n) + np.arange(len(where)) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.unique((self.item[k] << 40) + (where - self.place[k] + (1 << 39))))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack((pairs >> 40, (pairs & ((1 << 40) - 1)) - (1 << 39)), axis=1).tolist()

    def _verified(self, item: int, lo: int, hi: int, aligned: np.ndarray):
        """(first window, words matched, best similarity) of the item's words lo to hi against as many of a text."""
        held = self.words[item]
        size = min(WINDOW, len(held))
        same = held[lo:hi] == aligned
        counts = np.convolve(same, np.ones(size, np.int64), "valid")
        good = np.flatnonzero(counts >= (size if len(held) < WINDOW else SIMILARITY * size))
        if not len(good):
            return None
        covered = np.zeros(hi - lo + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + size, -1)
        return int(good[0]), int((same & (np.cumsum(covered[:-1]) > 0)).sum()), float(counts[good].max()) / size

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item_id, first matching word, words matched, best window similarity) per item."""
        best: dict[int, list] = {}
        known: dict = {}
        for item, shift in self._hits(words):
            held = self.words[item]
            lo, hi = max(0, -shift), min(len(held), len(words) - shift)
            if hi - lo < min(WINDOW, len(held)):
                continue
            # a text that repeats itself shows an item the same words at many alignments: each is verified once
            aligned = words[lo + shift : hi + shift]
            key = (item, lo, aligned.tobytes())
            if key not in known:
                if len(known) >= KNOWN_ALIGNMENTS:
                    known.clear()
                known[key] = self._verified(item, lo, hi, aligned)
            if known[key] is None:
                continue
            first, matched, similarity = known[key]
            row = best.setdefault(item, [first + lo + shift, 0, 0.0])
            row[0] = min(row[0], first + lo + shift)
            row[1] = max(row[1], matched)
            row[2] = max(row[2], similarity)
        return [(self.ids[item], *row) for item, row in sorted(best.items())]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """The items in blocks of about ``block_words`` words, one block in the driver at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text or "") // 5 + 1
        if size >= block_words:
            yield Block(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per text and item that leaks into it."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_matched", pa.int64()), ("similarity", pa.float64())])

    def scan(shared):
        def over(batches):
            block = shared.value
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    hits = block.matches(word_hashes(text.as_py()))
                    if hits:
                        out.extend((doc_id.as_py(), *h) for h in hits)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return over

    found = [rows.mapInArrow(scan(spark.sparkContext.broadcast(b)), SCHEMA) for b in blocks(benchmark, block_words)]
    if not found:
        return spark.createDataFrame([], SCHEMA)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def leaks_into(shared):
    """A column function: whether any item of the broadcast block leaks into a text."""

    @F.pandas_udf(T.BooleanType())
    def leaks(texts: pd.Series) -> pd.Series:
        held = shared.value
        return texts.map(lambda t: bool(held.matches(word_hashes(t))))

    return leaks


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with no leaked item, decided where they lie, without a shuffle."""
    for block in blocks(benchmark, block_words):
        leaks = leaks_into(docs.sparkSession.sparkContext.broadcast(block))
        docs = docs.filter(~leaks(text_or_empty()))
    return docs
