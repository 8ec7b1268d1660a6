"""Removal of repeated 100-byte strings by a distributed sort of suffixes.

A byte goes when a 100-byte string that also starts earlier (smaller doc_id, or
the same document further left) covers it.  Texts are UTF-8 bytes; matches never
cross documents.

Every 100-byte window names one *anchor* inside it: the start of the 32-byte
string with the smallest hash among those it holds (the leftmost of equals).
Equal windows name the same place, so only anchors are sorted, about one in 35
bytes, and each stands for the run of windows that name it.

1. Anchors whose 32 bytes occur once cannot matter.  Hashes of the 32 bytes are
   exchanged, already collapsed in each batch, and the anchors of repeated ones
   go back to their documents (the approximate distinguishing prefix).
2. Those suffixes are sorted in runs, equal records of a run are settled where
   they are, and the runs are front-coded (length of the prefix shared with the
   suffix before, then the rest) and dealt out by the hash of their first 32
   bytes, which leads the sort key so that equal beginnings meet in one task
   without sampled splitters.
3. A task merges its runs with a loser tree that keeps, per head, the prefix
   length shared with the last suffix put out: unequal lengths decide without
   looking at a byte, equal ones compare on from there.  Suffixes that follow
   each other with 32 bytes in common are a family; within it, windows with the
   same anchor offset and bytes are one class, whose first place stays.  Large
   families are settled in chunks: of those with ``HOT`` records in a sorted run
   nothing but a mark goes to the merge, and no task holds more than
   ``FAMILY_RECORDS`` of one at once.  The places that stand in a chunk leave as
   digests of their windows, which are ranked over all chunks.
4. The repeated windows return to their documents as intervals, and the covered
   bytes are cut.

Null texts are empty; null ids come before all others.  Rows under one id are
told apart by a hash of their text; identical rows share their places, so they
do not repeat each other.  An empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import partitions_for, stored, text_batches, text_or_empty

SPAN = 100
GRAM = 32
REACH = SPAN - GRAM + 1
SLICE = 1 << 18
FLUSH_BYTES = 4 << 20
FLUSH_RECORDS = 50_000
TASK_ANCHORS = 1_000_000
FAMILY_RECORDS = 2_000
HOT = 64
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = SLICE + 2 * SPAN
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, anchor, first and last window of each run of windows; ``ends`` are where texts end."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    low = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= REACH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = REACH - step
    low = np.minimum(low[:-rest], low[rest:]) if rest else low
    at = (low & _LOW).astype(np.int64)
    marks = np.zeros(len(at) + SPAN, np.int64)
    np.add.at(marks, np.maximum(ends - SPAN + 1, 0)[ends - SPAN + 1 < len(marks)], 1)
    np.add.at(marks, ends[ends < len(marks)], -1)
    inside = np.cumsum(marks)[: len(at)] == 0
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    keep = inside[new]
    new, last = new[keep], last[keep]
    return h[at[new]], at[new], new, last


def slices(texts: list[bytes]):
    """(text numbers, their starts in the slice, where in each text they begin, bytes, ends)."""
    held, size = [], 0
    for k, text in enumerate(texts):
        for begin in range(0, max(len(text) - SPAN + 1, 0), SLICE):
            part = text[begin : begin + SLICE + SPAN - 1]
            if size + len(part) > SLICE + SPAN and held:
                yield held
                held, size = [], 0
            held.append((k, begin, part))
            size += len(part)
    if held:
        yield held


def batch_anchors(texts: list[bytes]):
    """hash, text number, anchor, first, last of all anchors of some texts."""
    out = []
    for held in slices(texts):
        sizes = np.array([len(p) for *_, p in held])
        ends = np.cumsum(sizes)
        h, at, lo, hi = anchors(np.frombuffer(b"".join(p for *_, p in held), np.uint8), ends)
        own = np.searchsorted(ends, at, side="right")
        shift = np.array([b for _, b, _ in held])[own] - (ends - sizes)[own]
        out.append((h, np.array([k for k, *_ in held])[own], at + shift, lo + shift, hi + shift))
    if not out:
        return [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4]
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _packed(h, doc, at, before, after, many) -> bytes:
    """Columns of anchors, one after the other, compressed."""
    raw = struct.pack("<q", len(h)) + b"".join(
        a.tobytes() for a in (h, doc.astype(np.int64), at.astype(np.int64), before.astype(np.uint8), after.astype(np.uint8), many.astype(np.uint8))
    )
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpacked(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    out, at = [], 8
    for kind in (np.uint64, np.int64, np.int64, np.uint8, np.uint8, np.uint8):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _parts(h: np.ndarray, tasks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int64)


def _dealt(h: np.ndarray, tasks: int) -> np.ndarray:
    """A task per hash, by the low bits: those of an anchor are the smallest of many in the high ones."""
    return (((h & _LOW) * np.uint64(tasks)) >> np.uint64(32)).astype(np.int64)


def _pieces(part: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal task numbers."""
    cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(part)], strict=True)) if cuts else []


def repeated_anchors(docs: DataFrame, tasks: int) -> DataFrame:
    """doc, at, before, after of the anchors whose 32 bytes occur more than once."""

    def deal(batches):
        docs_held, texts, size = [], [], 0

        def flush():
            h, k, at, lo, hi = batch_anchors(texts)
            doc = np.array(docs_held, np.int64)[k]
            order = np.lexsort((at, doc, h))
            h, doc, at, lo, hi = (a[order] for a in (h, doc, at, lo, hi))
            first = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
            many = np.zeros(len(h), np.uint8)
            twice = np.flatnonzero(~first)
            many[twice] = 1
            many[twice - 1] = 1
            # one of a hash is asked about, flag 0 or 1; the others, flag 2, are known to be repeated
            many[~first] = 2
            ask = np.where(first, h, (doc.astype(np.uint64) * np.uint64(_BASE)) ^ (at.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            part = _dealt(ask, tasks)
            by = np.argsort(part, kind="stable")
            rows = [by[a:b] for a, b in _pieces(part[by])]
            blobs = [_packed(h[r], doc[r], at[r], (at - lo)[r], (at - hi)[r], many[r]) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([int(part[r[0]]) for r in rows], pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                docs_held.append(doc)
                texts.append(data)
                size += len(data) + 64
                if size >= FLUSH_BYTES:
                    yield flush()
                    docs_held, texts, size = [], [], 0
        if texts:
            yield flush()

    def meet(batches):
        held = [_unpacked(b.as_py()) for batch in batches for b in batch.column(1)]
        if not held:
            return
        h, doc, at, before, after, many = (np.concatenate(c) for c in zip(*held, strict=True))
        asked = np.flatnonzero(many < 2)
        order = asked[np.argsort(h[asked], kind="stable")]
        same = h[order][1:] == h[order][:-1]
        again = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(order) else np.zeros(0, bool)
        keep = many > 0
        keep[order[again]] = True
        rows = np.flatnonzero(keep)
        for i in range(0, len(rows), 100_000):
            r = rows[i : i + 100_000]
            packed = (at[r] << 16) | (before[r].astype(np.int64) << 8) | after[r]
            yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(packed)], names=["doc", "place"])

    dealt = docs.select("doc", "text").mapInArrow(deal, "part long, blob binary")
    return dealt.repartition(tasks, "part").mapInArrow(meet, "doc long, place long")


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes are."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


_HEAD = struct.Struct("<BBBqqq")


def encoded_run(records: list[tuple]) -> bytes:
    """Sorted (key, left, doc, mark, at) records, front-coded."""
    out, last = [], b""
    for key, left, doc, mark, at in records:
        shared = shared_prefix(last, key)
        out.append(_HEAD.pack(shared, len(key) - shared, len(left), doc, mark, at))
        out.append(key[shared:])
        out.append(left)
        last = key
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decoded_run(blob: bytes):
    """(prefix shared with the record before, record) of a front-coded run."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, key = 0, b""
    while at < len(raw):
        shared, rest, side, doc, mark, place = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        key = key[:shared] + raw[at : at + rest]
        at += rest
        yield shared, (key, raw[at : at + side], doc, mark, place)
        at += side


def merged(runs: list):
    """(prefix shared with the record before, record) over all runs, by a loser tree.

    ``lcp[s]`` is the prefix that the head of run s shares with the last record
    put out.  A longer one wins unseen; equal ones compare from there on.
    """
    count = len(runs)
    heads, lcp = [None] * count, [0] * count
    for s, run in enumerate(runs):
        lcp[s], heads[s] = next(run, (-1, None))
        if heads[s] is not None:
            lcp[s] = 0

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser's lcp becomes that with the winner."""
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        if heads[a] is None:
            return a, b
        x, y = heads[a][0], heads[b][0]
        n = shared_prefix(x, y, lcp[a])
        if x[n : n + 1] <= y[n : n + 1]:
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    size = 1
    while size < count:
        size *= 2
    lost = [-1] * (2 * size)
    winners = [*[-1] * size, *range(count), *[-1] * (size - count)]
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], lost[node] = (a, b) if b < 0 else play(a, b)
    top = winners[1]
    while heads[top] is not None:
        yield lcp[top], heads[top]
        lcp[top], heads[top] = next(runs[top], (-1, None))
        node = (top + size) // 2
        while node:
            rival = lost[node]
            if rival >= 0:
                if lcp[rival] > lcp[top]:
                    lost[node], top = top, rival
                elif lcp[rival] == lcp[top]:
                    top, lost[node] = play(top, rival)
            node //= 2


def family_repeats(family: list[tuple], standing: list | None = None):
    """(doc, mark, first, last) runs of repeated windows in one family of records.

    ``standing`` takes (digest, doc, mark, first) of the windows that stand, where
    the records are not the whole family.
    """
    firsts: dict[tuple, tuple] = {}
    for record in family:
        content = record[:2]
        place = (record[2], record[4])
        held = firsts.get(content)
        if held is None:
            firsts[content] = record
        else:
            if place < (held[2], held[4]):
                firsts[content], record = record, held
            if (record[2], record[4]) != (firsts[content][2], firsts[content][4]):
                yield record[2], record[3], record[4] - len(record[1]), record[4] - (SPAN + 8 - len(record[0]))
    if len(firsts) < 2 and standing is None:
        return
    distinct = [(k[8:], left, doc, mark, at) for k, left, doc, mark, at in firsts.values()]
    repeated: list[list[int]] = [[] for _ in distinct]
    for o in range(max(len(r[1]) for r in distinct) + 1):
        first: dict[bytes, tuple] = {}
        rows = []
        for k, (right, left, doc, _, at) in enumerate(distinct):
            if SPAN - len(right) <= o <= len(left):
                window = left[len(left) - o :] + right[: SPAN - o]
                place = (doc, at - o)
                rows.append((k, window, place))
                if window not in first or place < first[window]:
                    first[window] = place
        if len(first) < len(rows):
            for k, window, place in rows:
                if place != first[window]:
                    repeated[k].append(o)
        if standing is not None:
            standing.extend((xxhash.xxh3_128_digest(window), *distinct[k][2:4], place[1]) for k, window, place in rows if place == first[window])
    for (_, _, doc, mark, at), offsets in zip(distinct, repeated, strict=True):
        start = None
        for i, o in enumerate(offsets):
            start = o if start is None else start
            if i + 1 == len(offsets) or offsets[i + 1] != o + 1:
                yield doc, mark, at - o, at - start
                start = None


def _packed_windows(standing: list[tuple]) -> bytes:
    """Windows that stand in a chunk, compressed."""
    digests, *columns = zip(*standing, strict=True)
    raw = struct.pack("<q", len(standing)) + b"".join(np.array(c, np.int64).tobytes() for c in columns) + b"".join(digests)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _window_rows(blob: bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", raw)[0]
    doc, mark, first = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(3, n)
    begin = 8 + 24 * n
    digests = [raw[begin + 16 * i : begin + 16 * i + 16] for i in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), *map(pa.array, (doc, mark, first, first))], names=_FOUND)


def _run_rows(columns) -> pa.RecordBatch:
    columns = [pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.binary()), *columns], names=_FOUND)


_HOT_MARK = b"hot "  # no compressed run begins so
_FOUND = ["digest", "doc", "mark", "first", "last"]


def repeated_windows(docs: DataFrame, suspects: DataFrame, tasks: int) -> DataFrame:
    """doc, mark, first, last: runs of window starts whose 100 bytes also start earlier."""
    places = suspects.groupBy("doc").agg(F.collect_list("place").alias("places"))
    met = docs.select("doc", "mark", squeezed("text").alias("z")).join(places, "doc")

    def runs(batches):
        open_zip = zstandard.ZstdDecompressor()
        seen: dict[tuple, tuple] = {}
        settled: list[tuple] = []

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

        def flush():
            """Equal records of the batch are repeats already, large families are settled here; the rest leaves in sorted runs."""
            records = sorted((key, left, *place) for (key, left), place in seen.items())
            seen.clear()
            family = _pieces(np.cumsum([not i or records[i - 1][0][: 8 + GRAM] != r[0][: 8 + GRAM] for i, r in enumerate(records)]))
            hot, rest, standing = [], [], []
            for a, b in family:
                if b - a < HOT:
                    rest += records[a:b]
                    continue
                hot.append(records[a][0][: 8 + GRAM])
                for at in range(a, b, FAMILY_RECORDS):
                    settled.extend(family_repeats(records[at : min(b, at + FAMILY_RECORDS)], standing))
                    if len(standing) > 100_000:
                        yield sent([(-2, _packed_windows(standing))])
                        standing.clear()
            if standing:
                yield sent([(-2, _packed_windows(standing))])
            home = _parts(np.array([int.from_bytes(k[:8], "big") for k in hot], np.uint64), tasks)
            part = _parts(np.array([int.from_bytes(r[0][:8], "big") for r in rest], np.uint64), tasks)
            done = list(zip(*settled, strict=True)) if settled else [[]] * 4
            gone = struct.pack("<q", len(settled)) + b"".join(np.array(c, np.int64).tobytes() for c in done)
            settled.clear()
            marks = [(int(p), _HOT_MARK + k) for p, k in zip(home, hot, strict=True)]
            yield sent([*((int(part[a]), encoded_run(rest[a:b])) for a, b in _pieces(part)), *marks, (-1, gone)])

        for batch in batches:
            for doc, mark, z, held in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, mark = doc.as_py(), mark.as_py()
                text = open_zip.decompress(z.as_py())
                packed = held.values.to_numpy(zero_copy_only=False)
                for at, before, after in zip((packed >> 16).tolist(), ((packed >> 8) & 255).tolist(), (packed & 255).tolist(), strict=True):
                    if at - after + SPAN > len(text):
                        continue  # a place of another row under this id
                    right = text[at : at - after + SPAN]
                    key = xxhash.xxh64_digest(right[:GRAM]) + right
                    left = text[at - before : at]
                    old = seen.get((key, left))
                    if old is None:
                        seen[key, left] = (doc, mark, at)
                    elif (old[0], old[2]) != (doc, at):
                        new = (doc, mark, at)
                        if (doc, at) < (old[0], old[2]):
                            seen[key, left], new = new, old
                        settled.append((new[0], new[1], new[2] - before, new[2] - after))
                if len(seen) >= FLUSH_RECORDS or len(settled) >= 4 * FLUSH_RECORDS:
                    yield from flush()
        if seen or settled:
            yield from flush()

    def merge(batches):
        held, hot, out, standing = [], set(), [], []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = blob.as_py()
                if part == -2:
                    yield _window_rows(blob)
                elif part == -1:
                    n = struct.unpack_from("<q", blob)[0]
                    if n:
                        yield _run_rows(np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, n))
                elif blob.startswith(_HOT_MARK):
                    hot.add(blob[len(_HOT_MARK) :])
                else:
                    held.append(decoded_run(blob))
        if not held:
            return

        def full(most: int):
            if len(out) > most:
                yield _run_rows(zip(*out, strict=True))
                out.clear()
            if len(standing) > most:
                yield _window_rows(_packed_windows(standing))
                standing.clear()

        family: list[tuple] = []
        large = False  # other records of the family are settled elsewhere
        for shared, record in merged(held):
            if shared < 8 + GRAM:
                if family and (large or len(family) > 1):
                    out.extend(family_repeats(family, standing if large else None))
                family, large = [], record[0][: 8 + GRAM] in hot
                yield from full(100_000)
            elif len(family) >= FAMILY_RECORDS:
                out.extend(family_repeats(family, standing))
                family, large = [], True
                yield from full(100_000)
            family.append(record)
        if family and (large or len(family) > 1):
            out.extend(family_repeats(family, standing if large else None))
        yield from full(0)

    dealt = met.select("doc", "mark", "z", "places").mapInArrow(runs, "part long, blob binary")
    route = F.when(F.col("part") < 0, F.xxhash64("blob")).otherwise(F.xxhash64("part"))
    merging = dealt.withColumn("route", route).repartition(tasks, "route").select("part", "blob")
    found = stored(merging.mapInArrow(merge, "digest binary, doc long, mark long, first long, last long"))
    place = F.rank().over(Window.partitionBy("digest").orderBy("doc", "first"))  # equal places do not repeat each other
    open_ = found.filter("digest IS NOT NULL").withColumn("place", place).filter("place > 1")
    return found.filter("digest IS NULL").select(*_FOUND[1:]).unionByName(open_.select(*_FOUND[1:]))


@F.pandas_udf(T.BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    """The text's UTF-8 bytes, compressed for the way through a shuffle."""
    zip_ = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: zip_.compress(t.encode("utf-8", "replace")))


def cut(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int]:
    """The text without the windows that start in [first, last] runs, and how many runs of bytes went."""
    order = np.argsort(first)
    first, stop = first[order], np.maximum.accumulate(last[order] + SPAN)
    new = np.concatenate(([True], first[1:] > stop[:-1]))
    begins = first[new]
    ends = np.concatenate((stop[:-1][new[1:]], stop[-1:]))
    kept, at = [], 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), len(begins)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    text_batches(spark)
    text = text_or_empty()
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text.alias("text"), F.xxhash64(text).alias("mark"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = partitions_for(spark, size // 35, TASK_ANCHORS)
    suspects = stored(repeated_anchors(rows, tasks))
    repeats = repeated_windows(rows, suspects, tasks)
    runs = repeats.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    met = rows.select("doc_id", "doc", "mark", squeezed("text").alias("z")).join(runs, ["doc", "mark"], "left")

    def finish(batches):
        open_zip = zstandard.ZstdDecompressor()
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for z, held in zip(batch.column(1), batch.column(2), strict=True):
                whole = open_zip.decompress(z.as_py())
                kept, spans = whole, 0
                if held.is_valid:
                    kept, spans = cut(whole, *(held.values.field(i).to_numpy(zero_copy_only=False) for i in range(2)))
                out.append((len(whole), len(whole) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=names)

    return met.select("doc_id", "z", "runs").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
