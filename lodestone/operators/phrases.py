"""Entities and relations by a table of phrases.

A lexicon of any size is read in blocks of bounded bytes, in priority order.
Each block becomes one table of phrase hashes in every Python worker.  A slice
of texts is looked up at once: each run of as many words as some phrase has is
hashed from prefix sums, and what meets a phrase's hash is compared with it.
The places of all blocks are settled where they are found, the earlier entry
first, as for a small lexicon; only the places that stay leave the worker.
Nothing is shuffled, and the driver holds one block at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import col

BLOCK_BYTES = 32 << 20
SLICE_CHARS = 1 << 19  # characters looked up at once, unless one text is longer
ENTITIES = "array<struct<start:int,name:string,type:string>>"
CUES = "array<struct<cue:int,start:int,priority:int,object:string>>"
_BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be undone
_UNBASE = pow(_BASE, -1, 1 << 64)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


@lru_cache(maxsize=1)
def _word_codes() -> np.ndarray:
    return np.fromiter((_word(chr(c)) for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    held = np.full(n, base, np.uint64)
    held[0] = 1
    return np.cumprod(held, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Slice:
    """Lower-case texts side by side, a line end between them: code points, word runs, and hashes of any stretch."""

    def __init__(self, texts: list[str]):
        self.codes = _codes("\n".join(texts))
        self.row_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.row_ends = self.row_starts[1:] - 1
        self.word = _word_codes()[self.codes]
        edges = np.flatnonzero(np.diff(self.word, prepend=False, append=False))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.rows = np.searchsorted(self.row_starts, self.starts, "right") - 1
        n = max(SLICE_CHARS, 1 << len(self.codes).bit_length())
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(self.codes * _powers(_BASE, n)[: len(self.codes)], out=self.sums[1:])
        self.back = _powers(_UNBASE, n)

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[s]) * self.back[s]


class Places:
    """The phrases of one block, each with its first entry, to be found at whole words."""

    def __init__(self, entries: tuple):
        first: dict[str, tuple] = {}
        for entry in sorted(entries, key=lambda e: (e[0], e[1], e[2] or "")):
            if _word(entry[1][0]):
                first.setdefault(entry[1], entry)
        held = Slice(list(first))
        at, ends = held.row_starts[:-1], held.row_ends
        hashes = held.hashes(at, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.codes, self.at, self.sizes = hashes[order], held.codes, at[order], (ends - at)[order]
        entries = list(first.values())
        kept = [entries[i] for i in order.tolist()]
        self.priorities = np.array([e[0] for e in kept], np.int64)
        self.names, self.types = (pa.array([e[c] for e in kept], pa.string()) for c in (1, 2))
        # a phrase that ends in a word is met by its number of words, any other by its length
        closed = held.word[ends - 1]
        self.counts = np.unique(np.bincount(held.rows, minlength=len(first))[closed]).tolist()
        self.lengths = np.unique((ends - at)[~closed]).tolist()
        self.shift = np.uint64(64 - max(16, (16 * len(kept)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.hashes >> self.shift] = True
        _, runs = np.unique(self.hashes, return_counts=True)
        self.most = int(runs.max()) if len(runs) else 0

    def find(self, texts: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, phrase) of every whole-word place, in the slice's positions."""
        found = [(np.zeros(0, np.int64),) * 3]
        for k in self.counts:
            n = len(texts.starts) - k + 1
            if n > 0:
                same = texts.rows[:n] == texts.rows[k - 1 :]
                found += self._meet(texts, texts.starts[:n][same], texts.ends[k - 1 :][same])
        for k in self.lengths:
            last = texts.row_ends[texts.rows]
            inside = texts.starts + k <= last
            s, e, last = texts.starts[inside], texts.starts[inside] + k, last[inside]
            free = (e == last) | ~texts.word[np.minimum(e, len(texts.codes) - 1)]
            found += self._meet(texts, s[free], e[free])
        return tuple(np.concatenate(c) for c in zip(*found))

    def _meet(self, texts: Slice, s: np.ndarray, e: np.ndarray):
        hashes = texts.hashes(s, e)
        near = self.seen[hashes >> self.shift]
        s, e, hashes = s[near], e[near], hashes[near]
        at = np.searchsorted(self.hashes, hashes)
        for _ in range(self.most):  # phrases of one hash lie side by side
            which = np.minimum(at, len(self.hashes) - 1)
            met = np.flatnonzero((self.hashes[which] == hashes) & (at < len(self.hashes)) & (self.sizes[which] == e - s))
            yield self._equal(texts, s[met], e[met], which[met])
            at = at + 1

    def _equal(self, texts: Slice, s, e, which):
        """What has the hash and length of a phrase, letter by letter."""
        if not len(s):
            return s, e, which
        sizes = e - s
        firsts = np.cumsum(sizes) - sizes
        step = np.arange(firsts[-1] + sizes[-1])
        same = texts.codes[step + np.repeat(s - firsts, sizes)] == self.codes[step + np.repeat(self.at[which] - firsts, sizes)]
        good = np.logical_and.reduceat(same, firsts)
        return s[good], e[good], which[good]


@lru_cache(maxsize=8)
def _places(entries: tuple) -> Places:
    return Places(entries)


def _settled(s: np.ndarray, e: np.ndarray, priority: np.ndarray) -> np.ndarray:
    """The places that stay, in text order: an earlier phrase takes its place first."""
    by_start = np.argsort(s, kind="stable")
    reach = np.maximum.accumulate(e[by_start])
    after = np.ones(len(s), bool)
    after[1:] = s[by_start][1:] >= reach[:-1]
    before = np.append(after[1:], True)
    lone, met = by_start[after & before], by_start[~(after & before)]
    met = met[np.lexsort((met, e[met], s[met], priority[met]))]
    taken, stay = bytearray(int(e.max(initial=0))), []
    for i, a, b in zip(met.tolist(), s[met].tolist(), e[met].tolist()):
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            stay.append(i)
    kept = np.concatenate([lone, np.array(stay, np.int64)])
    return kept[np.argsort(s[kept])]


def _entities(texts: list[str], blocks: list[Places]) -> pa.Array:
    """Per text its entities; places of all blocks are settled together."""
    held = Slice(texts)
    shifts = np.cumsum([0, *(len(b.names) for b in blocks)])
    found = [(s, e, which + shift) for b, shift in zip(blocks, shifts) for s, e, which in (b.find(held),)]
    s, e, which = (np.concatenate(c) for c in zip(*found))
    kept = _settled(s, e, np.concatenate([b.priorities for b in blocks])[which])
    rows = np.searchsorted(held.row_starts, s[kept], "right") - 1
    entry = pa.array(which[kept])
    names, types = (pa.chunked_array([getattr(b, c) for b in blocks]).take(entry).combine_chunks() for c in ("names", "types"))
    start = pa.array((s[kept] - held.row_starts[rows]).astype(np.int32))
    offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([start, names, types], ["start", "name", "type"]))


def _slices(texts: list[str]):
    held, size = [], 0
    for t in texts:
        if held and size + len(t) >= SLICE_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    yield held


class Automaton:
    """The phrases of one block: (priority, name, type), lower case."""

    def __init__(self, entries: tuple):
        self.places = ahocorasick.Automaton()
        self.entries = sorted(entries)
        by_name: dict[str, list] = {}
        for entry in self.entries:
            by_name.setdefault(entry[1], []).append(entry)
        for name, held in by_name.items():
            self.places.add_word(name, held)
        self.places.make_automaton()
        # all names in lexicon order, to look for those that hold a given text
        self.joined = "\n".join(e[1] for e in self.entries)
        self.starts = [0]
        for e in self.entries:
            self.starts.append(self.starts[-1] + len(e[1]) + 1)

    def named_by(self, text: str):
        """(priority, name) of the first phrase that the text holds or that holds the text."""
        if not self.entries:
            return None
        inside = min((held[0] for _, held in self.places.iter(text)), default=None)
        at = self.joined.find(text) if "\n" not in text else -1
        around = self.entries[bisect_right(self.starts, at) - 1] if at >= 0 else None
        return min((e for e in (inside, around) if e is not None), default=None)


@lru_cache(maxsize=8)
def _automaton(entries: tuple) -> Automaton:
    return Automaton(entries)


class Phrases:
    """The column functions of a lexicon table: name, type, priority (a smaller one comes first)."""

    def __init__(self, lexicon: DataFrame, block_bytes: int = BLOCK_BYTES):
        spark = lexicon.sparkSession
        rows = lexicon.select("priority", F.lower("name").alias("name"), "type").filter("name <> ''").orderBy("priority", "name", "type")
        self.blocks, block, size = [], [], 0
        for r in rows.toLocalIterator():
            block.append((int(r.priority), r.name, r.type))
            size += len(r.name.encode()) + len((r.type or "").encode()) + 16
            if size >= block_bytes:
                self.blocks.append(spark.sparkContext.broadcast(tuple(block)))
                block, size = [], 0
        if block or not self.blocks:
            self.blocks.append(spark.sparkContext.broadcast(tuple(block)))

    def settled(self, text: Column | str) -> Column:
        """The entities of a text, in text order."""
        blocks = self.blocks

        @F.arrow_udf(ENTITIES)
        def entities(texts: pa.Array) -> pa.Array:
            lows = [(t or "").lower() for t in texts.to_pylist()]
            held = [_places(b.value) for b in blocks]
            return pa.concat_arrays([_entities(part, held) for part in _slices(lows)])

        return entities(col(text))

    def entities(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        """(tenant, artifact, chunk, start, name, type, confidence), one row per mention."""
        found = chunks.select("tenant_id", "artifact_id", "chunk_id", F.explode(self.settled(text)).alias("e"))
        return found.select("tenant_id", "artifact_id", "chunk_id", "e.*", F.lit(fv.ENTITY_CONFIDENCE).alias("confidence"))

    def relations(self, chunks: DataFrame, cues=None, text: str = "text") -> DataFrame:
        """(tenant, artifact, chunk, subject, predicate, object, confidence) by cue patterns.

        The object is the first phrase that the cue's group holds or is held by;
        the subject is the last other entity before the cue.
        """
        cues = fv.RELATION_CUES if cues is None else cues
        patterns = [re.compile(p) for p, _ in cues]

        def of(block):
            @F.arrow_udf(CUES)
            def found(texts: pa.Array) -> pa.Array:
                automaton, out = _automaton(block.value), []
                for t in texts:
                    low, row = (t.as_py() or "").lower(), []
                    for k, pattern in enumerate(patterns):
                        for m in pattern.finditer(low):
                            named = automaton.named_by((m.group(1) or "").strip(" "))
                            if named:
                                row.append({"cue": k, "start": m.start(), "priority": named[0], "object": named[1]})
                    out.append(row)
                return pa.array(out, pa.list_(pa.struct([("cue", pa.int32()), ("start", pa.int32()), ("priority", pa.int32()), ("object", pa.string())])))

            return found(col(text))

        rows = chunks.select("tenant_id", "artifact_id", "chunk_id", self.settled(text).alias("ents"), F.concat(*[of(b) for b in self.blocks]).alias("cues"))
        # of several blocks' objects for one cue the first in the lexicon counts
        first = "filter(cues, c -> NOT exists(cues, o -> o.cue = c.cue AND o.start = c.start AND o.priority < c.priority))"
        rows = rows.select("tenant_id", "artifact_id", "chunk_id", "ents", F.explode(F.expr(first)).alias("c"))
        before = F.expr("filter(ents, x -> x.start < c.start AND x.name <> c.object)")
        subject = F.try_element_at(before, F.lit(-1))["name"]
        predicate = F.element_at(F.array(*[F.lit(p) for _, p in cues]), F.col("c.cue") + 1)
        said = rows.select("tenant_id", "artifact_id", "chunk_id", subject.alias("subject"), predicate.alias("predicate"), F.col("c.object").alias("object"))
        return said.filter("subject IS NOT NULL").withColumn("confidence", F.lit(fv.RELATION_CONFIDENCE))
