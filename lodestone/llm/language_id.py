"""Language identification by Bayesian fusion of four kinds of evidence.

* text: character-trigram likelihoods, tempered by ``TEXT_WEIGHT``;
* declared markup language: right with probability ``DECLARED_RIGHT``;
* address suffix and host: a prior per host, smoothed towards its domain, that
  towards its suffix, that towards the whole table.  The counts are sums of the
  rows' own posteriors from text and declaration, over all rows, and each row
  takes its own share out before it asks.

``und`` (no language) competes with a flat likelihood per letter, so symbols,
random letters and unknown scripts lose to it; a row is kept unless it wins.

Labels are counted over all rows and every label is a language, however rare.
The trigram model is fitted on about ``ROWS_PER_LABEL`` rows of each label (all
of them where there are fewer), whole texts, chosen by a hash of the id;
everything else covers all rows.  Letters form a fixed alphabet of 128 classes:
each letter of ``LETTERS`` is one, and those of other scripts share 64 (40 for
alphabets, dealt by code point, and fewer for kana, hangul and ideographs, so
that a language of many signs has still less than ``FLAT`` to choose from).  The
model holds a number per language for each trigram that was seen in any, and
128^2 numbers for what was not.

Null or empty text has no text evidence and is ``und``, as is a table without
any label.  A null host shares one host; a null or unknown declaration says
nothing.  Rows are never merged; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import checked_broadcast, stored

ROWS_PER_LABEL = 1_000
TEXT_WEIGHT = 0.3
DECLARED_RIGHT = 0.9
PRIOR_ROWS = 50.0
UND_PRIOR = 1e-3
SMOOTHING = 0.05
FLAT = 1 / 32

# The letters told apart, and the main language of country suffixes.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüßýÿ"
SUFFIX_LANGUAGE = {
    "at": "de", "ar": "es", "au": "en", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr",
    "ie": "en", "it": "it", "mx": "es", "nl": "nl", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "uk": "en",
}

SIDE = 128
SYMBOL = 63
# class numbers: the first and how many, and the code points of each kind of letter beyond LETTERS
SCRIPTS = (
    (104, 8, ((0x3040, 0x3100), (0x31F0, 0x3200))),
    (112, 4, ((0x1100, 0x1200), (0x3130, 0x3190), (0xAC00, 0xD7B0))),
    (116, 12, ((0x2E80, 0x3000), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000))),
)
_CODE = np.arange(0x110000)
_CLASS = (64 + (_CODE * 7 + (_CODE >> 7) * 13) % 40).astype(np.uint8)
for _first, _many, _spans in SCRIPTS:
    for _from, _to in _spans:
        _CLASS[_from:_to] = _first + _CODE[_from:_to] % _many
for _from, _to in ((0x2070, 0x2C00), (0xD800, 0xF900), (0x1F000, 0x20000), (0x32000, 0x110000)):
    _CLASS[_from:_to] = SYMBOL
for _from, _to in ((0, 0x250), (0x2000, 0x2070), (0x3000, 0x3040)):
    _CLASS[_from:_to] = 0
for _i, _c in enumerate(LETTERS):
    _CLASS[ord(_c)] = _i + 1
del _CODE
_PIECE = 1 << 20


class Model(NamedTuple):
    """log P(letter | two letters before): column of each trigram (-1: seen in no language), and arrays (language, number)."""

    column: np.ndarray
    seen: np.ndarray
    context: np.ndarray
    pair: np.ndarray

    def total(self, grams: np.ndarray) -> np.ndarray:
        """Summed over the trigrams, per language."""
        out, step = np.zeros(len(self.seen)), max(1024, (4 << 20) // max(1, len(self.seen)))
        for at in range(0, len(grams), step):
            piece = grams[at : at + step]
            column = self.column[piece]
            new = piece[column < 0]
            if len(new):
                column = column[column >= 0]
                out += self.context[:, new // SIDE].sum(axis=1, dtype=np.float64) + self.pair[:, new % SIDE**2].sum(axis=1, dtype=np.float64)
            out += self.seen[:, column].sum(axis=1, dtype=np.float64)
        return out


def trigrams(text: str):
    """Trigram numbers of a text, in pieces; runs of non-letters count as one space."""
    for at in range(0, len(text), _PIECE):
        piece = text[max(0, at - 2) : at + _PIECE].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        kind = _CLASS[code].astype(np.int64)
        kind = np.concatenate(([0], kind, [0]))
        kind = kind[(kind != 0) | np.concatenate(([True], kind[:-1] != 0))]
        if len(kind) >= 3:
            yield (kind[:-2] * SIDE + kind[1:-1]) * SIDE + kind[2:]


def gram_counts(rows: DataFrame) -> DataFrame:
    """label, gram, n summed over rows of (label, text)."""

    def count(batches):
        held: dict[str, list] = {}
        waiting = 0

        def tell():
            for label, grams in held.items():
                at, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(n)], names=["label", "gram", "n"])
            held.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for grams in trigrams(text.as_py() or ""):
                    held.setdefault(label, []).append(grams)
                    waiting += len(grams)
                if waiting > _PIECE:
                    yield from tell()
                    waiting = 0
        yield from tell()

    return rows.select("label", "text").mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> tuple[list[str], Model]:
    """Languages, and the trigram model of each."""
    labelled = rows.filter("label IS NOT NULL AND label <> ''")
    labels = stored(labelled.groupBy("label").agg(F.count("*").alias("rows")))
    names = sorted(r.label for r in labels.select("label").collect())
    share = F.lit(rows_per_label * 1e6) / F.col("rows")
    sample = labelled.join(checked_broadcast(labels, 128), "label").filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share)
    counts = gram_counts(sample).toPandas()
    grams = np.unique(counts["gram"].to_numpy(np.int64))
    column = np.full(SIDE**3, -1, np.int32)
    column[grams] = np.arange(len(grams))
    seen = np.zeros((len(names), len(grams)), np.float32)
    context, pair = (np.zeros((len(names), SIDE**2), np.float32) for _ in range(2))
    for k, name in enumerate(names):
        own = counts[counts["label"] == name]
        at, n = own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)
        last = (np.bincount(at % SIDE, n, SIDE) + SMOOTHING) / (n.sum() + SMOOTHING * SIDE)
        two = np.bincount(at % SIDE**2, n, SIDE**2).reshape(SIDE, SIDE)
        two = ((two + 2.0 * last) / (two.sum(axis=1, keepdims=True) + 2.0)).ravel()
        before = np.bincount(at // SIDE, n, SIDE**2) + 2.0
        three = 2.0 * two[grams % SIDE**2]
        three[column[at]] += n
        seen[k], context[k], pair[k] = np.log(three / before[grams // SIDE]), np.log(2.0 / before), np.log(two)
    return names, Model(column, seen, context, pair)


def declared_language(html):
    """The two-letter language that a page's markup declares, else null."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", 1))


def identify(rows: DataFrame, names: list[str], model: Model) -> DataFrame:
    """(other columns), lang, confidence, kept of each row of (…, text, declared, host).

    Other columns are carried through, whatever their names; those named lang,
    confidence or kept are replaced.
    """
    spark = rows.sparkSession
    # carried as one column: their names meet none of those used here
    keys = F.struct(*[c for c in rows.columns if c not in ("text", "declared", "host", "lang", "confidence", "kept")]).alias("__row")
    size = len(names)
    shared = spark.sparkContext.broadcast(tuple(model))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def likelihoods(texts: pd.Series) -> pd.Series:
        held, flat, out = Model(*shared.value), np.log(FLAT), []
        for text in texts:
            total = np.zeros(size + 1)
            for grams in trigrams(text):
                total[:size] += held.total(grams)
                total[size] += len(grams) * flat
            out.append(total)
        return pd.Series(out)

    declared = F.substring_index(F.lower(F.trim("declared")), "-", 1)
    host = F.lower(F.coalesce("host", F.lit("")))
    seen = stored(
        rows.select(
            keys,
            likelihoods(F.coalesce("text", F.lit(""))).alias("ll"),
            declared.alias("declared"),
            F.xxhash64(host).alias("host"),
            F.xxhash64(F.lit("d"), F.substring_index(host, ".", -2)).alias("domain"),
            F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1)).otherwise("").alias("suffix"),
        )
    )
    if not size:
        return seen.select("__row.*", F.lit("und").alias("lang"), F.lit(1.0).alias("confidence"), F.lit(False).alias("kept"))
    known = F.array(*[F.lit(n) for n in names])
    says = F.transform(known, lambda n: F.when(F.col("declared") == n, F.lit(DECLARED_RIGHT)).otherwise((1 - DECLARED_RIGHT) / max(1, size - 1)))
    says = F.when(F.array_contains(known, F.col("declared")), says).otherwise(F.transform(known, lambda n: F.lit(1.0)))
    own = F.zip_with(F.slice("ll", 1, size), says, lambda a, b: a * TEXT_WEIGHT + F.log(b))
    top = F.array_max("own")
    weight = F.transform("own", lambda v: F.exp(v - F.col("top")))
    seen = (
        seen.withColumn("says", says)
        .withColumn("own", own)
        .withColumn("top", top)
        .withColumn("weight", weight)
        .withColumn("total", F.aggregate("weight", F.lit(0.0), lambda a, v: a + v))
        .withColumn("share", F.transform("weight", lambda v: v / F.col("total")))
    )
    sums = [F.sum(F.element_at("share", k + 1)).alias(f"s{k}") for k in range(size)]

    def level(by: list[str], name: str) -> DataFrame:
        grouped = seen.groupBy(*by).agg(*sums, F.count("*").alias("n"))
        return grouped.select(*by, F.array(*[f"s{k}" for k in range(size)]).alias(f"{name}_sum"), F.col("n").alias(f"{name}_n"))

    everything = [F.sum(F.col(f"host_sum")[k]).alias(f"s{k}") for k in range(size)]
    hosts = stored(level(["host", "domain", "suffix"], "host"))

    def roll(by: list[str], name: str) -> DataFrame:
        up = hosts.groupBy(*by).agg(*everything, F.sum("host_n").alias("n"))
        return up.select(*by, F.array(*[f"s{k}" for k in range(size)]).alias(f"{name}_sum"), F.col("n").alias(f"{name}_n"))

    total = roll([], "all").first()
    base = [(s + 1.0) / ((total.all_n or 0) + size) for s in (total.all_sum if total.all_n else [0.0] * size)]
    national = F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv])[F.col("suffix")]
    start = F.array(*[F.when(national == n, F.lit(0.5) + F.lit(b / 2)).when(F.array_contains(known, national), F.lit(b / 2)).otherwise(F.lit(b)) for n, b in zip(names, base, strict=True)])

    def smooth(counted, n, parent):
        """Counts without the row's own share, smoothed towards the parent prior."""
        less = F.zip_with(counted, "share", lambda c, s: F.greatest(c - s, F.lit(0.0)))
        return F.zip_with(less, parent, lambda c, p: (c + p * PRIOR_ROWS) / (n - 1 + PRIOR_ROWS))

    width = 64 + 8 * size
    levels = hosts.join(roll(["domain", "suffix"], "domain"), ["domain", "suffix"]).join(roll(["suffix"], "suffix"), "suffix")
    levels = stored(levels.select("host", "domain", "suffix", *[f"{x}_{y}" for x in ("host", "domain", "suffix") for y in ("sum", "n")]))
    met = seen.join(checked_broadcast(levels, 3 * width), ["host", "domain", "suffix"])
    met = met.withColumn("p1", start).withColumn("p2", smooth("suffix_sum", F.col("suffix_n"), "p1"))
    met = met.withColumn("p3", smooth("domain_sum", F.col("domain_n"), "p2")).withColumn("prior", smooth("host_sum", F.col("host_n"), "p3"))
    # flat text likelihood for und; it has neither a declaration nor a host prior
    und = F.element_at("ll", size + 1) * TEXT_WEIGHT + F.log(F.lit(UND_PRIOR))
    score = F.concat(F.zip_with("own", "prior", lambda o, p: o + F.log(p)), F.array(und))
    best = F.array_position("score", F.array_max("score")).cast("int")
    norm = F.aggregate(F.transform("score", lambda v: F.exp(v - F.array_max("score"))), F.lit(0.0), lambda a, v: a + v)
    silent = F.element_at("ll", size + 1) == 0.0
    lang = F.when(silent, F.lit("und")).otherwise(F.element_at(F.array(*[F.lit(n) for n in (*names, "und")]), F.col("best")))
    return (
        met.withColumn("score", score)
        .withColumn("best", best)
        .select("__row", lang.alias("lang"), F.when(silent, 1.0).otherwise(1.0 / norm).alias("confidence"))
        .select("__row.*", "lang", "confidence", (F.col("lang") != "und").alias("kept"))
    )
