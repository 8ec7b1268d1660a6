"""License scans by a positional index of rare words.

Templates are short licence notices.  A first pass counts in how many documents
each template word occurs, over all documents.  Each template is then looked up
by its rarest word places, as many as it takes that what is left weighs less than
``ENOUGH`` of it (each word weighs its inverse document frequency).  A second pass
aligns the templates with the document wherever one of these words stands, so no
alignment on which enough of a template stands is missed, whatever else the
document holds, and takes the alignments on which enough of the template does
stand.  A template counts only if its mandatory phrases stand there too.  Base
phrases are found wherever their words stand consecutively; their labels stay
whatever the templates say.

Words are runs of ASCII letters and digits and of any other characters beyond
ASCII, with A-Z lower-cased.  Null and empty texts have no words, no labels and
score 0.  Repeated rows give repeated results; an empty table gives an empty
result; only doc_id and text are read.  The template table is fixed and small,
so its index travels with the tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_or_empty

ENOUGH = 0.7
SLACK = 2

# Base phrases, and notices with the phrases that they cannot lack.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("use copy modify", "for any purpose")),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LABELS = [t[0] for t in TEMPLATES]
_WORDS = [t[1].encode().split() for t in TEMPLATES]
_KEYS = [[k.encode().split() for k in t[2]] for t in TEMPLATES]
_NEEDED = [frozenset(w for key in keys for w in key) for keys in _KEYS]
_BASE = [(p.encode().split(), label) for p, label in BASE]
VOCABULARY = frozenset(w for words in _WORDS for w in words)
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def document_frequencies(docs: DataFrame) -> DataFrame:
    """word, df of the template words over all documents."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(VOCABULARY.intersection(words_of(text.as_py())))
        words = pa.array([w.decode() for w in seen], pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array(seen.values(), pa.int64())], names=["word", "df"])

    rows = docs.select(text_or_empty().alias("text"))
    return rows.mapInArrow(count, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def phrase_starts(words: list[bytes], phrase: list[bytes], lo: int = 0, hi: int | None = None) -> list[int]:
    """All places from lo on, ending before hi, where the phrase's words stand consecutively."""
    out, n, hi = [], len(phrase), len(words) if hi is None else min(hi, len(words))
    at = max(lo, 0)
    while True:
        try:
            at = words.index(phrase[0], at, hi)
        except ValueError:
            return out
        if at + n <= hi and words[at : at + n] == phrase:
            out.append(at)
        at += 1


def anchors(idf: dict[bytes, float]) -> list[list[tuple[bytes, int]]]:
    """Per template its rarest (word, place): without any of them less than ENOUGH of the template can stand."""
    out = []
    for words in _WORDS:
        left = whole = sum(idf[w] for w in words)
        chosen = []
        for i in sorted(range(len(words)), key=lambda i: (-idf[words[i]], i)):
            if left < whole * (ENOUGH - 1e-9):
                break
            chosen.append((words[i], i))
            left -= idf[words[i]]
        out.append(chosen)
    return out


def scan(words: list[bytes], idf: dict[bytes, float], rare: list[list[tuple[bytes, int]]]) -> tuple:
    """n_words, n_base, first, last, base labels, labels, score of one document."""
    present = VOCABULARY.intersection(words)
    starts, base, labels, score = [], set(), set(), 0.0
    for phrase, label in _BASE:
        if present.issuperset(phrase) and (found := phrase_starts(words, phrase)):
            starts += found
            base.add(label)
    places: dict[bytes, list] = defaultdict(list)
    for template, needed in enumerate(_NEEDED):
        if present.issuperset(needed):
            for word, place in rare[template]:
                places[word].append((template, place))
    spots = set()
    if not places.keys().isdisjoint(present):
        for at, word in enumerate(words):
            if word in places:
                spots.update((template, at - place) for template, place in places[word])
    for template, start in spots:
        held = _WORDS[template]
        whole = sum(idf[w] for w in held)
        if _LABELS[template] in labels and score == 1.0:
            continue
        stands = sum(idf[w] for i, w in enumerate(held) if 0 <= start + i < len(words) and words[start + i] == w) / whole
        lo, hi = start - SLACK, start + len(held) + SLACK
        if stands >= ENOUGH and all(phrase_starts(words, key, lo, hi) for key in _KEYS[template]):
            labels.add(_LABELS[template])
            score = max(score, min(1.0, stands))
    if base:
        score = 1.0
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row per document: words, base phrase places, labels and score."""
    counted = {r.word.encode(): r.df for r in document_frequencies(docs).collect()}  # at most one row per template word
    total = docs.count()
    idf = {w: 1.0 + math.log((total + 1) / (counted.get(w, 0) + 1)) for w in VOCABULARY}
    rare = anchors(idf)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def over(batches):
        for batch in batches:
            rows = [scan(words_of(t.as_py()), idf, rare) for t in batch.column(1)]
            if rows:
                columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(over, SCHEMA)
