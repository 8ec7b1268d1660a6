"""Small tables with every awkward case, and plain brute-force twins of the operators."""

from __future__ import annotations

import hashlib
import re
import string
from itertools import combinations

import xxhash

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: names that operators use inside; none of them may matter
CLASHING = [
    "n", "fp", "root", "kept", "h", "size", "part", "blob", "word", "label", "host", "mark", "copies", "band", "salt",
    "shard", "key", "folded", "text_sha256", "arrived", "item", "p", "bucket", "z", "doc", "places", "route", "s", "i",
]
LONG = " ".join(f"word{i % 977} of the long text" for i in range(12_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "a"),
    (2, "THE quick brown fox jumps over the lazy dog and runs far away today", "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog and runs far away today", "en", None),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, " \t\n ", "fr", "b"),
    (7, LONG, "en", "c"),
    (8, LONG + " end", "en", "c"),
    (9, "ÉTÉ été Été à la plage avec les enfants et le chien", "fr", "c"),
    (10, "mail bob@mail.example.com or +1 (202) 555-0143, card 4111 1111 1111 1111, host 10.20.30.40 now", "en", "c"),
    (11, "Licensed under CC BY-NC 4.0. All rights reserved.", "en", "d"),
    (11, "Licensed under CC BY-NC 4.0. All rights reserved.", "en", "d"),
    (12, "one", "en", "d"),
    (13, "a" * 5000, "en", "d"),
    (14, "мы не знаем этот язык совсем никогда", None, "e"),
    (None, "The quick brown fox jumps over the lazy dog and runs far away today", None, None),
    (None, None, None, None),
]


def frame(spark, rows=TEXTS, partitions=3):
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    filled = [(*r, len(r[1]) if r[1] is not None else None, *(["clash"] * len(CLASHING))) for r in rows]
    assert len(names) == len(schema.split(", "))
    return spark.createDataFrame(filled, schema).repartition(partitions)


def fold(text):
    return (text or "").translate(FOLD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def smaller(a, b):
    """a < b with null before all ids."""
    return (a is not None, a or 0) < (b is not None, b or 0)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values: dict, radius=4):
    """Root (smallest key) of each component of values linked within the radius."""
    parent = {k: k for k in values}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(sorted(values), 2):
        if (values[a] ^ values[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in values}


def cut_repeats(docs, span=100):
    """doc -> (bytes, removed, runs, digest) by a table of every window, ids without null."""
    first, out = {}, {}
    for doc, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            window = data[p : p + span]
            if window in first and first[window] < (doc, p):
                gone[p : p + span] = b"\1" * span
            first.setdefault(window, (doc, p))
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def leaks(text, item, window=13, share=0.8):
    """Whether some aligned window of the item stands in the text, substitutions allowed."""
    words, held = (re.findall(r"\w+", (t or "").lower()) for t in (text, item))
    size, need = min(window, len(held)), share * window
    if len(held) < window:
        need = size
    return bool(held) and any(
        sum(a == b for a, b in zip(words[i : i + size], held[j : j + size])) >= need
        for i in range(len(words) - size + 1)
        for j in range(len(held) - size + 1)
    )
