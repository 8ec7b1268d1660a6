"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from one pattern per kind, leftmost and non-overlapping; matches
that fail the kind's test are dropped.  The field adds spans around them: a text
is cut at white space, runs of pieces that hold a digit, an @ or a spelled-out
"at" or "dot" are regions, and inside a region every run of up to ``MAX_PIECES``
pieces and ``MAX_CHARS`` characters is a candidate for each kind.  Features see
the whole candidate (digits, separators, checksum, address parts, the word
before), and dynamic programming over these bounded segments picks boundaries
and kinds together.  Outside regions every piece is no entity, so leaving them
out changes nothing.  Spans that touch a base span are not added.

The weights are fitted by maximum likelihood on at most ``TRAIN_REGIONS`` regions
(of at most ``TRAIN_PIECES`` pieces) from about ``TRAIN_ROWS`` rows chosen by a
hash of the id, labelled by the base patterns.

Null and empty texts have no spans; positions count code points and whole texts
are read; repeated rows give repeated results; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
MAX_PIECES = 6
MAX_CHARS = 256
TRAIN_ROWS = 4_000
TRAIN_REGIONS = 600
TRAIN_PIECES = 30
EPOCHS = 6
RATE, DECAY = 0.2, 1e-3

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"@|[0-9]|[\[({](?:at|dot)[\])}]", re.IGNORECASE)
_PIECE = re.compile(r"\S+")
_CUES = ("mail", "phone", "tel", "call", "card", "visa", "ip", "host", "server", "address", "contact")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str):
    """Each @ takes the longest local part left of it that no earlier match holds."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", free)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in KINDS, in order of start."""
    has_digits = _DIGIT.search(text) is not None
    out: list[list[tuple[int, int]]] = [list(emails(text)), [], [], []]
    if has_digits:
        out[1] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out[2].append(m.span())
        out[3] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of pieces around triggers, with one piece more on each side."""
    if not _TRIGGER.search(text):
        return []
    pieces = [m.span() for m in _PIECE.finditer(text)]
    out: list[list[tuple[int, int]]] = []
    last = -3
    for k, (a, b) in enumerate(pieces):
        if _TRIGGER.search(text, a, b):
            if k - last > 2:
                out.append(pieces[max(0, k - 1) : k])
            out[-1].append(pieces[k])
            last = k
        elif k == last + 1:
            out[-1].append(pieces[k])
    return out


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A span without quotes and sentence marks at its ends, or an unmatched bracket."""
    while a < b and text[a] in "\"'<,;:":
        a += 1
    while a < b and text[b - 1] in "\"'>.,;:!?":
        b -= 1
    if a < b and text[a] == "(" and ")" not in text[a:b]:
        a += 1
    if a < b and text[b - 1] == ")" and "(" not in text[a:b]:
        b -= 1
    return a, b


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


_NAMES = [
    *(f"pieces{i}" for i in range(1, MAX_PIECES + 1)), *(f"digits{i}" for i in range(8)), *(f"dots{i}" for i in range(5)),
    "at", "at_inside", "domain", "spelled_at", "spelled_dot", "plus", "octets", "luhn", "letters", "mostly_letters", "dial_only",
    "card_only", "groups_of_four", "starts_digit", "ends_digit", "cue", "long",
]
_AT = {n: i for i, n in enumerate(_NAMES)}
FEATURES = len(_NAMES)


def features(span: str, pieces: int, before: str) -> list[int]:
    """Indices of the features that hold for a whole candidate span."""
    digits = "".join(_DIGIT.findall(span))
    letters = sum(c.isalpha() for c in span)
    low = span.lower()
    on = [f"pieces{pieces}", f"digits{_bucket(len(digits), (1, 4, 7, 8, 11, 16, 20))}", f"dots{min(span.count('.'), 4)}"]
    if "@" in span:
        on.append("at")
        local, _, domain = span.partition("@")
        if local and domain:
            on.append("at_inside")
        if re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", domain):
            on.append("domain")
    if re.search(r"[\[({]at[\])}]", low):
        on.append("spelled_at")
    if re.search(r"[\[({]dot[\])}]", low):
        on.append("spelled_dot")
    if span.startswith("+"):
        on.append("plus")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts):
        on.append("octets")
    if 13 <= len(digits) <= 19 and luhn(digits):
        on.append("luhn")
    if letters:
        on.append("letters")
    if letters * 2 > len(span):
        on.append("mostly_letters")
    if re.fullmatch(r"[+ ().0-9-]+", span):
        on.append("dial_only")
    if re.fullmatch(r"[ 0-9-]+", span):
        on.append("card_only")
    if re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3,}", span):
        on.append("groups_of_four")
    if span[:1].isdigit():
        on.append("starts_digit")
    if span[-1:].isdigit():
        on.append("ends_digit")
    if any(c in before for c in _CUES):
        on.append("cue")
    if len(span) > 40:
        on.append("long")
    return [_AT[n] for n in on]


def segments(text: str, region: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(first piece, past the last, start, end, features) of every candidate of a region."""
    out = []
    for i in range(len(region)):
        before = text[region[i - 1][0] : region[i - 1][1]].lower()[-20:] if i else ""
        for j in range(i + 1, min(i + MAX_PIECES, len(region)) + 1):
            a, b = trimmed(text, region[i][0], region[j - 1][1])
            if b - a > MAX_CHARS:
                break
            if b > a and _TRIGGER.search(text, a, b):
                out.append((i, j, a, b, features(text[a:b], j - i, before)))
    return out


def _scores(segs, weights: np.ndarray) -> np.ndarray:
    """Score of each candidate as each kind; the bias is the last weight."""
    return np.array([weights[:, f].sum(axis=1) + weights[:, -1] for *_, f in segs])


def decode(text: str, region: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best labelled cut of a region; no entity scores 0 a piece."""
    segs = segments(text, region)
    if not segs:
        return []
    scores = _scores(segs, weights)
    ends: dict[int, list[int]] = {}
    for k, s in enumerate(segs):
        ends.setdefault(s[1], []).append(k)
    best, back = [0.0] * (len(region) + 1), [None] * (len(region) + 1)
    for j in range(1, len(region) + 1):
        best[j] = best[j - 1]
        for k in ends.get(j, ()):
            kind = int(scores[k].argmax())
            value = best[segs[k][0]] + scores[k][kind]
            if value > best[j]:
                best[j], back[j] = value, (k, kind)
    out, j = [], len(region)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            k, kind = back[j]
            out.append((kind, segs[k][2], segs[k][3]))
            j = segs[k][0]
    return out[::-1]


def gold(text: str, region, spans) -> dict[tuple[int, int], int]:
    """The candidates of a region that are base spans, with their kind."""
    want = {s: kind for kind, found in enumerate(spans) for s in found}
    return {(i, j): want[a, b] for i, j, a, b, _ in segments(text, region) if (a, b) in want}


def fit(examples: list[tuple[str, list[list[int]]]]) -> np.ndarray:
    """Weights (kind, feature) by gradient steps on the likelihood of whole labelled regions.

    An example is a region's text and its labelled (kind, start, end) spans.
    """
    weights = np.zeros((len(KINDS), FEATURES + 1))
    weights[:, -1] = -2.0
    held = []
    for text, spans in examples:
        region = [m.span() for m in _PIECE.finditer(text)]
        segs = segments(text, region)
        if segs:
            truth = {(a, b): kind for kind, a, b in spans}
            rows = np.zeros((len(segs), FEATURES + 1))
            for k, s in enumerate(segs):
                rows[k, s[4]] = 1
                rows[k, -1] = 1
            target = np.zeros((len(segs), len(KINDS)))
            for k, s in enumerate(segs):
                if (s[2], s[3]) in truth:
                    target[k, truth[s[2], s[3]]] = 1
            held.append((len(region), segs, rows, target))
    for epoch in range(EPOCHS):
        for n, segs, rows, target in held:
            scores = rows @ weights.T
            total = np.logaddexp.reduce(scores, axis=1)
            ahead, after = np.zeros(n + 1), np.zeros(n + 1)
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for k, s in enumerate(segs):
                by_end.setdefault(s[1], []).append(k)
                by_start.setdefault(s[0], []).append(k)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segs[k][0]] + total[k] for k in by_end.get(j, ()))])
            for i in range(n - 1, -1, -1):
                after[i] = np.logaddexp.reduce([after[i + 1], *(after[segs[k][1]] + total[k] for k in by_start.get(i, ()))])
            outside = np.array([ahead[s[0]] + after[s[1]] - ahead[n] for s in segs])
            expected = np.exp(scores + outside[:, None])
            weights += RATE / (1 + epoch) * ((target - expected).T @ rows)
            weights *= 1 - DECAY / (1 + epoch)
    return weights


def training_regions(docs: DataFrame) -> list[tuple[str, list[list[int]]]]:
    """At most TRAIN_REGIONS regions of the sampled rows, in hash order, with their base spans."""
    share = TRAIN_ROWS / max(1, docs.count())
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)) if share < 1 else docs

    def cut(batches):
        for batch in batches:
            texts, spans = [], []
            for item in batch.column(0):
                text = item.as_py()
                found = base_spans(text)
                for region in regions(text):
                    lo, hi = region[0][0], region[-1][1]
                    if len(region) > TRAIN_PIECES or hi - lo > TRAIN_PIECES * MAX_CHARS:
                        continue
                    texts.append(text[lo:hi])
                    spans.append([[kind, a - lo, b - lo] for kind in range(len(KINDS)) for a, b in found[kind] if lo <= a and b <= hi])
            if texts:
                kinds = pa.list_(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(spans, kinds)], names=["text", "spans"])

    rows = sample.select(text_or_empty().alias("text")).mapInArrow(cut, "text string, spans array<array<long>>")
    # half of the sample holds spans, so that each kind is seen
    parts = [rows.filter(F.size("spans") > 0), rows.filter(F.size("spans") == 0)]
    picked = [p.orderBy(F.xxhash64("text"), "text").limit(TRAIN_REGIONS // 2).collect() for p in parts]
    mixed = [r for pair in zip(*[p + [None] * (TRAIN_REGIONS // 2 - len(p)) for p in picked], strict=True) for r in pair if r]
    return [(r.text, [list(s) for s in r.spans]) for r in mixed]


def spans_of(text: str, weights: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans and all spans, each by kind and in order of start."""
    base = base_spans(text)
    every = [list(s) for s in base]
    held = sorted(s for found in base for s in found)
    starts = np.array([a for a, _ in held], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in held], np.int64)) if held else starts
    for region in regions(text):
        for kind, a, b in decode(text, region, weights):
            k = int(np.searchsorted(starts, b))
            if k == 0 or reach[k - 1] <= a:
                every[kind].append((a, b))
    return base, [sorted(s) for s in every]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


def find(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, counts of base spans, their digest, and all spans, of every row."""
    weights = fit(training_regions(docs)) if weights is None else weights
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def over(batches):
        held = shared.value
        for batch in batches:
            counts, digests, spans = [], [], []
            for item in batch.column(1):
                base, every = spans_of(item.as_py(), held)
                counts.append([len(s) for s in base])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            if spans:
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests), pa.array(spans)], names=names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(over, schema)
