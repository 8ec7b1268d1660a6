"""Vector codes, fill-in-the-middle and byte-level BPE against plain versions."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import frames

pytest.importorskip("lodestone.llm.registry")
import public_tokenizers  # noqa: E402
import tiktoken  # noqa: E402

from lodestone.llm import byte_bpe, fill_in_middle, vector_codes  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def vectors(spark, rows, partitions=3):
    schema = "vec_id long, embedding array<float>, label int, state string, part int, n int, total string, code string"
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], schema).repartition(partitions)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Full searches in Python integers: {(id, vector): (code, error)} and the codebooks' text."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    whole = [[math.floor(4096 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))
    whole = [v + [0] * (size - len(v)) for v in whole]
    w = size // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in whole]
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for t in range(rounds + 1):
        near = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if t < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [c[p] for c, n in zip(cut, near) if n[p][1] == e]
                    if own:
                        books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [(i, "".join(f"{n[p][1]:02x}" for p in range(parts)), sum(d for d, _ in n), label) for (i, _, label), n in zip(kept, near)]
    total = {}
    for _, _, error, label in codes:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in codes), key=repr)


def random_vectors(n, seed, size=16, ids=None):
    draw = random.Random(seed)
    centres = [[draw.uniform(-1, 1) for _ in range(size)] for _ in range(7)]
    rows = []
    for k in range(n):
        v = [x + draw.gauss(0, 0.2) for x in draw.choice(centres)]
        rows.append((ids[k] if ids else k, v, draw.choice([None, 0, 1, 2])))
    return rows


AWKWARD = [
    (900, None, 1),
    (901, [0.1] * 15 + [None], 1),
    (902, [0.1] * 15 + [float("nan")], 1),
    (903, [0.1] * 15 + [float("-inf")], None),
    (904, [0.5] * 11, 2),
    (905, [], None),
    (None, [0.25] * 16, 0),
    (None, [0.25] * 16, 0),
    (3, [-0.75] * 16, 1),
    (3, [-0.75] * 16, 1),
]


@pytest.mark.parametrize("rows", [random_vectors(400, 1) + AWKWARD, random_vectors(5, 2), [(k, [0.5] * 16, None) for k in range(40)], AWKWARD[:4], []])
def test_codes_are_those_of_full_searches(spark, rows):
    got = sorted((tuple(r) for r in vector_codes.digests(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_of_vectors_of_another_length_and_of_no_exact_parts(spark):
    rows = random_vectors(120, 4, size=13)
    got = sorted((tuple(r) for r in vector_codes.digests(vectors(spark, rows)).collect()), key=repr)
    assert got == plain_codes(rows)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="would leave 64 bits"):
        vector_codes.digests(vectors(spark, [(1, [3e5] * 16, 1), (2, [0.0] * 16, 1)])).collect()


def test_bounds_decide_without_changing_the_search():
    """Each round equals the full search, ties included, and later rounds rescan less."""
    draw = np.random.default_rng(3)
    cut = draw.integers(-300, 300, (2000, 4, 3))
    cut[:1000] = cut[1000:]
    history, state, rescans = [cut[:8].transpose(1, 0, 2).copy()], None, []
    for _ in range(9):
        search = vector_codes.Search(history)
        state = search.assign(cut, search.start(cut) if state is None else state)
        full = ((cut[:, :, None, :] - search.book[None]) ** 2).sum(-1).argmin(-1)
        assert (full == state["entry"]).all()
        rescans.append(search.rescans)
        book = search.book.copy()
        for p in range(4):
            for e in range(8):
                if (full[:, p] == e).any():
                    book[p, e] = cut[full[:, p] == e, p].sum(0) // (full[:, p] == e).sum()
        history.append(book)
    assert rescans[0] == 8000 and rescans[-1] < rescans[0] / 2


def test_net_displacement_forgives_a_return():
    """An entry that goes away and comes back costs a bound nothing: only a net move counts."""
    home = np.array([[[0, 0], [1000, 0]]])
    away = home + np.array([0, 400])
    search = vector_codes.Search([home, away, home])
    assert search.moved[0].max() == 0 and search.moved[1].max() >= 400
    points = np.array([[[450, 0]], [[100, 0]]])
    first = vector_codes.Search([home])
    state = first.assign(points, first.start(points))
    assert (search.assign(points, state) == state).all() and search.rescans == 0


def h(key, k):
    return int(hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def plain_fill(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    a, b = sorted((h(key, 0) % (n + 1), h(key, 1) % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h(key, 2) % 100 >= 90:
        return key, text, n, "plain", None, None, text
    if h(key, 3) % 100 < 20:
        return key, text, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, text, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


MARKED = [(100, "a <P> mark"), (101, "<S>"), (102, "x<M"), (103, "<<P<S <M>>"), (104, "P>S>M><<"), (105, "𝒳 é\r\n\x00 日本 a1b"), (106, "\n" * 3000), (107, "ab " * 200_000)]
MARKED += [(k, "<" * (k % 5) + "S> one <P two M> three <" + ">" * (k % 3)) for k in range(200, 300)]


def test_fill_in_middle_is_the_plain_cut_and_can_be_undone(spark):
    docs = frames.frame(spark, frames.TEXTS + [(k, t, "en", "s") for k, t in MARKED])
    made = fill_in_middle.transform(docs)
    rows = made.select("*", fill_in_middle.restored(made.output, made.form).alias("again")).collect()
    assert all(r.again == r.text for r in rows)
    assert sorted((tuple(r)[:-1] for r in rows), key=repr) == sorted((plain_fill(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert {"plain", "psm", "spm"} == {r.form for r in rows}


def test_fill_in_middle_digests_and_empty_table(spark):
    docs = frames.frame(spark, frames.TEXTS)
    assert fill_in_middle.digests(docs.limit(0)).collect() == []
    for r in fill_in_middle.digests(docs.filter("doc_id = 7")).collect():
        want = plain_fill(7, frames.LONG)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[2:6]
        assert r.output_sha256 == frames.sha(want[6]) and r.restored_sha256 == frames.sha(frames.LONG)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["a" * 5000, "ab" * 6000, " " * 4000 + "x", "é" * 3000, "\n\n \t x's don't 12345 <|endoftext|> !?…", "\x00\x01", "日本語のテキスト", "𝒳𝒴👩‍👩‍👧"]


def test_tokens_are_those_of_the_library(spark, library):
    draw = random.Random(5)
    mixed = ["".join(draw.choice("abcdeéß ö1 2\n\t日𝒳'sT!?eeeetttaaa") for _ in range(draw.randrange(300))) for _ in range(300)]
    docs = frames.frame(spark, frames.TEXTS + [(1000 + k, t, "en", "s") for k, t in enumerate(PIECES + mixed)])
    tokenizer = byte_bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    rows = tokenizer.round_trip(docs.withColumnRenamed("key", "ids")).collect()
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((r.doc_id or -1, library.encode_ordinary(r.text or "")) for r in docs.collect())
    assert docs.select("doc_id", tokenizer.encode(F.coalesce("text", F.lit(""))).alias("ids")).exceptAll(tokenizer.round_trip(docs).drop("data")).isEmpty()
    for r in byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == frames.sha(" ".join(map(str, ids))) and r.decoded_sha256 == frames.sha(r.text or "")


def test_ids_do_not_depend_on_what_is_remembered(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    codec = byte_bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    for text in PIECES + [frames.LONG]:
        assert list(codec.encode(text)) == library.encode_ordinary(text)
        assert len(codec) <= 3


def test_decoding_of_null_unknown_and_empty(spark):
    tokenizer = byte_bpe.Tokenizer(spark, RANKS, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    got = {r.k: r.d for r in rows.select("k", tokenizer.decode(rows.ids).alias("d")).collect()}
    assert got[1] is None and got[2] == b"" and len(got[3]) == 2
    with pytest.raises(Exception, match="KeyError"):
        rows.select(tokenizer.decode(F.array(F.lit(99_999_999)))).collect()
    assert byte_bpe.digests(frames.frame(spark).limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
