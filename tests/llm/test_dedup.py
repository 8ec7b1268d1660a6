"""Exact, SimHash and substring deduplication against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import exact_dedup, simhash_dedup, suffix_dedup
from tests.llm import frames as X


def test_filter_has_no_false_negative_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        made = exact_dedup.build_filter(keys)
        assert exact_dedup.may_hold(keys, *made).all()
        others = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64) | np.uint64(1 << 63)
        assert exact_dedup.may_hold(others, *made).mean() < 0.02
        if n > 5000:
            assert len(made[3]) < 1.5 * n


@pytest.mark.parametrize("arrived", ["doc_id % 2 = 1", "true", "false"])
def test_exact(spark, arrived):
    rows = exact_dedup.dedup(X.frame(spark), F.expr(arrived)).collect()
    by_text = {}
    for doc, text, *_ in X.TEXTS:
        by_text.setdefault(X.sha(X.fold(text)), []).append(doc)
    assert len(rows) == len(X.TEXTS)
    kept = {}
    for r in rows:
        held = by_text[r.text_sha256]
        top = max((d for d in held if d is not None), default=None)
        assert (r.keep_id, r.group_size) == (top, len(held))
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("arrived", ["doc_id % 2 = 1", "doc_id > 2", "doc_id < 3"])
def test_large_batches_are_dealt_over_a_shard(spark, monkeypatch, arrived):
    """Small shards and parts, either side the larger: the decisions stay."""
    want = sorted(map(str, exact_dedup.dedup(X.frame(spark), F.expr(arrived)).collect()))
    monkeypatch.setattr(exact_dedup, "KEYS_PER_SHARD", 2)
    assert sorted(map(str, exact_dedup.dedup(X.frame(spark), F.expr(arrived)).collect())) == want


def test_exact_bytes_decide_when_digests_meet(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    pairs = spark.createDataFrame([(X.sha("a"), 1, 2)], "text_sha256 string, batch_id long, held_id long")
    assert exact_dedup.confirmed(docs, pairs).collect() == [(X.sha("a"), True)]


def test_keep_one_keeps_one_row(spark):
    docs = X.frame(spark)
    kept = exact_dedup.keep_one(docs, exact_dedup.dedup(docs, F.lit(True)))
    assert kept.columns == docs.columns
    texts = [X.fold(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({X.fold(t) for _, t, *_ in X.TEXTS})


def test_simhash(spark):
    got = {}
    rows = simhash_dedup.dedup(X.frame(spark)).collect()
    assert len(rows) == len(X.TEXTS)
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    values = {d: X.simhash(t) for d, t, *_ in X.TEXTS if d is not None}
    roots = X.groups(values)
    for doc, value in values.items():
        assert got[doc] == {(f"{value:016x}", roots[doc])}
    assert got[None] == {(f"{values[1]:016x}", 1), ("0" * 16, 4)}


def test_simhash_crowded_and_split_shards_lose_no_link(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = set()
    for _ in range(600):
        v = rng.choice(centres) if rng.random() < 0.6 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            v ^= 1 << b
        values.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    want = X.groups(dict(zip(range(len(values)), sorted(values))))
    order = sorted(values)
    for limit in (simhash_dedup.SHARD_ROWS, 20):
        nodes = spark.createDataFrame(signed, "fp long")
        roots = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash_dedup.components(simhash_dedup.links(nodes, shard_rows=limit)).collect()}
        sets = {}
        for v in order:
            sets.setdefault(roots.get(v, v), set()).add(v)
        wanted = {}
        for k, root in want.items():
            wanted.setdefault(root, set()).add(order[k])
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, wanted.values()))


def test_more_parts_are_as_exact():
    rng = np.random.default_rng(5)
    value = np.unique(rng.integers(0, 1 << 40, 300, dtype=np.int64).view(np.uint64) & np.uint64(0xFFFF))
    for parts in (5, 6, 7):
        found = set()
        for k, m in enumerate(simhash_dedup._masks(parts, 4)):
            shard = (value & np.uint64(m & (1 << 64) - 1)).view(np.int64) * 100 + k
            forest = simhash_dedup.Forest(shard, value)
            for q, at in forest.near(np.arange(len(value)), 4):
                found |= set(zip(forest.value[q].tolist(), forest.value[at].tolist()))
        assert found == {(int(a), int(b)) for a in value for b in value if a != b and int(a ^ b).bit_count() <= 4}


def test_substrings_on_awkward_rows(spark):
    rows = suffix_dedup.dedup(X.frame(spark)).collect()
    assert len(rows) == len(X.TEXTS)
    want = X.cut_repeats([(-1 if d is None else d, t) for d, t, *_ in dict.fromkeys(X.TEXTS) if not (d is None and t is None)])
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r)[1:] == want[r.doc_id]
    assert sorted(tuple(r)[1:3] for r in rows if r.doc_id is None) == sorted([(0, 0), want[-1][:2]])


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "cé", "d", "efg", "hi", "jkl", " "]

    def words(n):
        return " ".join(rng.choice(alphabet) for _ in range(n))

    lines = [words(rng.randint(10, 120)) for _ in range(8)]
    docs = []
    for i in range(80):
        text = " ".join(rng.choice(lines)[rng.randint(0, 40) :] if rng.random() < 0.6 else words(rng.randint(1, 60)) for _ in range(rng.randint(0, 5)))
        docs.append((i, rng.choice([text] * 8 + ["a" * rng.randint(50, 700), "xyz " * rng.randint(10, 200)])))
    docs.append((99, "q" * 300_000))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == X.cut_repeats(docs)


def test_loser_tree_merges_and_tells_prefixes():
    rng = random.Random(7)
    for count in (1, 2, 3, 7):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 30))) for _ in range(count)]
        blobs = [suffix_dedup.encoded_run([(k, b"", 0, 0, 0) for k in run]) for run in runs]
        out = list(suffix_dedup.merged([suffix_dedup.decoded_run(b) for b in blobs]))
        keys = [r[0] for _, r in out]
        assert keys == sorted(k for run in runs for k in run)
        for (shared, record), before in zip(out[1:], keys, strict=False):
            assert shared == suffix_dedup.shared_prefix(before, record[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], X.frame(spark).schema)
    assert exact_dedup.dedup(none, F.lit(True)).collect() == []
    assert simhash_dedup.dedup(none).collect() == []
    assert suffix_dedup.dedup(none).collect() == []
    assert isinstance(simhash_dedup.dedup(none).schema["component_id"].dataType, T.LongType)


def test_family_in_chunks_is_settled_as_whole():
    rng = random.Random(8)
    passage = bytes(rng.choices(b"abcdefgh", k=100))
    family = []
    for doc in range(300):
        before, after = (bytes(rng.choices(b"xy", k=rng.choice([0, 3, 60]))) for _ in range(2))
        left, right = (before + passage[:30])[-40:], (passage[30:] + after)[:100]
        family.append((bytes(8) + right, left, doc % 250, 0, 1000 + len(left)))
    family.sort()
    whole = {(d, w) for d, _, a, b in suffix_dedup.family_repeats(family) for w in range(a, b + 1)}
    standing, found = [], set()
    for at in range(0, len(family), 7):
        found |= {(d, w) for d, _, a, b in suffix_dedup.family_repeats(family[at : at + 7], standing) for w in range(a, b + 1)}
    rows = suffix_dedup._window_rows(suffix_dedup._packed_windows(standing)).to_pylist()
    least = {}
    for r in rows:
        least[r["digest"]] = min(least.get(r["digest"], (1 << 40, 0)), (r["doc"], r["first"]))
    found |= {(r["doc"], r["first"]) for r in rows if (r["doc"], r["first"]) != least[r["digest"]]}
    assert whole and found == whole


def test_substrings_of_passages_in_many_surroundings(spark):
    rng = random.Random(9)
    passages = [" ".join(f"{k}w{rng.randrange(1000)}" for _ in range(40)) for k in range(4)]
    docs = []
    for k, often in enumerate((3000, 500, 450, 30)):
        for _ in range(often):
            ends = [" ".join(f"{rng.randrange(50)}" for _ in range(rng.randint(0, 30))) for _ in range(2)]
            docs.append((len(docs), f"{ends[0]} {passages[k]} {ends[1]}"))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == X.cut_repeats(docs)
