"""The phrase automaton against the lexicon expression, in one block and in many."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators.phrases import Phrases

CHUNKS = "tenant_id string, artifact_id string, chunk_id string, text string"
LEXICON = [("red fox", "a"), ("fox", "b"), ("fox den", "c"), ("x_1", "d"), ("été", "e"), ("the red", "f"), ("fox", "g"), ("over", "h")]
CUES = [(r"owned by\s+(?:the\s+)?([a-z ]+?)(?:\.|,)", "owner"), (r"ask\s+([a-z_0-9 ]+?)\.", "asks")]


def table(spark, lexicon):
    return spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(lexicon)], "name string, type string, priority int")


@pytest.mark.parametrize("block_bytes", [1, 60, 1 << 20])
def test_automaton_is_the_lexicon_expression(spark, block_bytes):
    draw = random.Random(1)
    words = ["Red", "fox", "den", "foxes", "x_1", "été", "ÉTÉ", "the", "over", "owned by the red fox.", "ask x_1.", "owned by den,", "ask overall.", "-", "_fox", "\n", "日本"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(25))) for _ in range(80)] + ["", "fox", "foxfox fox"]
    chunks = spark.createDataFrame([("t", "a", f"c{i}", t) for i, t in enumerate(texts)] + [("t", "a", "none", None)], CHUNKS)
    found = Phrases(table(spark, LEXICON), block_bytes)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(found.entities(chunks)) == rows(G.extract_entities(chunks.filter("text IS NOT NULL"), LEXICON))
    got = found.relations(chunks, CUES)
    assert rows(got) == rows(G.extract_relations(chunks.filter("text IS NOT NULL"), LEXICON, CUES)) and got.count() > 10


def test_a_hundred_thousand_overlapping_phrases(spark):
    draw = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    names = list({" ".join(draw.choices(words, k=draw.choice([1, 2, 2, 3]))) for _ in range(110_000)})[:100_000]
    chunks = spark.createDataFrame([("t", "a", f"c{i}", " ".join(draw.choices(words, k=120))) for i in range(40)], CHUNKS)
    held = {n: i for i, n in enumerate(names)}
    got = {}
    for r in Phrases(table(spark, [(n, "k") for n in names])).entities(chunks).collect():
        got.setdefault(r.chunk_id, []).append((r.start, r.name))
    for row in chunks.collect():
        ws = row.text.split(" ")
        at = [sum(len(w) + 1 for w in ws[:i]) for i in range(len(ws))]
        cands = sorted((held[n], at[i], at[i] + len(n), n) for i in range(len(ws)) for k in (1, 2, 3) if (n := " ".join(ws[i : i + k])) in held and i + k <= len(ws))
        kept = []
        for c in cands:
            if all(c[1] >= o[2] or o[1] >= c[2] for o in kept):
                kept.append(c)
        assert sorted(got.get(row.chunk_id, [])) == sorted((c[1], c[3]) for c in kept)


def test_an_empty_lexicon_finds_nothing(spark):
    chunks = spark.createDataFrame([("t", "a", "c", "text")], CHUNKS)
    empty = Phrases(table(spark, LEXICON).filter(F.lit(False)))
    assert empty.entities(chunks).isEmpty() and empty.relations(chunks, CUES).isEmpty()


def test_only_settled_places_leave_the_worker(spark):
    chunks = spark.createDataFrame([("t", "a", "c", "the red fox den")], CHUNKS)
    found = Phrases(table(spark, LEXICON), block_bytes=1).entities(chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and [r.name for r in found.collect()] == ["red fox"]


def test_phrases_of_any_signs_and_of_equal_hash(spark):
    morse = "a"
    for _ in range(11):  # 2048 letters: this and its mirror have one polynomial hash modulo 2**64, whatever the base
        morse += morse.translate(str.maketrans("ab", "ba"))
    mirror = morse.translate(str.maketrans("ab", "ba"))
    lexicon = [("c++", "a"), ("a\nb", "b"), (morse, "c"), ("+x", "d"), ("c + d", "e"), ("a", "f"), ("b", "f"), ("b!", "g")]
    draw = random.Random(3)
    texts = [" ".join(draw.choices(["c++", "C++x", "a\nb", "a", "b", "b!", "+x", "c + d", morse, mirror, "\U0001f600", "+"], k=draw.randrange(12))) for _ in range(120)]
    texts += ["a", "b", "a", "", "b", mirror, morse, "c++", "c+", "c++"]  # no phrase runs from one text into the next
    chunks = spark.createDataFrame([("t", "a", f"c{i}", t) for i, t in enumerate(texts)], CHUNKS)
    got = {}
    for r in Phrases(table(spark, lexicon), 1 << 10).entities(chunks).collect():
        got.setdefault(r.chunk_id, []).append((r.start, r.name))
    word = lambda c: c.isalnum() or c == "_"
    for i, text in enumerate(texts):
        low, kept = text.lower(), []
        for name, _ in lexicon:
            for s in range(len(low)):
                e = s + len(name)
                if low.startswith(name, s) and word(low[s]) and (s == 0 or not word(low[s - 1])) and (e == len(low) or not word(low[e])):
                    if all(s >= oe or os >= e for os, oe in kept):
                        kept.append((s, e))
        assert sorted(got.get(f"c{i}", [])) == sorted((s, low[s:e]) for s, e in kept)
