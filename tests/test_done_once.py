"""Work that several results share is done once: stems, judged process bodies, round-tripped pairs, hashed tokens."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import fulltext_tokens
from lodestone.operators import embedding as E
from lodestone.operators import inverted as I
from lodestone.operators import sparse as S
from lodestone.operators import training as TR
from lodestone.operators import versions as VR
from lodestone.session import cut_lineage


def test_tokens_are_cut_out_of_a_whole_slice_at_once(spark):
    """each text went through a pattern and each token through a Python tuple."""
    draw = random.Random(1)
    texts = [None, "", " ", "ΑΣ", "x" * 3000, *["".join(draw.choices("aZ09 éİKΣß\n\0_-$ſ١", k=draw.randrange(0, 40))) for _ in range(1500)]]
    said = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
    rows, tokens = E._tokens(texts)
    assert list(zip(rows.tolist(), tokens.to_pylist())) == [(i, t) for i, ts in enumerate(said) for t in ts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", E.hashing_vector("t").alias("v")).collect()
    for r in got:
        want = [0.0] * fv.EMBED_DIM
        for t in said[r.i]:
            digest = hashlib.md5(t.encode()).digest()
            want[int.from_bytes(digest[:4], "big") % fv.EMBED_DIM] += 1 if digest[4] & 1 else -1
        assert r.v == want
    assert len(got) == len(texts)


def test_words_are_stemmed_once_for_an_index(spark, monkeypatch, tmp_path):
    """the words of a chunk were stemmed for its length, and again for its blocks."""
    kept = {}
    monkeypatch.setattr(I.Index, "_write", lambda self, segment, docs, blocks, gone: kept.update(docs=docs))
    monkeypatch.setattr(I.Index, "_publish", lambda self, segments: None)
    texts = ["The running of the policies", "the a an", "", None, "été x1 THE", "$ -"]
    chunks = spark.createDataFrame([("t", f"c{i}", t) for i, t in enumerate(texts)], "tenant_id string, chunk_id string, text string")
    for config in ("english", "simple"):
        I.Index(spark, str(tmp_path / config), config).add(chunks)
        assert "Python" not in kept["docs"]._jdf.queryExecution().optimizedPlan().toString()
        stems = S.indexed(chunks, config).select("chunk_id", F.size(F.array_compact("terms")).cast("long").alias("n"))
        assert {r.id: r.length for r in kept["docs"].collect()} == {r.chunk_id: r.n for r in stems.collect()}
    assert chunks.select(S.n_terms(fulltext_tokens("text"), "english").alias("n")).first().n == 2


def test_bodies_are_judged_once(spark):
    """heads, versions and updates each judged all bodies again."""
    step = lambda action, actor: (1, action, actor, [("c", "q")], None)
    new = spark.createDataFrame(
        [("t", "n", "a1", "go", [step("ask the risk team", "ann")]), ("t", "n", "a2", "go", [step("ask the risk team", "bob")]), ("u", "m", "a3", "go", [step("stop", None)])],
        f"tenant_id string, name string, seq string, trigger string, steps {VR.STEPS}",
    )
    heads, versions = spark.createDataFrame([], VR.HEADS), spark.createDataFrame([], VR.VERSIONS)
    calls = []
    once = VR.save_processes(heads, versions, new, lambda rows: calls.append(1) or cut_lineage(rows))
    each = VR.save_processes(heads, versions, new)
    assert len(calls) == 1
    for a, b in zip(once, each):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert "Window" not in a._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.version, r.review_reason) for r in once[1].collect()) == [(1, None), (1, None), (2, "actor: 'ann' -> 'bob'")]
    assert sorted((r.state, r.reason or "") for r in once[2].collect()) == [("fresh", ""), ("fresh", ""), ("stale", "contradiction: actor: 'ann' -> 'bob'")]


def test_round_trip_is_searched_once(spark):
    """four steps read the pairs that came back, and each searched for all of them again."""
    words = ["red", "fox", "dog", "blue", "run", "policy", "risk", "team", "ann", "bob"]
    draw = random.Random(2)
    chunks = spark.createDataFrame([("t", f"c{i}", " ".join(draw.sample(words, 7))) for i in range(30)], "tenant_id string, chunk_id string, text string")
    vectors = cut_lineage(chunks.withColumn("vector", E.hashing_vector("text")))
    none = TR.synthetic_queries(vectors).filter(F.lit(False))
    made = TR.prepare(vectors, vectors, none, none)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    back = TR.round_trip(TR.synthetic_queries(vectors), vectors)
    assert sorted(r.query_id for r in made.collect()) == sorted(r.query_id for r in back.collect()) != []
