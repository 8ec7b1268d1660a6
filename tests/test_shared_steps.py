"""Steps that many queries share: read once, and no dearer than they need be."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking as C
from lodestone.operators import graph as G
from lodestone.operators import inverted
from lodestone.operators import sparse as S
from lodestone.registry import knowledge as K
from lodestone.registry import views as V

SF = "/root/testdata/sf0.001"


def test_chunks_mentions_and_steps_are_written_once(spark):
    for make in (V.chunks, K.cands, K.steps):
        rows = make(spark, SF)
        assert rows.inputFiles() == make(spark, SF).inputFiles()
        assert not any("documents" in f for f in rows.inputFiles())


def test_trimming_takes_the_characters_of_the_pattern(spark):
    rows = spark.createDataFrame([(chr(i) + "a" + chr(i) + "b" + chr(i),) for i in range(0x11000) if not 0xD800 <= i < 0xE000], "x string")
    old = F.regexp_replace("x", rf"(?U)\A[{X.WS}]+|[{X.WS}]+\z", "")
    assert rows.filter(~old.eqNullSafe(X.strip("x")) | ~old.eqNullSafe(F.expr(C._strip("x")))).isEmpty()
    assert rows.filter(X.strip("x") != F.col("x")).count() == len(X.BLANKS) == 29
    assert "regexp" not in C._strip("x")


def test_only_words_that_begin_a_phrase_are_cut_out(spark):
    lexicon = [("risk team", "team"), ("risk", "role"), ("été", "system")]
    row = spark.createDataFrame([("Risk team, risk_team; the été is a risk. Risks",)], "text string")
    sql = G.entities_sql("text", lexicon)
    assert [(e["start"], e["name"]) for e in row.select(F.expr(sql).alias("e")).first().e] == [(0, "risk team"), (26, "été"), (35, "risk")]
    assert "|[^" not in sql


def test_postings_shuffle_no_words(spark):
    """Counts and ordered positions, null and empty texts and stop words included, without an exchange."""
    rows = [("t", f"c{i}", f"b a b word{i % 7} the") for i in range(5000)] + [(None, "n", "a A a"), ("t", "e", ""), ("t", "z", None)]
    chunks = spark.createDataFrame(rows, "tenant_id string, chunk_id string, text string")
    made = S.build_postings(chunks, "simple")
    assert "Exchange" not in made._jdf.queryExecution().toString()
    got = {(r.tenant_id, r.chunk_id, r.term): (r.tf, r.positions) for r in made.collect()}
    want = {}
    for tenant, chunk, text in rows:
        for at, term in enumerate((text or "").lower().split()):
            tf, places = want.get((tenant, chunk, term), (0, []))
            want[tenant, chunk, term] = (tf + 1, places + [at])
    assert got == want
    assert {r.term for r in S.build_postings(chunks.limit(1), "english").collect()} == {"b", "word0"}


def test_placing_chunks_moves_them_once(spark):
    # texts first moved to their tenant, then to their group
    rows = spark.range(200).selectExpr("IF(id % 7 = 0, null, concat('t', id % 3)) tenant_id", "concat('c', id) id", "repeat('word ', 50) words")
    made = inverted.placed(rows, "_group")
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.collect()
    assert len(got) == 200 and len({(r.tenant_id, r.slab, r.at) for r in got}) == 200


def test_blocks_travel_as_packs(spark, tmp_path, monkeypatch):
    # each posting block was a shuffled row of its own
    monkeypatch.setattr(inverted, "PACK_ROWS", 50)
    texts = [("t", f"c{i:03}", f"b a b word{i % 7} the") for i in range(150)] + [(None, "n", "a A a"), ("t", "e", ""), ("t", "z", None)]
    index = inverted.Index(spark, str(tmp_path / "index"), "simple")
    index.add(spark.createDataFrame(texts, "tenant_id string, chunk_id string, text string"))
    ids = {(r.tenant_id, r.slab, r.at): r.id for r in index.docs().collect()}
    rows = index._read("blocks", inverted.BLOCKS)
    got = {(r.tenant_id, r.term, ids[r.tenant_id, r.slab, p["at"]]): p["positions"] for r in rows.collect() for p in r.postings}
    want = {}
    for tenant, chunk, text in texts:
        for at, term in enumerate((text or "").lower().split()):
            want.setdefault((tenant, term, chunk), []).append(at)
    assert {k: [x - min(v) for x in v] for k, v in got.items()} == {k: [x - min(v) for x in v] for k, v in want.items()}
    assert rows.filter(F.expr(f"bucket <> pmod(xxhash64(tenant_id, term), {index.buckets})")).isEmpty()
    packs = pa.Table.from_batches(inverted._packs([pa.record_batch({"term": ["x"] * 40, "bucket": pa.array([i % 3 for i in range(40)], pa.int32())})] * 3))
    assert packs["bucket"].to_pylist() == [0, 1, 2, 0, 1, 2]
