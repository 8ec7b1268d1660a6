"""The stored index against the scan of the texts: every query form, segments, tombstones, merging, pruning."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from lodestone.operators import inverted as I
from lodestone.operators import sparse as S
from lodestone.session import cut_lineage, sized

CHUNKS = "tenant_id string, chunk_id string, text string, source_kind string, artifact_id string"
WORDS = ["red", "fox", "dog", "blue", "the", "run", "runs", "policy", "approved", "x1", "été"]
ASKED = [
    "red fox", '"red fox"', "fox OR dog", "red -fox", "-red", "missing", "red missing", '"the red" dog', 'dog -"red fox"', "red OR -fox", "the", "",
    "red red fox", '"red red"', "blue OR fox dog OR x1", "été", '"fox red" OR "dog the" -blue', "or", '"or"', "running policies",
]


def texts(n, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("tu"), f"c{seed}-{i:04d}", " ".join(draw.choices(WORDS, k=draw.randrange(0, 14))), draw.choice(["a", "b"]), f"d{seed}-{i // 3}") for i in range(n)]
    return rows + [("t", f"e{seed}", "", "a", "de"), ("t", f"h{seed}", "fox " * 300, "b", "dh")]


def asked(spark):
    rows = [(i * 2 + j, t, q) for i, q in enumerate(ASKED) for j, t in enumerate("tu")]
    return spark.createDataFrame(rows, "query_id int, tenant_id string, query string")


@pytest.fixture()
def small_slabs(monkeypatch):
    monkeypatch.setattr(I, "SLAB", 5)
    monkeypatch.setattr(I, "GROUP_CHUNKS", 20)


def new_index(spark, config="simple"):
    return I.Index(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index", config, buckets=4)


def rows_of(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("config", ["simple", "english"])
def test_index_matches_as_the_scan_does(spark, small_slabs, config):
    chunks, index = spark.createDataFrame(texts(150, 1), CHUNKS).repartition(3), new_index(spark, config)
    index.add(chunks)
    for scoring in ("cover_density", "bm25"):
        for kinds in (None, ["a"]):
            scanned = chunks if kinds is None else chunks.filter(F.col("source_kind").isin(kinds))
            want = rows_of(S.sparse_matches(asked(spark), scanned, scoring, config))
            got = rows_of(I.Search(index, asked(spark), scoring, kinds).matches())
            assert got == want and want
    assert max(r.n for r in index.docs().groupBy("tenant_id", "slab").agg(F.count("*").alias("n")).collect()) <= 5


def test_pruned_topk_is_the_topk(spark, small_slabs):
    chunks, index = spark.createDataFrame(texts(200, 2), CHUNKS), new_index(spark)
    index.add(chunks)
    want = sorted((r.query_id, r.chunk_id, r["rank"]) for r in S.sparse_topk(asked(spark), chunks, 3, config="simple").collect())
    for first in (1, 2, 1000):
        got = I.Search(index, asked(spark)).topk(3, first_slabs=first)
        assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in got.collect()) == want


def test_bounds_hold_and_skip_slabs(spark, small_slabs):
    """No chunk scores above its slab's bound, and a single frequent word needs few slabs."""
    chunks, index = spark.createDataFrame(texts(200, 3), CHUNKS), new_index(spark)
    index.add(chunks)
    search = I.Search(index, asked(spark))
    slabs = search.candidates()
    best = search.scored(slabs).groupBy("query_id", *I.SLAB_KEYS).agg(F.max("score").alias("score"))
    met = best.join(slabs, ["query_id", *I.SLAB_KEYS])
    assert met.filter("score > bound").isEmpty() and met.filter("bound IS NOT NULL").count() > 50
    one = slabs.filter(F.col("query_id") == 2 * ASKED.index("the"))
    kth = sorted((r.score for r in search.scored(one).collect()), reverse=True)[2]
    assert one.filter(F.col("bound") >= kth).count() < one.count() / 2


@pytest.mark.parametrize("merged", [False, True])
def test_segments_with_gone_owners_are_as_one_rebuilt_index(spark, small_slabs, merged):
    old, new = texts(90, 4), texts(40, 5)
    gone = {"d4-0", "d4-7", "dh"}
    back = [r for r in old if r[4] == "d4-7"]  # an owner that comes back with its old ids
    index, whole = new_index(spark), new_index(spark)
    index.add(spark.createDataFrame(old, CHUNKS), "a")
    names = spark.createDataFrame([(t, g) for g in gone for t in "tu"], "tenant_id string, owner string")
    for _ in range(2):  # the batch is played twice
        index.add(spark.createDataFrame(new + back, CHUNKS), "b", names)
    assert index.segments() == ["a", "b"]
    live = [r for r in old if r[4] not in gone] + new + back
    whole.add(spark.createDataFrame(live, CHUNKS))
    if merged:
        index.compacted("m")
        assert index.segments() == ["m"]
        for table, keys in (("docs", "tenant_id, slab, at, id, length, owner"), ("blocks", "tenant_id, term, slab, mask, most, postings")):
            held = [set(map(str, i._read(table, {"docs": I.DOCS, "blocks": I.BLOCKS}[table]).selectExpr(*keys.split(", ")).collect())) for i in (index, whole)]
            assert held[0] == held[1]
    for scoring in ("cover_density", "bm25"):
        found = [rows_of(I.Search(i, asked(spark), scoring).matches()) for i in (index, whole)]
        assert found[0] == found[1] == rows_of(S.sparse_matches(asked(spark), spark.createDataFrame(live, CHUNKS), scoring, "simple"))


def test_empty_index_and_empty_tables(spark):
    index = new_index(spark)
    assert index.segments() == [] and I.Search(index, asked(spark)).topk(3).isEmpty()
    index.add(spark.createDataFrame([], CHUNKS))
    assert index.segments() == ["s0"] and I.Search(index, asked(spark)).topk(3).isEmpty()
    index.add(spark.createDataFrame(texts(10, 6), CHUNKS), "s1")
    assert I.Search(index, asked(spark).limit(0)).topk(3).isEmpty()
    assert not I.Search(index, asked(spark)).topk(3).isEmpty()


def test_texts_are_not_read_and_light_columns_come_first(spark, small_slabs):
    index = new_index(spark)
    index.add(spark.createDataFrame(texts(50, 7), CHUNKS))
    plan = I.Search(index, asked(spark)).candidates()._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_words_move_as_whole_texts(spark, monkeypatch):
    """An occurrence is no row of its own on its way into a block; stop words and empty texts only take places."""
    kept = {}
    monkeypatch.setattr(I.Index, "_write", lambda self, segment, docs, blocks, gone: kept.update(blocks=blocks))
    monkeypatch.setattr(I.Index, "_publish", lambda self, segments: None)
    rows = [("t", "c1", "the red fox the red", "a", "d"), ("t", "c2", "", "a", "d"), (None, "c3", "the", "a", "d"), ("t", "c4", "Red", "a", "d")]
    new_index(spark, "english").add(spark.createDataFrame(rows, CHUNKS))
    assert "Generate" not in kept["blocks"]._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.tenant_id, r.term): (r.mask, r.most, [(p["at"], p["positions"]) for p in r.postings]) for r in I._nested(kept["blocks"]).collect()}
    assert got == {("t", "red"): (0b101, 2, [(0, [1, 4]), (2, [0])]), ("t", "fox"): (0b1, 1, [(0, [2])])}


@pytest.mark.parametrize("rows, parts", [(7, 4), (7, 1000), (2, 0)])
def test_lookups_go_by_counted_rows_in_slices_of_buckets(spark, small_slabs, monkeypatch, rows, parts):
    """F1, F6 to F11: what is looked up was broadcast whole where its file was small; a packed row takes a byte or two."""
    monkeypatch.setattr(I, "LOOKUP_ROWS", rows)
    monkeypatch.setattr(I, "LOOKUP_PARTS", parts)
    sent = []
    monkeypatch.setattr(I.F, "broadcast", lambda df, real=F.broadcast: sent.append(df.count()) or real(df))
    chunks, index = spark.createDataFrame(texts(60, 8), CHUNKS), new_index(spark)
    index.add(chunks)
    some = spark.createDataFrame([(1, "t", "red fox dog"), (2, "t", '"red fox" OR -fox'), (3, "u", "dog blue -the")], "query_id int, tenant_id string, query string")
    want = rows_of(S.sparse_matches(some, chunks, config="simple"))
    top = sorted((r.query_id, r.chunk_id, r["rank"]) for r in S.sparse_topk(some, chunks, 3, config="simple").collect())
    sent.clear()
    assert rows_of(I.Search(index, some).matches()) == want and len(want) > 20
    assert sorted((r.query_id, r.chunk_id, r["rank"]) for r in I.Search(index, some).topk(3, first_slabs=1).collect()) == top
    assert max(sent, default=0) <= 3 * rows  # a few rows of a slab can have one hash



def test_a_large_written_side_is_not_broadcast_for_its_few_bytes(spark):
    rows = cut_lineage(spark.range(60_000).selectExpr("'a tenant with a long name' AS t", "id % 3 AS n"))
    other = cut_lineage(spark.range(1000).selectExpr("id % 3 AS n", "repeat(uuid(), 500000) AS u").limit(3))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(other.join(rows, "n")) and "BroadcastHashJoin" not in plan(other.join(sized(rows), "n"))
    assert "BroadcastHashJoin" in plan(other.join(sized(rows.limit(100)), "n"))
