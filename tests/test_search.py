"""Search operators: block paths, ties, plans, bucket algebra."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.stem import stem
from lodestone.operators import dense as D
from lodestone.operators import sparse as S
from lodestone.operators.embedding import embedder, hashing_vector
from lodestone.operators.flow import Bucket
from lodestone.operators.fusion import reciprocal_rank_fusion


def vectors(spark, n, dim, seed, key):
    rng = np.random.default_rng(seed)
    rows = [(f"{key}{i:03d}", "t" if i % 3 else "u", [float(x) for x in rng.integers(-2, 3, dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} string, tenant_id string, vector array<float>")


def test_scan_and_blocks_agree(spark):
    q = vectors(spark, 30, 6, 1, "q").withColumnRenamed("q", "query_id")
    c = vectors(spark, 200, 6, 2, "c").withColumnRenamed("c", "chunk_id")
    cols = ["query_id", "chunk_id", "rank"]
    scan = set(map(tuple, D.dense_topk(q, c, 7).select(*cols).collect()))
    blocks = set(map(tuple, D.dense_topk(q, c, 7, query_bound=5).select(*cols).collect()))
    assert scan == blocks and len(scan) == 30 * 7


def test_small_and_large_query_tables_agree(spark, monkeypatch):
    texts = ["red fox jumps", "the red dog", "blue fox or dog", "red red fox"]
    chunks = spark.createDataFrame([("t", f"c{i}", t) for i, t in enumerate(texts)], "tenant_id string, chunk_id string, text string")
    asked = ["red fox", '"red fox"', "fox OR dog", "red -fox", "-red", "missing"]
    q = spark.createDataFrame([(i, "t", t) for i, t in enumerate(asked)], "query_id int, tenant_id string, query string")
    want = {(0, "c0"), (0, "c3"), (1, "c0"), (1, "c3"), (2, "c0"), (2, "c1"), (2, "c2"), (2, "c3"), (3, "c1"), (4, "c2")}

    def found():
        return {(r.query_id, r.chunk_id) for r in S.sparse_matches(q, chunks, config="simple").collect()}

    assert found() == want
    monkeypatch.setattr(S, "pinned_if_small", lambda df: (df, False))
    assert found() == want


def test_english_terms(spark):
    assert [stem(w) for w in ("running", "approved", "policies", "relational", "hopping", "sky")] == ["run", "approv", "polici", "relat", "hop", "sky"]
    chunks = spark.createDataFrame([("t", "c", "The approvals were running")], "tenant_id string, chunk_id string, text string")
    q = spark.createDataFrame([(1, "t", "approval runs")], "query_id int, tenant_id string, query string")
    assert S.sparse_topk(q, chunks).count() == 1


def test_fusion_ties_and_errors(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "query_id int, chunk_id string, rank int")
    rows = reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["x", "y"] and rows[0].score == rows[1].score == 1 / 61 + 1 / 62
    with pytest.raises(ValueError):
        reciprocal_rank_fusion([a], k=0)


def test_embedders(spark):
    df = spark.createDataFrame([("",), ("a a b",)], "t string").select(hashing_vector("t").alias("v"))
    empty, some = [r.v for r in df.collect()]
    assert len(empty) == 384 and not any(empty) and sorted(map(abs, filter(None, some))) == [1.0, 2.0]
    with pytest.raises(ValueError):
        embedder("nope")


def test_bucket_transfer_equals_fold():
    rng = random.Random(3)
    for _ in range(200):
        bucket = Bucket(rng.choice([1, 3, 5]), rng.choice([0.0, 0.1, 0.5, 2.0]))
        times = sorted(rng.randint(0, 40_000_000) for _ in range(rng.randint(1, 30)))
        costs = [rng.choice([1, 1, 2]) for _ in times]
        pieces = bucket.transfer(times, [c * 10**12 for c in costs])
        for entry in {0, bucket.cap, rng.randint(0, bucket.cap), rng.randint(0, bucket.cap)}:
            tokens, last = entry, times[0]
            for t, c in zip(times, costs):
                tokens = bucket.refill(tokens, t - last)
                last = t
                _, _, tokens = bucket.take(tokens, c)
            assert bucket.apply(pieces, entry) == tokens


def test_dense_plan_has_no_cartesian(spark):
    q = vectors(spark, 3, 4, 1, "q").withColumnRenamed("q", "query_id")
    c = vectors(spark, 9, 4, 2, "c").withColumnRenamed("c", "chunk_id")
    for bound in (1, 100):
        plan = D.dense_topk(q, c, 2, query_bound=bound)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unit_vector_computes_its_norm_once(spark):
    """The norm stands outside of the step over the components."""
    from lodestone.operators.embedding import unit_vector

    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(unit_vector("v").alias("u"))
    assert rows._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0]]
