"""Cells with measured recall, ranks by counting, quantiles by ranges."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense as D
from lodestone.operators import evaluation as E

VECTORS = "tenant_id string, chunk_id long, vector array<float>"


def clouds(spark, n, dim, seed, tenants=("t",)):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(tenants[i % len(tenants)], i, [float(x) for x in centres[i % 12] + rng.normal(size=dim) * 0.7]) for i in range(n)]
    return spark.createDataFrame(rows + [("t", n, [0.0] * dim)], VECTORS)


def test_default_cells_reach_their_recall(spark):
    corpus = clouds(spark, 3000, 24, 1)
    asked = corpus.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", "vector")
    cells = D.Cells.fit(corpus)
    assert 40 <= len(cells.centres) <= 70
    probes = D.probes_for(cells, asked, corpus, 10)
    assert 1 <= probes < len(cells.centres) / 2
    found = D.approximate_topk(asked, corpus, 10, cells, probes)
    exact = D.dense_topk(asked, corpus, 10)
    assert D.recall_against(found, exact).first().recall >= 0.9
    assert found.count() == exact.count() == 1510
    # all cells probed is the exact search
    whole = D.approximate_topk(asked, corpus, 10, cells, len(cells.centres))
    assert D.recall_against(whole, exact).first().recall == 1.0


def test_cells_of_nothing_and_of_too_many(spark):
    none = spark.createDataFrame([], VECTORS)
    asked = none.select(F.col("chunk_id").alias("query_id"), "tenant_id", "vector")
    assert D.approximate_topk(asked, none, 3).isEmpty()
    with pytest.raises(ValueError, match="sent to every task"):
        D.Cells(np.broadcast_to(np.zeros((1, 1 << 20)), (100, 1 << 20)))


def test_ranks_by_counting_are_the_ranks(spark, monkeypatch):
    monkeypatch.setattr(D, "CORPUS_BLOCK", 50)
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([("tu"[i % 2], i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(400)], VECTORS)
    asked = spark.createDataFrame([("tu"[i % 2], i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(12)], "tenant_id string, query_id long, vector array<float>")
    exact = {(r.query_id, r.chunk_id): r["rank"] for r in D.dense_topk(asked, corpus, 1000).collect()}
    whole = {(r.query_id, r.chunk_id): r["rank"] for r in D.full_ranking(asked, corpus, bins=16).collect()}
    assert whole == exact and len(exact) == 12 * 200
    labels = spark.createDataFrame([(q, c) for q in range(12) for c in range(400) if (q * 7 + c) % 23 == 0], "query_id long, chunk_id long")
    best = D.best_marks(asked, corpus, labels)
    ranks = D.ranks_of_marks(asked, corpus, best)
    got = {r.query_id: r["rank"] for r in ranks.collect()}
    held = {(r.query_id, r.chunk_id) for r in labels.collect()}
    assert got == {q: min(exact[k] for k in held if k[0] == q and k in exact) for q in got} and len(got) == 12
    ranked = D.dense_topk(asked, corpus, 1000).select("query_id", "chunk_id", "rank")
    want = sorted(map(tuple, E.query_metrics(ranked, labels).collect()))
    assert sorted(map(tuple, E.embedder_metrics(asked, corpus, labels).collect())) == want
    plan = ranks._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrdered" not in plan


@pytest.mark.parametrize("settled", [3, 100_000])
def test_quantiles_of_awkward_columns(spark, settled):
    draw = random.Random(6)
    columns = {
        "continuous": [draw.expovariate(1) for _ in range(3000)], "outlier": [draw.random() for _ in range(500)] + [1e18],
        "ties": [draw.choice([1.0, 2.0, 2.0, 3.0]) for _ in range(999)], "one": [7.5], "same": [3.0] * 200, "signs": [draw.gauss(0, 1) for _ in range(100)],
    }
    rows = [(k, v) for k, vs in columns.items() for v in vs] + [("one", None), ("none", None)]
    got = {(r.k, r.p): r.value for r in E.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", bins=8, settled=settled).collect()}
    assert got == {(k, p): sorted(vs)[min(len(vs) - 1, math.floor(p / 100 * len(vs)))] for k, vs in columns.items() for p in (50, 95, 99)}
