"""Exact top-k of many queries: what is copied, and what is the same."""

from __future__ import annotations

import random
import numpy as np
from lodestone.operators import dense as D


def test_many_queries_meet_the_corpus_in_few_small_copies(spark):
    """Each row travels once for 16384 queries, packed; ties at the cut go to the smaller id."""
    draw = random.Random(3)
    rows = [("t", f"c{i:04d}", [float(draw.choice((0, 0, 0, 1, -1, 2))) for _ in range(64)]) for i in range(300)]
    rows += [("t", f"a{i:04d}", rows[0][2]) for i in range(40)] + [("t", "zero", [0.0] * 64)]
    corpus = spark.createDataFrame(rows, "tenant_id string, chunk_id string, vector array<float>")
    for few in (True, False):
        asked = [("t", i, [x if not few or p < 5 else 0.0 for p, x in enumerate(r[2])]) for i, r in enumerate(rows)]
        queries = spark.createDataFrame(asked, "tenant_id string, query_id int, vector array<float>")
        c = np.array([r[2] for r in rows])
        got = {}
        for r in D._ranked(D.blocked_topk(queries, corpus, 7, ["tenant_id"], "chunk_id", 100, 90), 7, "chunk_id").collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
        for _, i, v in asked:
            q = np.array(v)
            scale = np.sqrt((q @ q) * (c * c).sum(axis=1))
            score = np.divide(c @ q, scale, out=np.zeros(len(c)), where=scale > 0)
            best = sorted(range(len(c)), key=lambda j: (-score[j], rows[j][1]))[:7]
            assert [got[i][n] for n in range(1, 8)] == [rows[j][1] for j in best]


def test_packs_are_small_and_exact(spark):
    rows = spark.createDataFrame([("t", 0, i, [float((i * p) % 5 == 0) for p in range(384)]) for i in range(500)] + [("t", 1, 1000 + i, [i / 7] * 384) for i in range(20)], "tenant_id string, spot int, id long, vector array<float>").coalesce(1)
    packs = D._packed(rows, ["tenant_id"], "spot", "id").collect()
    assert sum(len(p["pack"]) for p in packs if p.spot == 0) < 500 * 384 * 4 / 10
    back = {n: list(v) for p in packs for n, v in zip(p.names, np.frombuffer(D.pa.decompress(bytes(p["pack"]), p["size"], codec="zstd", asbytes=True), p.kind).reshape(len(p.names), -1))}
    assert back == {r.id: r.vector for r in rows.collect()}
