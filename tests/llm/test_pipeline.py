"""The pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import frames as X

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf=SF):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def test_stages_on_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = staged(spark, docs)
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps]
    letters = [d for d, r in rows[0].items() if any(c.isalpha() for c in r.text or "")]
    assert set(rows[1]) == set(letters)
    best = {}
    for d, r in rows[1].items():
        best[X.fold(r.text)] = max(d, best.get(X.fold(r.text), d))
    assert set(rows[2]) == set(best.values())
    roots = X.groups({d: X.simhash(r.text) for d, r in rows[2].items()})
    assert set(rows[3]) == set(roots.values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[4]) == {d for d, r in rows[3].items() if not any(X.leaks(r.text, i) for i in items)}
    copies = [(r.doc_id, r.copy) for r in steps[5].collect()]
    assert len(copies) == len(set(copies)) and {d for d, _ in copies} <= set(rows[4]) and {c for _, c in copies} <= {1, 2}
    final = sorted((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, SF).collect())
    assert final == sorted(copies)


def test_awkward_rows_and_nothing(spark):
    docs = X.frame(spark)
    steps = staged(spark, docs)
    assert all(s.columns == docs.columns for s in steps[:-1])
    assert steps[-1].columns == [*docs.columns, "copy"]
    texts = [X.fold(r.text) for r in steps[2].collect()]
    assert len(texts) == len(set(texts))
    assert [s.count() for s in staged(spark, docs.limit(0))] == [0] * 6


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "op8_exact_dedup" in entry.oracle_sql()
