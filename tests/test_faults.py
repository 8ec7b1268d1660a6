"""Small inputs for faults that whole-table queries do not reach."""

from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone import session
from lodestone.functions import ids
from lodestone.operators import changes as C
from lodestone.operators import dense as D
from lodestone.operators import evaluation as E
from lodestone.operators import freshness as FR
from lodestone.operators import graph as G
from lodestone.operators import replies as R
from lodestone.operators.fusion import reciprocal_rank_fusion
from lodestone.sources import fixtures as FX
from lodestone.sources import incremental as I
from lodestone.sources import normalize as N
from lodestone.sources import sinks


def test_two_tenants_may_use_one_query_id(spark):
    q = spark.createDataFrame([("t", 1, [1.0, 0.0]), ("u", 1, [0.0, 1.0])], "tenant_id string, query_id short, vector array<float>")
    c = spark.createDataFrame([("t", "a", [1.0, 0.0]), ("u", "b", [0.0, 1.0]), ("u", "c", [1.0, 0.0])], "tenant_id string, chunk_id string, vector array<float>")
    for bound in (10, 1):
        rows = D.dense_topk(q, c, 1, query_bound=bound)
        assert {(r.tenant_id, r.chunk_id) for r in rows.collect()} == {("t", "a"), ("u", "b")}
        fused = reciprocal_rank_fusion([rows, rows])
        assert {(r.tenant_id, r.chunk_id, r.rank) for r in fused.collect()} == {("t", "a", 1), ("u", "b", 1)}


def test_ids_of_different_parts_differ(spark):
    rows = [("a|b", "c", "d"), ("a", "b|c", "d"), ("a\\", "|b|c", "d"), (None, "c", "d"), ("c", None, "d"), ("\\N", "c", "d")]
    df = spark.createDataFrame(rows, "tenant_id string, source_kind string, external_id string")
    assert df.select(ids.artifact_id()).distinct().count() == len(rows)


def test_labels_stay_in_their_tenant(spark):
    labels = spark.createDataFrame([("t", 1, "e", 0)], "tenant_id string, query_id int, external_id string, ordinal int")
    chunks = spark.createDataFrame([("t", "e", 0, "x"), ("u", "e", 0, "y")], "tenant_id string, external_id string, ordinal int, chunk_id string")
    assert [r.chunk_id for r in E.resolve_labels(labels, chunks).collect()] == ["x"]


def test_idle_keys_keep_their_cursor(spark):
    items = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    cursors = spark.createDataFrame([("a", 6), ("idle", 3)], "k string, since int")
    fresh, after = I.poll(items, cursors, ["k"], "t", F.lit(20))
    assert {tuple(r) for r in fresh.collect()} == {("a", 9), ("b", 1)}
    assert {tuple(r) for r in after.collect()} == {("a", 20), ("b", 20), ("idle", 3)}


def test_a_key_twice_in_a_batch_counts_once(spark):
    columns = "tenant_id string, source_kind string, external_id string, content_hash string, artifact_id string, created_at int"
    batch = spark.createDataFrame([("t", "s", "e", "old", "x", 1), ("t", "s", "e", "new", "y", 2)], columns)
    rows = C.detect_changes(batch, batch.limit(0)).collect()
    assert [(r.content_hash, r.change) for r in rows] == [("new", "insert")]
    points = spark.createDataFrame([("v", "one", 1), ("v", "two", 2)], "vector_id string, payload string, seq int")
    assert [r.payload for r in C.upsert(points.limit(0), points, order="seq").collect()] == ["two"]


def test_freshness_leaves_untouched_rows_alone(spark):
    schema = "tenant_id string, object_type string, object_id string, state string, reason string, last_validated_at timestamp, ttl_seconds bigint"
    stored = spark.createDataFrame([("t", "p", "1", "stale", None, None, None)], schema)
    updates = spark.createDataFrame([], "tenant_id string, object_type string, object_id string, state string, reason string, ttl_seconds bigint, seq int")
    assert FR.set_freshness(stored, updates, F.current_timestamp()).first().last_validated_at is None


def test_a_model_is_called_once_per_row(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(str(i),) for i in range(20)], "text string").repartition(2)
    done, failed = R.apply_model(df, F.col("text"), model)
    assert (done.count(), failed.count(), calls.value) == (20, 0, 20)


def test_mail_parts(spark):
    plain = '{"mimeType": "text/plain", "body": {"data": "aMOp"}}'
    html = '{"mimeType": "text/html", "body": {"data": "PGI-"}}'
    nest = plain
    for _ in range(6):
        nest = f'{{"mimeType": "multipart/mixed", "parts": [{html}, {nest}]}}'
    mails = [plain, html, nest, "{}", "not json", None, '{"mimeType": "text/plain"}', '{"mimeType": "multipart/mixed", "parts": [%s, %s]}' % (plain, plain)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(mails)], "i int, payload string")
    got = [r._text for r in N.mime_text(df).orderBy("i").collect()]
    assert got == ["hé", "<b>", "hé", "", "", "", "", "hé\nhé"]


def plain_walk(part, mime):
    """Outermost parts of a type, depth first."""
    if part.get("mimeType") == mime:
        return base64.urlsafe_b64decode(part.get("body", {}).get("data", "")).decode()
    return "\n".join(filter(None, (plain_walk(p, mime) for p in part.get("parts", []))))


def test_mail_parts_of_any_depth_in_the_order_of_the_message(spark):
    draw = random.Random(3)

    def tree(depth):
        kind = draw.choice(["text/plain", "text/html", "multipart/mixed", "message/rfc822"]) if depth else "multipart/mixed"
        part = {"mimeType": kind, "body": {"data": base64.urlsafe_b64encode(f"{kind} {draw.random()} é?>".encode()).decode()}}
        if depth < 14 and (kind[0] == "m" or draw.random() < 0.3):
            part["parts"] = [tree(depth + 1) for _ in range(draw.choice([1, 1, 2]))]
        return part

    deep = {"mimeType": "text/plain", "body": {"data": "ZGVlcA=="}}
    for _ in range(25):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    trees = [deep, *(tree(0) for _ in range(40))]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, payload string")
    got = {r.i: r._text for r in N.mime_text(df).collect()}
    assert got == {i: plain_walk(t, "text/plain") or plain_walk(t, "text/html") for i, t in enumerate(trees)} and got[0] == "deep"
    assert len({len(t) for t in got.values()}) > 10


def test_the_packaged_fixture_is_stable_and_normalises(spark):
    items = FX.packaged_items(spark, "t")
    rows = N.normalize("sample", items=items).collect()
    assert len({r.external_id for r in rows}) == len(rows) == 8 and {r.source_kind for r in rows} == {"sample"}
    assert {r.kind for r in rows} == {"page", "doc", "issue", "pr", "message", "email"} and {str(r.created_at) for r in rows} == {"2026-01-01 00:00:00"}
    assert FX.poll_items(items).isEmpty()


def test_reports_name_every_metric(spark):
    deltas = spark.createDataFrame([("mrr", 0.5, 0.1), ("recall_at_5", 0.25, None)], "metric string, value double, delta double")
    worst = spark.createDataFrame([("why", 0.0, 1)], "query string, mrr double, rank int")
    lines = [r.line for r in sinks.retrieval_report(deltas, worst, "hybrid", "test", "today", 2).orderBy("line_no").collect()]
    assert "| mrr | 0.5000 | +0.1000 |" in lines and "| recall_at_5 | 0.2500 | new |" in lines and lines[-1] == "1. 0.00: why"
    verdict = spark.createDataFrame([(False, ["too small"])], "passed boolean, reasons array<string>")
    both = spark.createDataFrame([("mrr", 0.5, 0.6, 0.1)], "metric string, base double, candidate double, delta double")
    lines = [r.line for r in sinks.ab_report(both, verdict).orderBy("line_no").collect()]
    assert "| mrr | 0.5000 | 0.6000 | +0.1000 |" in lines and lines[-1] == "- too small"


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def plain_merge(entities, threshold):
    def close(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b), 1) >= threshold

    out = []
    for kind, name, aliases, confidence in sorted(entities):
        at = next((i for i, o in enumerate(out) if o[0] == kind and close(o[1], name)), None)
        if at is None:
            out.append((kind, name, sorted(aliases), confidence))
        else:
            _, old, held, best = out[at]
            out[at] = (kind, name if len(name) > len(old) else old, sorted(set(held) | set(aliases)), max(best, confidence))
    return sorted(out)


def test_similar_names_fold_in_order(spark):
    rng = random.Random(1)
    names = {"machine learning team", "machine learnin team", "machine learning teams", "a machine learning team", "finance", ""}
    for _ in range(40):
        base = "".join(rng.choice("ab ") for _ in range(rng.randint(8, 24)))
        for _ in range(4):
            at = rng.randrange(len(base))
            names.add(base[:at] + rng.choice(["", "x", "xy"]) + base[at + rng.randint(0, 1) :])
    rows = [(rng.choice("kl"), n, [n, n.upper()], rng.random()) for n in sorted(names)]
    df = spark.createDataFrame(rows, "type string, name string, aliases array<string>, confidence double")
    for threshold in (0.9, 0.8):
        got = sorted((r.type, r.name, list(r.aliases), r.confidence) for r in G.merge_similar(df, [], threshold).collect())
        assert got == plain_merge(rows, threshold)
        assert len(got) < len(rows)


def test_similar_names_need_no_linked_set_in_one_place(spark):
    # a set of linked names was folded in one row, each name against all kept before
    rng = random.Random(2)
    parts = ["an", "the", "ion", "er", "and"]
    names = set()
    while len(names) < 400:
        name = "".join(rng.choice(parts) for _ in range(5))
        at = rng.randrange(len(name))
        names |= {name, name[:at] + rng.choice(["", "x", "e"]) + name[at + rng.randint(0, 1) :]}
    rows = [(rng.choice("kl"), n, [n, n.upper()], rng.random()) for n in sorted(names)]
    rows += [("k", rows[0][1], ["again", "again"], 2.0), ("l", "single", ["b", "a", "a"], 0.5)]
    df = spark.createDataFrame(rows, "type string, name string, aliases array<string>, confidence double")
    plain = plain_merge(sorted(rows), 0.9)
    for small in (0, 100, 20_000):
        out = G.merge_similar(df, [], 0.9, small)
        assert sorted((r.type, r.name, list(r.aliases), r.confidence) for r in out.collect()) == plain
    out = G.merge_similar(df, [], 0.9)
    assert "levenshtein" not in out._jdf.queryExecution().analyzed().toString()
