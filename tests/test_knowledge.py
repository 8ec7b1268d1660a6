"""Default lexicon, cues, gates, versions and plug-ins on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import graph as G
from lodestone.operators import replies as R
from lodestone.operators import serving as S
from lodestone.operators import versions as VR
from lodestone.operators.process import check_invariants, gate_steps


def chunks(spark, *texts):
    return spark.createDataFrame([("t", "a", f"c{i}", t) for i, t in enumerate(texts)], "tenant_id string, artifact_id string, chunk_id string, text string")


def test_longer_phrases_take_their_place(spark):
    rows = G.extract_entities(chunks(spark, "The Finance Team asks finance; refinance is no match. On-call engineer."))
    assert [(r.name, r.type) for r in rows.orderBy("start").collect()] == [("finance team", "team"), ("finance", "team"), ("on-call engineer", "role")]


def test_relations(spark):
    text = "The support agent routes refunds; they are routed to the finance team for approval. Managers escalate to the CFO, if large."
    got = {(r.subject, r.predicate, r.object) for r in G.extract_relations(chunks(spark, text)).collect()}
    assert got == {("support agent", "requires_approval_from", "finance team"), ("finance team", "escalates_to", "cfo")}


def test_resolution_scope_and_synonyms(spark):
    cand = spark.createDataFrame(
        [("t", "a", "c1", "finance", "team", 0.8), ("t", "a", "c2", "the finance team.", "team", 0.9), ("t", "b", "c3", "finance", "team", 0.8)],
        "tenant_id string, artifact_id string, chunk_id string, name string, type string, confidence double",
    )
    by_artifact, seen = G.resolve_entities(cand)
    assert {(r.artifact_id, r.name, r.confidence) for r in by_artifact.collect()} == {("a", "the finance team.", 0.9), ("b", "finance", 0.8)}
    assert seen.count() == 3
    assert G.resolve_entities(cand, "tenant")[0].count() == 1


def body(spark, rows):
    return spark.createDataFrame(rows, f"tenant_id string, name string, trigger string, seq string, steps {VR.STEPS}")


def step(action, actor=None, chunk="c1"):
    return (1, action, actor, [(chunk, action)], None)


def empty(spark):
    return spark.createDataFrame([], VR.HEADS), spark.createDataFrame([], VR.VERSIONS)


def test_versions(spark):
    first = body(spark, [("t", "refund", "x", "1", [step("Approve the refund request", "cfo")])])
    heads, versions, fresh = VR.save_processes(*empty(spark), first)
    assert [(r.current_version, r.status) for r in heads.collect()] == [(1, "active")]
    assert [r.state for r in fresh.collect()] == ["fresh"]
    _, added, _ = VR.save_processes(heads, versions, first)
    assert added.count() == 0
    changed = body(spark, [("t", "refund", "x", "2", [step("Approve the refund request", "finance team", "c9")])])
    heads2, added, fresh = VR.save_processes(heads, versions, changed)
    assert [(r.current_version, r.status) for r in heads2.collect()] == [(2, "draft")]
    assert added.collect()[0].review_reason == "actor: 'cfo' -> 'finance team'"
    assert fresh.collect()[0].reason == "contradiction: actor: 'cfo' -> 'finance team'"
    with pytest.raises(ValueError):
        VR.review(heads, heads.select("tenant_id", "process_id", F.lit("maybe").alias("action"), F.lit(1).alias("seq")))


def test_gate_drops_unsupported_steps(spark):
    texts = chunks(spark, "Submit the expense report today")
    steps = spark.createDataFrame(
        [("t", "a", 1, "Launch rockets tomorrow", [("c0", "")]), ("t", "a", 2, "Submit the expense report", [("c0", "")]), ("t", "a", 3, "Submit the report", [("zz", "")])],
        "tenant_id string, artifact_id string, ordinal long, action string, citations array<struct<chunk_id:string,quote:string>>",
    )
    assert [(r.ordinal, r.action) for r in gate_steps(steps, texts).collect()] == [(1, "Submit the expense report")]


def test_invariants(spark):
    rows = spark.createDataFrame([("ok", [step("a")]), ("none", []), ("bare", [(1, "a", None, [], None)])], f"name string, steps {VR.STEPS}")
    valid, rejected = check_invariants(rows)
    assert [r.name for r in valid.collect()] == ["ok"] and {r.name for r in rejected.collect()} == {"none", "bare"}


def test_replies(spark):
    texts = ['{"steps": [{"step": "do", "citation": "c1"}, {"action": "x"}, {"action": "go", "chunk_id": "c2"}]}', "no json", "```{\"steps\": []}```", "{bad} {\"a\": 1}"]
    rows = R.reply_steps(spark.createDataFrame([(t,) for t in texts], "reply string"), [])
    assert [(r.ordinal, r.action, r.citations[0].chunk_id) for r in rows.collect()] == [(1, "do", "c1"), (2, "go", "c2")]
    with pytest.raises(ValueError):
        R.chosen({"template": 1}, "other", "blurb mode")


def test_routing(spark):
    cite = [("c1", None)]
    skills = spark.createDataFrame(
        [("t", "refund policy", "x", [("Refunds up to $500 are instant", "agent", None, cite), ("Refunds over $500 need the CFO", "cfo", None, cite)])],
        "tenant_id string, name string, trigger string, steps array<struct<action:string,actor:string,decision:string,citations:array<struct<chunk_id:string,quote:string>>>>",
    )
    tasks = spark.createDataFrame([(1, "t", "refund", 750.0), (2, "t", "refund", 500.0), (3, "t", "other", 1.0), (4, "u", "refund", 1.0)], "task_id int, tenant_id string, type string, amount_usd double")
    got = {r.task_id: (r.actor, r.reason) for r in S.route_tasks(tasks, skills).collect()}
    assert got == {1: ("cfo", ""), 2: ("agent", ""), 3: (None, "nothing handles tasks of type other"), 4: (None, "the tenant has no skill about refund")}


def test_routing_is_the_first_applying_step_of_all(spark):
    """The stairs against every task met with every step."""
    draw = random.Random(8)
    cite = [("c", None)]
    texts = ["Refunds over ${}", "Refunds up to ${}", "Refund under ${:.2f}", "Refunds of ${} happen", "No amount"]
    rows, every = [], []
    for t in "tuv":
        for k in range(60):
            steps = [(draw.choice(texts).format(draw.randrange(0, 900)), None, None, draw.choice([cite, cite, []])) for _ in range(draw.randrange(4))]
            name = f"refund {draw.randrange(10**6):06d}"
            rows.append((t, name, "x", steps))
            every += [(t, name, n, s[0]) for n, s in enumerate(steps) if s[3]]
    skills = spark.createDataFrame(rows, "tenant_id string, name string, trigger string, steps array<struct<action:string,actor:string,decision:string,citations:array<struct<chunk_id:string,quote:string>>>>")
    asked = [(i, draw.choice("tuvw"), "refund", float(draw.choice([draw.randrange(-5, 910), draw.random() * 900]))) for i in range(400)]
    tasks = spark.createDataFrame(asked, "task_id int, tenant_id string, type string, amount_usd double")
    steps = spark.createDataFrame(every, "tenant_id string, skill string, _no int, action string")
    pairs = tasks.join(steps, "tenant_id").filter(F.expr(S.step_applies("action", "amount_usd")))
    want = {r.task_id: r.action for r in pairs.groupBy("task_id").agg(F.min_by("action", F.struct("skill", "_no")).alias("action")).collect()}
    got = {r.task_id: r.decision for r in S.route_tasks(tasks, skills).filter("completed").collect()}
    assert got == want and len(set(got.values())) > 10


def test_gate_canary(spark):
    poor = spark.createDataFrame([("recall_at_10", 0.1), ("mrr", 0.0)], "metric string, value double")
    row = E.gate(poor, "blocking").collect()[0]
    assert not row.passed and row.failures == ["recall_at_10 0.1000 < threshold 0.8500"]
    assert E.gate(poor, "advisory").collect()[0].passed


def test_old_steps_are_read_once_a_pair(spark):
    """The words of the old steps are bound outside of the step over the new ones."""
    from lodestone.operators import versions as VR

    step = lambda i, who: (i, f"sign the form {i}", who, [], None)
    rows = spark.createDataFrame([([step(1, "a"), step(2, "a")], [step(1, "b"), step(2, "a")])], f"old_steps {VR.STEPS}, new_steps {VR.STEPS}").repartition(2)
    judged = VR.contradictions(rows).select("summary")
    assert "array(transform(old_steps" in judged._jdf.queryExecution().optimizedPlan().toString()
    assert [r.summary for r in judged.collect()] == ["actor: 'a' -> 'b'"]
