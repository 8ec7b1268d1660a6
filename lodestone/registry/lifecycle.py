"""Queries over change detection, versions, freshness and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions import ids
from lodestone.operators import changes as C
from lodestone.operators import freshness as FR
from lodestone.operators import process as P
from lodestone.operators import serving as S
from lodestone.operators import versions as VR
from lodestone.operators.artifacts import canonical
from lodestone.operators.chunking import chunk_artifacts
from lodestone.operators.process_metrics import actor_accuracy, step_precision_recall
from lodestone.registry import views as V
from lodestone.registry.knowledge import ACTIONS, SENT_SQL
from lodestone.session import cut_lineage

QUERIES, SQL = {}, {}


def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


SUFFIX = " The the der line was added."


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def second(spark, sf):
    """The next crawl: low-quality documents are absent, toxic ones changed."""
    labels = V.table(spark, sf, "labels")
    docs = V.documents(spark, sf).join(labels, "doc_id", "left").filter("coalesce(quality, 1) = 1")
    docs = docs.withColumn("text", F.when(F.col("toxic") == 1, F.concat("text", F.lit(SUFFIX))).otherwise(F.col("text")))
    return V._artifacts(docs, F.col("source"), V._by_lang("notion", "file", "gmail", "linear"))


SECOND_SQL = f"""
next AS (SELECT a.tenant_id, a.source_kind, a.external_id, a.artifact_id,
   'sha256:' || sha256(CASE WHEN l.toxic = 1 THEN content || '{SUFFIX}' ELSE content END) AS new_hash, a.content_hash AS old_hash
   FROM artifacts a LEFT JOIN labels l ON 'doc:' || l.doc_id = a.external_id WHERE coalesce(l.quality, 1) = 1)"""


@query(
    "cdc_01_changes",
    f"WITH {V.ARTIFACTS_SQL}, {SECOND_SQL} SELECT external_id, CASE WHEN new_hash = old_hash THEN 'skip' ELSE 'change' END AS change FROM next",
)
def detect(spark, sf):
    return C.detect_changes(second(spark, sf), V.artifacts(spark, sf)).select("external_id", "change")


@query(
    "cdc_01_stats",
    f"""WITH {V.ARTIFACTS_SQL}, {SECOND_SQL},
    sized AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text || CASE WHEN toxic = 1 THEN '{SUFFIX}' ELSE '' END, '\\s+'), lambda w: w <> '')) AS n FROM documents LEFT JOIN labels USING (doc_id)),
    cut AS (SELECT 'doc:' || doc_id AS external_id, CASE WHEN n = 0 THEN 0 WHEN n <= 200 THEN 1 ELSE 1 + CAST(ceil((n - 200) / 160.0) AS BIGINT) END AS n_chunks FROM sized)
    SELECT tenant_id, source_kind, count(*) FILTER (new_hash <> old_hash)::BIGINT AS artifacts, count(*) FILTER (new_hash = old_hash)::BIGINT AS skipped,
      coalesce(sum(n_chunks) FILTER (new_hash <> old_hash), 0)::BIGINT AS chunks FROM next JOIN cut USING (external_id) GROUP BY 1, 2""",
)
def stats(spark, sf):
    diff = C.detect_changes(second(spark, sf), V.artifacts(spark, sf))
    moved = diff.filter("change <> 'skip'")
    return C.ingest_stats(diff, chunk_artifacts(moved)).select("tenant_id", "source_kind", "artifacts", "skipped", "chunks")


@query(
    "cdc_02_cascade",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL}, {SECOND_SQL} SELECT chunk_id FROM chunks WHERE artifact_id NOT IN (SELECT artifact_id FROM next WHERE new_hash <> old_hash)""",
)
def cascade(spark, sf):
    diff = C.detect_changes(second(spark, sf), V.artifacts(spark, sf)).filter("change = 'change'")
    gone = diff.select(F.col("replaces").alias("artifact_id"))
    return C.without_artifacts(V.chunks(spark, sf), gone).select("chunk_id")


@query(
    "cdc_02_provenance",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL}, {SECOND_SQL}, x AS (SELECT artifact_id FROM next WHERE new_hash <> old_hash)
    SELECT artifact_id, count(*)::BIGINT AS edges, count(*) FILTER (artifact_id NOT IN (SELECT artifact_id FROM x))::BIGINT AS sourced FROM chunks GROUP BY 1""",
)
def provenance(spark, sf):
    chunks = V.chunks(spark, sf)
    diff = C.detect_changes(second(spark, sf), V.artifacts(spark, sf)).filter("change = 'change'")
    gone = chunks.join(diff.select(F.col("replaces").alias("artifact_id")), "artifact_id", "left_semi")
    edges = chunks.select("artifact_id", F.col("chunk_id").alias("source_chunk_id"))
    return C.forget_provenance(edges, gone).groupBy("artifact_id").agg(
        F.count("*").alias("edges"), F.count("source_chunk_id").alias("sourced")
    )


@query(
    "cdc_03_disconnect",
    f"WITH {V.ARTIFACTS_SQL} SELECT artifact_id FROM artifacts WHERE NOT (tenant_id = 'src4' AND source_kind = 'notion')",
)
def disconnect(spark, sf):
    return C.without_source(V.artifacts(spark, sf), "src4", "notion").select("artifact_id")


@query(
    "src_12_vector_upsert",
    f"""WITH {V.ARTIFACTS_SQL}, {SECOND_SQL} SELECT artifact_id AS vector_id, coalesce(new_hash, content_hash) AS content_hash FROM artifacts LEFT JOIN next USING (artifact_id)""",
)
def vector_upsert(spark, sf):
    cols = [F.col("artifact_id").alias("vector_id"), "content_hash"]
    return C.upsert(V.artifacts(spark, sf).select(*cols), second(spark, sf).select(*cols))


SOURCES_SQL = """
src AS (SELECT user_id % 20 AS tenant_id, event_type AS kind, event_id AS source_id, ts AS created_at FROM events),
kept AS (SELECT tenant_id, kind, min_by(source_id, (created_at, source_id)) AS kept_id FROM src GROUP BY 1, 2)"""


def sources(spark, sf):
    """Every event as a source registration, so that most are duplicates."""
    return V.table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("tenant_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("source_id"), F.col("ts").alias("created_at")
    )


@query("src_14_dedupe_sources", f"WITH {SOURCES_SQL} SELECT source_id, kept_id FROM src JOIN kept USING (tenant_id, kind)")
def dedupe_sources(spark, sf):
    every = sources(spark, sf)
    pointing = every.select("source_id", F.col("source_id").alias("was"))
    _, moved = C.dedupe_sources(every, pointing)
    return moved.select(F.col("was").alias("source_id"), F.col("source_id").alias("kept_id"))


@query("srv_07_list_sources", f"WITH {SOURCES_SQL} SELECT kept_id AS source_id, kind FROM kept WHERE tenant_id = 3")
def list_sources(spark, sf):
    kept, _ = C.dedupe_sources(sources(spark, sf), sources(spark, sf).limit(0).select("source_id"))
    return C.list_sources(kept.withColumn("tenant_id", F.col("tenant_id").cast("string")), "3").select("source_id", "kind")


# --- versions ------------------------------------------------------------------


def extracted(chunks):
    made = P.assemble(P.synthesize_steps(chunks, ACTIONS))
    return made.withColumnRenamed("artifact_id", "seq")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


FRESHNESS = "tenant_id string, object_type string, object_id string, state string, reason string, last_validated_at timestamp, ttl_seconds bigint"


def first_state(spark, sf):
    made = cut_lineage(extracted(V.chunks(spark, sf)))
    heads, versions, updates = VR.save_processes(empty(spark, VR.HEADS), empty(spark, VR.VERSIONS), made)
    return heads, versions, FR.set_freshness(empty(spark, FRESHNESS), updates, now())


def stored_state(spark, sf):
    """The first state as tables, as a deployment holds it between batches."""
    return V._once(spark, ("first state", sf), lambda: tuple(cut_lineage(table) for table in first_state(spark, sf)))


PROC_SQL = rf"""{SENT_SQL},
heads_v AS (SELECT artifact_id, array_to_string(hw[1:12], ' ') || CASE WHEN len(hw) > 12 THEN '…' ELSE '' END AS name
  FROM (SELECT artifact_id, list_filter(regexp_split_to_array(regexp_replace(
           coalesce(list_filter(regexp_split_to_array(content, '\r\n|\n|\r'), lambda l: trim(l, chr(32) || chr(9)) <> '')[1], ''),
           '^\s*#+', ''), '\s+'), lambda w: w <> '') AS hw FROM artifacts)),
procs AS (SELECT s.tenant_id, h.name, artifact_id, count(*) AS n_steps, md5(s.tenant_id || '|' || replace(replace(h.name, '\', '\\'), '|', '\|')) AS process_id,
   row_number() OVER (PARTITION BY s.tenant_id, h.name ORDER BY artifact_id) AS version FROM steps s JOIN heads_v h USING (artifact_id) GROUP BY 1, 2, 3),
heads AS (SELECT tenant_id, name, process_id, max(version) AS current_version, CASE WHEN max(version) = 1 THEN 'active' ELSE 'draft' END AS status,
   CASE WHEN max(version) = 1 THEN 'fresh' ELSE 'stale' END AS freshness, max_by(artifact_id, version) AS artifact_id FROM procs GROUP BY 1, 2, 3)"""

AFTER_SQL = rf"""{PROC_SQL}, {SECOND_SQL},
moved AS (SELECT p.process_id, p.artifact_id FROM procs p JOIN next n USING (artifact_id) WHERE n.new_hash <> n.old_hash),
after AS (SELECT h.process_id, h.current_version + (SELECT count(*) FROM moved m WHERE m.process_id = h.process_id) AS current_version, h.status, h.freshness FROM heads h)"""


@query("ver_01_new_processes", f"WITH {PROC_SQL} SELECT process_id, name, current_version, status FROM heads")
def new_processes(spark, sf):
    return first_state(spark, sf)[0].select("process_id", "name", "current_version", "status")


@query(
    "ver_03_version_rows",
    f"""WITH {PROC_SQL} SELECT p.process_id, p.version, s.ordinal, md5(s.s) AS action, s.chunk_id FROM procs p JOIN steps s USING (artifact_id)""",
)
def version_rows(spark, sf):
    rows = VR.version_rows(first_state(spark, sf)[1])
    return rows.select("process_id", "version", "ordinal", F.md5("action").alias("action"), "chunk_id")


@query("ver_04_contradictions")
def contradictions(spark, sf):
    """Versions whose steps name another actor than the version before; actor = cited language."""
    made = P.assemble(
        P.synthesize_steps(V.chunks(spark, sf), ACTIONS).withColumn("actor", F.substring("artifact_id", 1, 1))
    ).withColumnRenamed("artifact_id", "seq")
    _, versions, _ = VR.save_processes(empty(spark, VR.HEADS), empty(spark, VR.VERSIONS), made)
    return versions.groupBy(F.col("review_reason").isNotNull().alias("contradicts")).agg(F.count("*").alias("n"))


def decisions(heads):
    """Approve drafts with a long name, reject the other drafts."""
    drafts = heads.filter("status = 'draft'")
    return drafts.select(
        "tenant_id", "process_id", F.when(F.length("name") > 60, "approve").otherwise("reject").alias("action"), F.lit(1).alias("seq")
    )


@query(
    "ver_05_review",
    f"""WITH {PROC_SQL} SELECT process_id, CASE WHEN status = 'active' OR len(name) > 60 THEN 'active' ELSE 'deprecated' END AS status,
      CASE WHEN status <> 'active' AND len(name) > 60 THEN 'fresh' END AS freshness, false AS unknown FROM heads
    UNION ALL SELECT 'no ' || process_id, NULL, NULL, true FROM heads WHERE status <> 'active'""",
)
def review(spark, sf):
    """The status of every process, how fresh an approval made it, and the decisions about processes that are not there."""
    heads = stored_state(spark, sf)[0]
    made = decisions(heads)
    lost = made.withColumn("process_id", F.concat(F.lit("no "), "process_id"))
    reviewed, updates, unknown = VR.review(heads, made.unionByName(lost))
    fresh = updates.select("tenant_id", F.col("object_id").alias("process_id"), F.col("state").alias("freshness"))
    known = reviewed.join(fresh, ["tenant_id", "process_id"], "left").select("process_id", "status", "freshness", F.lit(False).alias("unknown"))
    none = F.lit(None).cast("string")
    return known.unionByName(unknown.select("process_id", none.alias("status"), none.alias("freshness"), F.lit(True).alias("unknown")))


@query("ver_06_history", f"WITH {PROC_SQL} SELECT process_id, version, n_steps FROM procs WHERE tenant_id = 'src2'")
def history(spark, sf):
    versions = first_state(spark, sf)[1]
    return ids.scoped(versions, "src2").orderBy("process_id", F.desc("version")).select("process_id", "version", F.size("steps").cast("long").alias("n_steps"))


@query("frs_01_set", f"WITH {PROC_SQL} SELECT process_id AS object_id, freshness AS state, 7776000::BIGINT AS ttl_seconds FROM heads")
def set_freshness(spark, sf):
    return first_state(spark, sf)[2].select("object_id", "state", "ttl_seconds")


@query(
    "frs_02_map",
    f"WITH {PROC_SQL} SELECT artifact_id, coalesce(h.freshness, 'fresh') AS freshness FROM artifacts a LEFT JOIN (SELECT artifact_id, freshness FROM heads WHERE freshness = 'stale') h USING (artifact_id)",
)
def freshness_map(spark, sf):
    """Artifacts labelled through the stale processes last extracted from them."""
    _, versions, fresh = first_state(spark, sf)
    latest = extracted(V.chunks(spark, sf)).groupBy("tenant_id", VR.process_id().alias("object_id")).agg(F.max("seq").alias("artifact_id"))
    known = fresh.filter("state = 'stale'").join(latest, ["tenant_id", "object_id"]).select("tenant_id", "object_type", F.col("artifact_id").alias("object_id"), "state")
    return FR.with_freshness(V.artifacts(spark, sf), known, "process", "artifact_id").select("artifact_id", "freshness")


@query("frs_03_citing", f"WITH {AFTER_SQL} SELECT DISTINCT process_id FROM moved")
def citing(spark, sf):
    versions = first_state(spark, sf)[1]
    diff = C.detect_changes(second(spark, sf), V.artifacts(spark, sf)).filter("change = 'change'")
    return FR.citing_processes(versions, V.chunks(spark, sf), diff.select(F.col("replaces").alias("artifact_id"))).select("process_id").distinct()


def tracked(spark, sf):
    return V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("tenant_id"), F.lit("event").alias("object_type"), F.col("event_id").alias("object_id"),
        F.when(F.col("event_type") == "error", "expired").when(F.col("event_type") == "view", "stale").otherwise("fresh").alias("state"),
        F.col("ts").alias("last_validated_at"),
        F.when(F.col("event_type") != "click", 86400 * (1 + F.col("event_id") % 30)).alias("ttl_seconds"),
    )


@query(
    "frs_04_sweep",
    """WITH f AS (SELECT event_id AS object_id, CASE event_type WHEN 'error' THEN 'expired' WHEN 'view' THEN 'stale' ELSE 'fresh' END AS state, ts,
      CASE WHEN event_type <> 'click' THEN 86400 * (1 + event_id % 30) END AS ttl FROM events)
    SELECT object_id, CASE WHEN state <> 'expired' AND ttl IS NOT NULL AND ts + ttl * INTERVAL 1 SECOND < TIMESTAMP '2024-01-20' THEN 'expired' ELSE state END AS state FROM f""",
)
def sweep(spark, sf):
    return FR.ttl_sweep(tracked(spark, sf), F.lit("2024-01-20 00:00:00").cast("timestamp")).select("object_id", "state")


# --- serving -------------------------------------------------------------------


@query("srv_01_list", f"WITH {PROC_SQL} SELECT name, status, freshness FROM heads WHERE tenant_id = 'src1' AND status = 'active' AND name ILIKE '%e_a%'")
def listing(spark, sf):
    heads, _, fresh = first_state(spark, sf)
    return S.process_list(heads, fresh, "src1", "active", "e_a").select("name", "status", "freshness")


@query(
    "srv_02_bodies",
    f"WITH {PROC_SQL} SELECT h.process_id, h.current_version, h.status, h.freshness, p.n_steps FROM heads h JOIN procs p ON p.process_id = h.process_id AND p.version = h.current_version",
)
def bodies(spark, sf):
    rows = S.process_bodies(*stored_state(spark, sf))
    return rows.select("process_id", "current_version", "status", "freshness", F.size("steps").cast("long").alias("n_steps"))


def tenant_queries(spark, sf):
    """Every benchmark passage asked of every tenant."""
    tenants = V.documents(spark, sf).groupBy().agg(F.collect_set("source").alias("tenants"))
    return V.queries(spark, sf).drop("tenant_id").join(F.broadcast(tenants)).select("query_id", "query", F.explode("tenants").alias("tenant_id"))


MATCH_SQL = rf"""{PROC_SQL},
q AS (SELECT item_id AS query_id, tenant_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: len(t) > 2)) AS qt FROM benchmark, (SELECT DISTINCT source AS tenant_id FROM documents)),
m AS (SELECT q.query_id, q.tenant_id, h.process_id, h.name, h.artifact_id,
   len(list_intersect(qt, list_distinct(list_filter(regexp_extract_all(lower(h.name || ' Relevant when handling: ' || h.name), '[a-z0-9$]+'), lambda t: len(t) > 2)))) AS overlap
   FROM q JOIN heads h ON h.tenant_id = q.tenant_id AND h.status = 'active'),
best AS (SELECT * FROM m WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY query_id, tenant_id ORDER BY overlap DESC, name) = 1)"""


@query("srv_03_match", f"WITH {MATCH_SQL} SELECT query_id, tenant_id, process_id, overlap::BIGINT AS overlap FROM best")
def match(spark, sf):
    heads, _, _ = first_state(spark, sf)
    return S.match_processes(tenant_queries(spark, sf), heads).select("query_id", "tenant_id", "process_id", "overlap")


@query(
    "srv_04_ask",
    f"""WITH {MATCH_SQL}, a AS (SELECT artifact_id, md5(string_agg(s, chr(10) ORDER BY ordinal)) AS answer, count(*) AS n FROM steps GROUP BY 1)
    SELECT q.query_id, q.tenant_id, a.answer, a.n::BIGINT AS n_citations, 'process:' || b.process_id || '@v1' AS used
    FROM q LEFT JOIN best b USING (query_id, tenant_id) LEFT JOIN a USING (artifact_id)""",
)
def ask(spark, sf):
    """Every question; the answer of those grounded in a process, null where the hits answer."""
    from lodestone.plans.search import hybrid_search

    asked = tenant_queries(spark, sf)
    hits = hybrid_search(asked, V.tenant_chunks(spark, sf), 8, index=V.tenant_index(spark, sf))
    out = S.ask(asked, hits, S.process_bodies(*stored_state(spark, sf)))
    grounded = F.size("used_processes") > 0
    return out.select(
        "query_id", "tenant_id", F.when(grounded, F.md5("answer")).alias("answer"), F.when(grounded, F.size("citations")).cast("long").alias("n_citations"), F.get("used_processes", F.lit(0)).alias("used")
    )


@query(
    "srv_05_skills",
    f"WITH {PROC_SQL} SELECT h.tenant_id, h.name, h.current_version AS version, h.freshness, p.n_steps FROM heads h JOIN procs p ON p.process_id = h.process_id AND p.version = h.current_version",
)
def skills(spark, sf):
    rows = S.skills(S.process_bodies(*stored_state(spark, sf)), include_stale=True)
    return rows.select("tenant_id", "name", "version", "freshness", F.size("steps").cast("long").alias("n_steps"))


@query(
    "srv_05_manifest",
    f"""WITH {PROC_SQL} SELECT tenant_id, count(*) FILTER (freshness = 'fresh')::BIGINT AS fresh, count(*) FILTER (freshness = 'stale')::BIGINT AS stale, 0::BIGINT AS expired FROM heads GROUP BY 1""",
)
def manifest(spark, sf):
    return S.freshness_manifest(S.process_bodies(*stored_state(spark, sf)))


def priced_skills(spark, sf):
    """Skills whose steps state a limit: customers by nation, limits from their balances."""
    rows = V.table(spark, sf, "customer")
    amount = F.floor(F.abs("c_acctbal")).cast("string")
    action = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Refund over $").otherwise("Refund up to $"), amount)
    steps = F.array(F.struct(action.alias("action"), F.lit(None).cast("string").alias("actor"), F.lit(None).cast("string").alias("decision"),
                             F.array(F.struct(F.col("c_name").alias("chunk_id"), F.lit(None).cast("string").alias("quote"))).alias("citations")))
    return rows.select(F.col("c_nationkey").cast("string").alias("tenant_id"), F.concat(F.lit("refund "), "c_name").alias("name"), F.lit("t").alias("trigger"), steps.alias("steps"))


ROUTE_SQL = """
sk AS (SELECT c_nationkey::VARCHAR AS tenant_id, 'refund ' || c_name AS name, floor(abs(c_acctbal)) AS lim, c_custkey % 2 = 0 AS over,
   CASE WHEN c_custkey % 2 = 0 THEN 'Refund over $' ELSE 'Refund up to $' END || floor(abs(c_acctbal))::BIGINT AS action FROM customer),
tk AS (SELECT s_suppkey AS task_id, s_nationkey::VARCHAR AS tenant_id, s_acctbal::DOUBLE AS amount FROM supplier),
r AS (SELECT tk.task_id, min_by(action, name) AS decision FROM tk JOIN sk ON sk.tenant_id = tk.tenant_id AND CASE WHEN over THEN amount > lim ELSE amount <= lim END GROUP BY 1)"""


def tasks(spark, sf):
    return V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("task_id"), F.col("s_nationkey").cast("string").alias("tenant_id"), F.lit("refund").alias("type"), F.col("s_acctbal").cast("double").alias("amount_usd")
    )


@query("srv_06_route", f"WITH {ROUTE_SQL} SELECT task_id, decision, decision IS NOT NULL AS completed FROM tk LEFT JOIN r USING (task_id)")
def route(spark, sf):
    return S.route_tasks(tasks(spark, sf), priced_skills(spark, sf)).select("task_id", "decision", "completed")


@query("srv_08_grounded", f"WITH {ROUTE_SQL} SELECT TRUE AS grounded, count(decision)::BIGINT AS actions FROM tk LEFT JOIN r USING (task_id)")
def grounded(spark, sf):
    return S.grounded(S.route_tasks(tasks(spark, sf), priced_skills(spark, sf)))


# --- process evaluation ----------------------------------------------------------


def golden(spark, sf):
    """Each passage's sentences as expected steps, asked of every tenant; the needle is its longest word."""
    words = F.regexp_extract_all(F.lower("query"), F.lit("[a-z]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return tenant_queries(spark, sf).select(
        F.concat_ws("|", "query_id", "tenant_id").alias("golden_id"), "tenant_id", F.substring(longest, 1, 4).alias("name_contains"),
        F.regexp_extract_all("query", F.lit("[^.]+"), F.lit(0)).alias("steps"), F.array(F.lit("that")).alias("actors"),
    )


_STOP = "[" + ",".join(f"'{w}'" for w in fv.FAITH_STOPWORDS) + "]"
_SALIENT = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9$]+'), lambda t: len(t) > 1 AND NOT list_contains(" + _STOP + ", t)))"


@query(
    "evl_10_step_precision_recall",
    rf"""WITH {PROC_SQL},
    g AS (SELECT item_id, tenant_id, regexp_extract_all(text, '[^.]+') AS said,
      left(list_max(list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: {{'n': len(w), 'w': w}})).w, 4) AS needle FROM benchmark, (SELECT DISTINCT source AS tenant_id FROM documents)),
    pick AS (SELECT item_id, g.tenant_id, min_by(h.artifact_id, h.name) AS artifact_id FROM g JOIN heads h ON h.tenant_id = g.tenant_id AND contains(lower(h.name), g.needle) GROUP BY 1, 2),
    acts AS (SELECT artifact_id, list({_SALIENT.format("s")}) AS a FROM steps GROUP BY 1),
    pairs AS (SELECT list_transform(said, lambda p: {_SALIENT.format("p")}) AS p, coalesce(a, []) AS a FROM g LEFT JOIN pick USING (item_id, tenant_id) LEFT JOIN acts USING (artifact_id)),
    hits AS (SELECT len(p) AS gt, len(a) AS et,
      len(list_filter(p, lambda x: len(list_filter(a, lambda y: len(x) = 0 OR len(list_intersect(x, y)) / len(x) >= {fv.MATCH_THRESHOLD})) > 0)) AS gh,
      len(list_filter(a, lambda x: len(list_filter(p, lambda y: len(y) = 0 OR len(list_intersect(y, x)) / len(y) >= {fv.MATCH_THRESHOLD})) > 0)) AS eh FROM pairs)
    SELECT round(sum(eh) / sum(et), 6) AS precision, round(sum(gh) / sum(gt), 6) AS recall, sum(et)::BIGINT AS n_steps FROM hits""",
)
def precision_recall(spark, sf):
    bodies_now = S.process_bodies(*stored_state(spark, sf))
    rates = step_precision_recall(golden(spark, sf), bodies_now)
    return rates.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.col("et").cast("long").alias("n_steps"))


@query("evl_11_actor_accuracy")
def actors(spark, sf):
    from lodestone.operators import graph as G
    from lodestone.registry import knowledge as K

    known, _ = G.resolve_entities(K.cands(spark, sf), "artifact", K.SYNONYMS)
    steps = P.detect_actors(K.steps(spark, sf).withColumn("actor", F.lit(None).cast("string")), known)
    return actor_accuracy(golden(spark, sf), P.assemble(steps))


@query("evl_13_process_run", f"WITH {PROC_SQL} SELECT count(*)::BIGINT AS n_processes, sum(n_steps)::BIGINT AS n_steps, 1.0::DOUBLE AS validity FROM heads h JOIN procs p ON p.process_id = h.process_id AND p.version = h.current_version")
def process_run(spark, sf):
    """Citation validity of the stored bodies, with their counts."""
    from lodestone.operators.process_metrics import citation_validity

    rows = S.process_bodies(*stored_state(spark, sf))
    steps = rows.select("tenant_id", F.col("process_id").alias("artifact_id"), F.explode("steps").alias("s")).select("tenant_id", "artifact_id", "s.ordinal", "s.action", "s.citations")
    rate = citation_validity(steps, V.chunks(spark, sf))
    return rate.join(rows.agg(F.count("*").alias("n_processes")), F.lit(True)).select("n_processes", "n_steps", "validity")
