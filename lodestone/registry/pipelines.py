"""Queries over raw exports, training data, flow control and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import times
from lodestone.functions import text as X
from lodestone.operators import flow as FL
from lodestone.operators import replies as R
from lodestone.operators import training as TR
from lodestone.operators import serving as SV
from lodestone.registry import retrieval as RT
from lodestone.registry import views as V
from lodestone.session import cut_lineage, shared_dir
from lodestone.sources import incremental as I
from lodestone.sources import fixtures as FX
from lodestone.sources import normalize as N
from lodestone.sources import sinks
from lodestone.streaming import ingest as G
from lodestone.streaming import jobs as J

QUERIES, SQL = {}, {}


def fresh_path(spark, name):
    """A new path in the shared folder, for what a query writes and reads back."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def stamp():
    return F.date_format(F.timestamp_seconds(F.lit(V.EPOCH) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


_STRIPPED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _body_sql(title: str, text: str) -> str:
    return _STRIPPED.format(f"{title} || chr(10) || chr(10) || {text}")


CODE_SQL = f"""
host AS (
  SELECT doc_id, 'file:docs/' || doc_id || '.md' AS external_id, 'doc' AS kind, {_STRIPPED.format('text')} AS content FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 'issue:' || doc_id, 'issue', {_body_sql('source', 'text')} FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 'pr:' || doc_id, 'pr', {_body_sql('source', 'text')} FROM documents WHERE lang = 'de')"""


@query("src_02_code_host", f"WITH {CODE_SQL} SELECT external_id, kind, md5(content) AS content, 1704067200 + doc_id AS created_s FROM host WHERE content <> ''")
def code_host(spark, sf):
    """French documents as markdown blobs, English as issues, German as pull requests."""
    docs = V.documents(spark, sf).withColumns({"tenant_id": F.lit("t0"), "created_at": stamp()})
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    blobs = docs.filter("lang IN ('fr', 'es')").select(
        "tenant_id", F.when(F.col("lang") == "fr", F.concat(name, F.lit(".md"))).otherwise(F.concat(name, F.lit(".txt"))).alias("path"),
        F.lit("blob").alias("type"), F.base64(F.col("text").cast("binary")).alias("content"), "created_at",
    )
    numbered = ["tenant_id", F.col("doc_id").alias("number"), F.col("source").alias("title"), F.col("text").alias("body"), "created_at"]
    issues = docs.filter("lang IN ('en', 'de')").select(*numbered, F.when(F.col("lang") == "de", "yes").alias("pull_request"))
    pulls = docs.filter("lang = 'de'").select(*numbered)
    out = N.normalize("github", {"repo": "a/b"}, blobs=blobs, issues=issues, pulls=pulls)
    return out.select("external_id", "kind", F.md5("content").alias("content"), F.unix_timestamp("created_at").alias("created_s"))


@query("src_01_dispatch", f"WITH {CODE_SQL} SELECT kind, count(*)::BIGINT AS n FROM host WHERE content <> '' GROUP BY 1")
def dispatch(spark, sf):
    return code_host(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "src_03_chat",
    """SELECT 'slack:c' || conv_id || ':' || (1704067200 + turn) || '.000100' AS external_id, md5(text) AS content, 1704067200 + turn AS created_s
    FROM conversations WHERE role <> 'system' AND text <> ''""",
)
def chat(spark, sf):
    said = F.struct(
        F.concat((F.lit(V.EPOCH) + F.col("turn")).cast("string"), F.lit(".000100")).alias("ts"), "text",
        F.when(F.col("role") == "system", "channel_join").alias("subtype"),
    )
    channels = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(said).alias("messages"))
    channels = channels.select(F.lit("t0").alias("tenant_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("channel"), "messages")
    out = N.normalize("slack", channels=channels)
    return out.select("external_id", F.md5("content").alias("content"), F.unix_timestamp("created_at").alias("created_s"))


@query(
    "src_04_mail",
    f"""SELECT 'gmail:' || doc_id AS external_id, md5({_STRIPPED.format("source || chr(10) || chr(10) || text || chr(10) || lang")}) AS content, 1704067200 + doc_id AS created_s FROM documents""",
)
def mail(spark, sf):
    """Nested multipart mails: two plain parts at different depths and an html one."""
    def part(mime, data):
        coded = F.translate(F.regexp_replace(F.base64(data.cast("binary")), r"\s", ""), "+/", "-_")
        return F.struct(F.lit(mime).alias("mimeType"), F.struct(coded.alias("data")).alias("body"))

    inner = F.struct(F.lit("multipart/alternative").alias("mimeType"), F.array(part("text/plain", F.col("text")), part("text/html", F.lit("<p>no</p>"))).alias("parts"))
    tree = F.to_json(
        F.struct(
            F.lit("multipart/mixed").alias("mimeType"),
            F.array(F.to_json(inner), F.to_json(part("text/plain", F.col("lang")))).alias("parts"),
        )
    )
    payload = F.regexp_replace(F.regexp_replace(F.replace(tree, F.lit('\\"'), F.lit('"')), r'"\{', "{"), r'\}"', "}")
    messages = V.documents(spark, sf).select(
        F.lit("t0").alias("tenant_id"), F.col("doc_id").cast("string").alias("id"), ((F.lit(V.EPOCH) + F.col("doc_id")) * 1000).cast("string").alias("internalDate"),
        F.array(F.struct(F.lit("From").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("SUBJECT").alias("name"), F.col("source").alias("value"))).alias("headers"),
        payload.alias("payload"),
    )
    out = N.normalize("gmail", messages=messages)
    return out.select("external_id", F.md5("content").alias("content"), F.unix_timestamp("created_at").alias("created_s"))


@query(
    "src_05_tracker",
    f"""SELECT 'linear:' || CASE WHEN quality = 1 THEN 'Q-' || doc_id ELSE doc_id::VARCHAR END AS external_id, md5({_body_sql('source', 'text')}) AS content FROM documents LEFT JOIN labels USING (doc_id)""",
)
def tracker(spark, sf):
    docs = V.documents(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
    nodes = docs.select(
        F.lit("t0").alias("tenant_id"), F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Q-"), F.col("doc_id").cast("string"))).alias("identifier"),
        F.col("source").alias("title"), F.col("text").alias("description"), stamp().alias("createdAt"),
    )
    return N.normalize("linear", nodes=nodes).select("external_id", F.md5("content").alias("content"))


@query(
    "src_06_wiki",
    rf"""WITH b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'system' AND text <> '') AS body FROM conversations GROUP BY 1)
    SELECT 'page:' || conv_id AS external_id, md5({_body_sql("'Conversation ' || conv_id", "coalesce(body, '')")}) AS content FROM b""",
)
def wiki(spark, sf):
    turns = V.table(spark, sf, "conversations").withColumn("tenant_id", F.lit("t0"))
    blocks = turns.select(
        "tenant_id", F.col("conv_id").cast("string").alias("page_id"), F.col("turn").alias("pos"),
        F.when(F.col("role") == "system", "image").otherwise("paragraph").alias("type"), F.array(F.struct(F.col("text").alias("plain_text"))).alias("rich_text"),
    )
    title = F.array(F.struct(F.lit("Conversation ").alias("plain_text")), F.struct(F.col("id").alias("plain_text")))
    props = F.create_map(
        F.lit("tags"), F.struct(F.lit("select").alias("type"), F.slice(title, 1, 0).alias("title")),
        F.lit("name"), F.struct(F.lit("title").alias("type"), title.alias("title")),
    )
    pages = turns.select("tenant_id", F.col("conv_id").cast("string").alias("id")).distinct().withColumns({"properties": props, "created_time": F.lit("2024-01-01T00:00:00Z")})
    return N.normalize("notion", pages=pages, blocks=blocks).select("external_id", F.md5("content").alias("content"))


@query(
    "src_07_poll",
    """WITH c AS (SELECT user_id, min(ts) AS since FROM events WHERE event_type = 'purchase' GROUP BY 1 UNION ALL SELECT -1, TIMESTAMP '2024-01-01')
    SELECT event_id, user_id, NULL::BIGINT AS since FROM events LEFT JOIN c USING (user_id) WHERE since IS NULL OR ts >= since
    UNION ALL SELECT NULL, user_id, 1704067200 FROM (SELECT user_id FROM events UNION SELECT user_id FROM c)""",
)
def poll(spark, sf):
    """Events at or past each user's first purchase, and the next cursors; one cursor's user brings nothing."""
    events = V.table(spark, sf, "events")
    cursors = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("since"))
    idle = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.timestamp_seconds(F.lit(V.EPOCH)).alias("since"))
    fresh, after = I.poll(events, cursors.unionByName(idle), ["user_id"], "ts", F.timestamp_seconds(F.lit(V.EPOCH)))
    none = F.lit(None).cast("long")
    return fresh.select("event_id", "user_id", none.alias("since")).unionByName(after.select(none.alias("event_id"), "user_id", F.unix_timestamp("since").alias("since")))


@query(
    "src_08_change_events",
    r"""SELECT doc_id, 'doc' AS kind, md5(text) AS content, true AS accepted FROM documents WHERE doc_id % 7 > 1
    UNION ALL SELECT doc_id, 'doc', md5(CASE doc_id % 7 WHEN 0 THEN ' ' || chr(10) ELSE text END), false FROM documents WHERE doc_id % 7 <= 1""",
)
def change_events(spark, sf):
    """Documents as events with their whole text; some have a blank text, others a blank id."""
    seventh = F.col("doc_id") % 7
    rows = V.documents(spark, sf).select(
        "doc_id", F.lit("file").alias("source_kind"), F.when(seventh == 1, "\t").otherwise(F.col("doc_id").cast("string")).alias("external_id"),
        F.lit(None).cast("string").alias("kind"), F.when(seventh == 0, " \n").otherwise(F.col("text")).alias("content"),
    )
    good, bad = I.valid_events(rows)
    seen = lambda part, ok: part.select("doc_id", "kind", F.md5("content").alias("content"), F.lit(ok).alias("accepted"))
    return seen(good, True).unionByName(seen(bad, False))


@query(
    "prj_09_timestamps",
    "SELECT doc_id, 1704067200 + doc_id AS iso_s, 1704067200 + doc_id AS sec_s, 1704067200 + doc_id AS ms_s, 0::BIGINT AS bad_s FROM documents",
)
def timestamps(spark, sf):
    run = F.timestamp_seconds(F.lit(0))
    at = F.lit(V.EPOCH) + F.col("doc_id")
    return V.documents(spark, sf).select(
        "doc_id",
        F.unix_timestamp(times.iso(stamp(), run)).alias("iso_s"),
        F.unix_timestamp(times.epoch_seconds(F.concat(at.cast("string"), F.lit(".25")), run)).alias("sec_s"),
        F.unix_timestamp(times.epoch_millis((at * 1000).cast("string"), run)).alias("ms_s"),
        F.unix_timestamp(times.iso("source", run)).alias("bad_s"),
    )


@query(
    "prj_10_replies",
    """SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS type FROM customer WHERE c_custkey % 5 <> 0""",
)
def replies(spark, sf):
    """Customers as model replies: fenced prose around JSON, aliased keys, broken ones."""
    c = V.table(spark, sf, "customer")
    even, odd = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 5 == 0
    full = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))).alias("entities")))
    alias = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("entity"))).alias("entities"))), F.lit("\n```"))
    reply = F.when(odd, F.concat(full, F.lit("}{"))).when(even, full).otherwise(alias)
    return R.reply_entities(c.withColumn("reply", reply), ["c_custkey"]).select("c_custkey", "name", "type")


@query(
    "prj_10_reply_relations",
    """SELECT c_custkey, c_name AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'buys' ELSE 'likes' END AS predicate, c_mktsegment AS object FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0""",
)
def reply_relations(spark, sf):
    """Customers as relations in model replies: aliased keys, a missing object, broken JSON."""
    c = V.table(spark, sf, "customer")
    target = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment"))
    plain = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("subject"), F.lit("buys").alias("predicate"), target.alias("object"))).alias("relations")))
    alias = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("source"), F.lit("likes").alias("relation"), target.alias("target"))).alias("relations"))), F.lit("\n```"))
    reply = F.when(F.col("c_custkey") % 5 == 0, F.concat(plain, F.lit("}{"))).when(F.col("c_custkey") % 2 == 0, plain).otherwise(alias)
    return R.reply_relations(c.withColumn("reply", reply), ["c_custkey"]).select("c_custkey", "subject", "predicate", "object")


# --- training data ---------------------------------------------------------------

_QSTOP = "[" + ",".join(f"'{w}'" for w in X.fv.QUERY_STOPWORDS) + "]"
# Distinct words in order of first use; a list of positions keeps the order.
SYNTH_SQL = rf"""{V.ARTIFACT_CHUNKS_SQL},
qw AS (SELECT chunk_id, tenant_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: len(t) > 2 AND NOT list_contains({_QSTOP}, t)) AS ws FROM chunks),
synth AS (SELECT chunk_id, tenant_id, array_to_string(list_filter(ws, lambda t, i: list_position(ws, t) = i)[1:6], ' ') AS query FROM qw WHERE len(ws) > 0)"""

TRIP_SQL = rf"""{SYNTH_SQL},
qs AS ({V.SLOTS_SQL.format(key='chunk_id', text='query', source='synth')}),
cs AS ({V.SLOTS_SQL.format(key='chunk_id', text='text', source='chunks')}),
qn AS (SELECT chunk_id, sum(value * value)::DOUBLE AS n FROM qs GROUP BY 1),
cn AS (SELECT chunk_id, sum(value * value)::DOUBLE AS n FROM cs GROUP BY 1),
dots AS (SELECT qs.chunk_id AS q, cs.chunk_id AS c, sum(qs.value * cs.value)::DOUBLE AS dot FROM qs JOIN cs USING (slot) JOIN synth s ON s.chunk_id = qs.chunk_id JOIN chunks k ON k.chunk_id = cs.chunk_id AND k.tenant_id = s.tenant_id GROUP BY 1, 2),
pairs AS (SELECT s.chunk_id AS q, k.chunk_id AS c, CASE WHEN qn.n * cn.n > 0 THEN coalesce(dot, 0) / sqrt(qn.n * cn.n) ELSE 0.0 END AS score
   FROM synth s JOIN chunks k ON k.tenant_id = s.tenant_id LEFT JOIN qn ON qn.chunk_id = s.chunk_id LEFT JOIN cn ON cn.chunk_id = k.chunk_id LEFT JOIN dots d ON d.q = s.chunk_id AND d.c = k.chunk_id),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM pairs QUALIFY rank <= 20),
negs AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM top WHERE q <> c QUALIFY n <= 3)"""


@query("ftd_01_synthetic", f"WITH {SYNTH_SQL} SELECT chunk_id, query FROM synth")
def synthetic(spark, sf):
    return TR.synthetic_queries(V.chunks(spark, sf)).select("chunk_id", "query")


def parts(spark, sf):
    vectors = V._once(spark, ("embedded chunks", sf), lambda: cut_lineage(V.embedded(V.chunks(spark, sf))))
    return vectors, TR.synthetic_queries(vectors)


@query("ftd_02_round_trip", f"WITH {TRIP_SQL} SELECT q AS chunk_id FROM top WHERE q = c AND rank <= 10")
def round_trip(spark, sf):
    vectors, pairs = parts(spark, sf)
    return TR.round_trip(pairs, vectors).select("chunk_id")


@query("ftd_03_hard_negatives", f"WITH {TRIP_SQL} SELECT q AS query_id, c AS chunk_id, n FROM negs")
def hard_negatives(spark, sf):
    vectors, pairs = parts(spark, sf)
    return TR.hard_negatives(pairs, pairs, vectors).select("query_id", "chunk_id", F.col("n").cast("long").alias("n"))


@query(
    "ftd_04_examples",
    f"""WITH {TRIP_SQL}, neg_texts AS (SELECT q, md5(string_agg(text, '|' ORDER BY n)) AS negatives FROM negs JOIN chunks ON chunks.chunk_id = c GROUP BY 1)
    SELECT s.chunk_id AS query_id, s.query, md5(k.text) AS positive, coalesce(negatives, md5('')) AS negatives FROM synth s JOIN chunks k USING (chunk_id) LEFT JOIN neg_texts t ON t.q = s.chunk_id""",
)
def examples(spark, sf):
    vectors, pairs = parts(spark, sf)
    out = TR.training_examples(pairs, pairs, TR.hard_negatives(pairs, pairs, vectors), vectors)
    return out.select("query_id", "query", F.md5("positive").alias("positive"), F.md5(F.array_join("negatives", "|")).alias("negatives"))


@query("ftd_05_prepare", f"WITH {TRIP_SQL} SELECT q AS query_id, q AS positive_id FROM top WHERE q = c AND rank <= 10")
def prepare(spark, sf):
    """The whole preparation with no golden pairs of its own."""
    vectors, pairs = parts(spark, sf)
    none = pairs.filter(F.lit(False))
    return TR.prepare(vectors, vectors, none, none).select("query_id", "positive_id")


@query("ftd_06_corpus_keys", f"WITH {V.ARTIFACT_CHUNKS_SQL} SELECT external_id || '#' || ordinal AS corpus_key, chunk_id FROM chunks")
def corpus_keys(spark, sf):
    return TR.corpus_keys(V.chunks(spark, sf)).select("corpus_key", "chunk_id")


# --- flow --------------------------------------------------------------------------


@query(
    "flw_01_token_bucket",
    """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT event_id, user_id, us, i, 3000000000000::BIGINT AS held, 2000000000000::BIGINT AS tokens FROM r WHERE i = 1
      UNION ALL
      SELECT event_id, user_id, us, i, held, CASE WHEN held >= 1000000000000 THEN held - 1000000000000 ELSE held END
      FROM (SELECT r.event_id, r.user_id, r.us, r.i, least(3000000000000, b.tokens + (r.us - b.us) * 10)::BIGINT AS held
            FROM b JOIN r ON r.user_id = b.user_id AND r.i = b.i + 1))
    SELECT event_id, held >= 1000000000000 AS allowed,
      round(CASE WHEN held >= 1000000000000 THEN 0.0 ELSE (1000000000000 - held) / 1e12 / 0.00001 END, 3) AS retry_after FROM b""",
)
def token_bucket(spark, sf):
    log = V.table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("key"), F.lit(1.0).alias("cost"))
    out = FL.admit(log, capacity=3, rate=0.00001)
    return out.select("event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


@query(
    "flw_02_rolling_usage",
    """WITH t AS (SELECT event_id, user_id, epoch_us(ts) AS us, len(props) // 4 + 100 AS tokens FROM events)
    SELECT event_id, sum(tokens) OVER w::BIGINT AS used, (sum(tokens) OVER w > 300 AND count(*) OVER w > 1) AS over_budget FROM t
    WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW)""",
)
def rolling_usage(spark, sf):
    log = V.table(spark, sf, "events").withColumn("out", F.lit(100)).withColumn("tokens", FL.estimated_tokens("props", "out"))
    out = FL.rolling_usage(log, 300, "user_id", "ts", "tokens", seconds=36_000)
    return out.select("event_id", "used", "over_budget")


@query(
    "flw_03_dead_letters",
    """SELECT user_id, count(*)::BIGINT AS tries, max(event_id)::BIGINT AS last_event FROM events WHERE event_type IN ('error') GROUP BY 1 HAVING count(*) >= 5""",
)
def dead_letters(spark, sf):
    """Failures per user as attempts of one job."""
    log = V.table(spark, sf, "events").filter("event_type = 'error'").withColumn("failed", F.lit(True))
    letters = FL.dead_letters(log, "user_id", "failed", "ts", "event_id", "props")
    return letters.select("user_id", "tries", F.col("payload").alias("last_event"))


@query(
    "flw_03_requeue",
    """WITH l AS (SELECT user_id, max(event_id)::BIGINT AS payload, max(ts) AS failed_at FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5)
    SELECT payload, row_number() OVER (ORDER BY failed_at, payload) <= 100 AS listed FROM l""",
)
def requeue(spark, sf):
    """The payloads of all dead letters to run again; listed are the hundred that failed first."""
    log = V.table(spark, sf, "events").filter("event_type = 'error'").withColumn("failed", F.lit(True))
    letters = FL.dead_letters(log, "user_id", "failed", "ts", "event_id", "props")
    again, _ = FL.requeue(letters)
    first = FL.list_dead_letters(letters).select("payload", F.lit(True).alias("listed"))
    return again.join(first, "payload", "left").select("payload", F.coalesce("listed", F.lit(False)).alias("listed"))


@query(
    "flw_04_lanes",
    """SELECT user_id::VARCHAR AS external_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END, event_id))::BIGINT AS seq FROM events GROUP BY 1""",
)
def lanes(spark, sf):
    lane = F.when(F.col("event_type") == "purchase", "realtime").when(F.col("event_type") == "click", "backfill").when(F.col("event_type") == "view", "reprocess").otherwise("none")
    events = V.table(spark, sf, "events").select(
        F.lit("t0").alias("tenant_id"), F.lit("x").alias("source_kind"), F.col("user_id").cast("string").alias("external_id"), lane.alias("lane"), F.col("event_id").alias("seq")
    )
    return FL.settle_lanes(events).select("external_id", "seq")


@query("flw_05_best_effort", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS reply, CASE WHEN event_type = 'error' THEN 'bad row' END AS error FROM events")
def best_effort(spark, sf):
    def shout(items):
        if "error" in items:
            raise ValueError("bad row")
        return [i.upper() for i in items]

    done, failed = R.apply_model(V.table(spark, sf, "events").select("event_id", "event_type"), F.col("event_type"), shout)
    return done.select("event_id", "reply", F.lit(None).cast("string").alias("error")).unionByName(failed.select("event_id", F.lit(None).cast("string").alias("reply"), "error"))


# --- streams -------------------------------------------------------------------------


def stream(spark, sf, name):
    J.enable_state(spark)
    schema = V.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


LATER = "CASE WHEN doc_id % 10 = 0 THEN text || ' Changed since.' ELSE text END"


@query(
    "str_01_ingest",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL.replace("text AS content, 1704067200 + doc_id AS created_s", LATER + " AS content, doc_id % 10 = 0 AS moved")}
    SELECT artifact_id, content_hash, count(*)::BIGINT AS n, 1 + bool_or(moved)::BIGINT AS n_stored FROM chunks GROUP BY 1, 2""",
)
def ingest(spark, sf):
    """Two feeds of all documents, a tenth of them changed in the second: live chunks, and how often an artifact was stored."""
    events = stream(spark, sf, "documents").select(
        F.col("source").alias("tenant_id"), V._by_lang("notion", "file", "gmail", "linear").alias("source_kind"),
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("external_id"), V._by_lang("page", "doc", "email", "issue").alias("kind"),
        F.col("text").alias("content"), F.lit("backfill").alias("lane"), F.col("doc_id").alias("seq"), "doc_id",
    )
    base = fresh_path(spark, "ingest")
    later = events.withColumn("content", F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit(" Changed since."))).otherwise(F.col("content")))
    for feed, rows in (("first", events), ("later", later)):
        G.start_ingest(rows.drop("doc_id"), base, f"{base}/ckpt-{feed}", feed).awaitTermination()
    chunks = G.live_chunks(spark, base).groupBy("artifact_id", "content_hash").agg(F.count("*").alias("n"))
    stored = spark.read.parquet(f"{base}/artifacts").groupBy("artifact_id").agg(F.count("*").alias("n_stored"))
    return chunks.join(stored, "artifact_id")


@query("str_02_changed_only", "SELECT md5(text) AS artifact_key, 'sha256:' || sha256(text) AS content_hash, 'insert' AS change FROM documents GROUP BY ALL")
def changed_only(spark, sf):
    """Documents keyed by their text: every exact copy after the first is dropped."""
    events = stream(spark, sf, "documents").select(F.md5("text").alias("artifact_key"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return J.drain(J.changed_only(events), "changed").select("artifact_key", "content_hash", "change")


@query(
    "str_03_expiring",
    """WITH d AS (SELECT event_id, epoch_us(ts) // 1000 + 3600000 * (1 + event_id % 24) AS due_ms FROM events)
    SELECT event_id::VARCHAR AS object_id, 'expired' AS state, due_ms FROM d WHERE due_ms <= (SELECT max(epoch_us(ts) // 1000) FROM events)""",
)
def expiring(spark, sf):
    rows = stream(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("object_id"), F.col("ts").cast("timestamp").alias("validated_at"), (F.lit(3600) * (1 + F.col("event_id") % 24)).alias("ttl_seconds")
    ).withWatermark("validated_at", "0 seconds")
    return J.drain(J.expiring(rows), "expiring")


@query("str_04_admitted", SQL["flw_01_token_bucket"])
def admitted(spark, sf):
    rows = stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(1.0).alias("cost"))
    out = J.drain(J.admitted(rows, 3, 0.00001), "admitted")
    return out.select("event_id", "allowed", F.round("retry_after", 3).alias("retry_after"))


@query(
    "src_09_fixture_corpus",
    """SELECT 'sample' AS source_kind, 'doc:' || doc_id AS external_id, CASE WHEN doc_id % 3 = 0 THEN 'doc' ELSE lang END AS kind, md5(text) AS content, 1767225600 AS created_s
    FROM documents WHERE doc_id % 5 > 0""",
)
def fixture_corpus(spark, sf):
    """All documents as a fixture of JSON lines; a fifth of the lines has no id, a third no kind."""
    path = fresh_path(spark, "fixture")
    key = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    V.documents(spark, sf).select(key.alias("external_id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("kind"), F.col("text").alias("content")).write.json(path)
    rows = N.normalize("sample", items=FX.fixture_items(spark, path, "t0"))
    return rows.select("source_kind", "external_id", "kind", F.md5("content").alias("content"), F.unix_timestamp("created_at").cast("int").alias("created_s"))


# --- golden sets, example files and sinks ------------------------------------------


@query(
    "src_10_retrieval_golden",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {RT.LABELS_SQL}
    SELECT query_id::VARCHAR AS query, 'test' AS split, external_id, ordinal::BIGINT AS ordinal FROM labels_v JOIN chunks USING (chunk_id) WHERE query_id % 3 > 0""",
)
def retrieval_golden(spark, sf):
    """Passages with the chunks that quote them, written as lines (one blank, some without a split), read and cut to a split."""
    chunks = V.corpus_chunks(spark, sf)
    found = RT.passage_labels(spark, sf).join(chunks, "chunk_id")
    pair = F.array("external_id", F.col("ordinal").cast("string"))
    rows = found.groupBy("query_id").agg(F.collect_list(pair).alias("relevant"))
    split = F.when(F.col("query_id") % 3 == 0, "train").when(F.col("query_id") % 3 == 1, "test")
    lines = rows.select(F.to_json(F.struct(F.col("query_id").cast("string").alias("query"), "relevant", split.alias("split"))).alias("value"))
    path = fresh_path(spark, "golden")
    lines.unionByName(spark.range(1).select(F.lit("").alias("value"))).write.text(path)
    test = I.golden_split(I.load_golden(spark, path), "test")
    return test.select("query", "split", F.explode("relevant").alias("r")).select("query", "split", "r.external_id", "r.ordinal")


@query(
    "src_10_process_golden",
    "SELECT source AS name_contains, count(DISTINCT lang)::BIGINT AS n_steps, min(lang) AS first_actor FROM documents GROUP BY 1",
)
def process_golden(spark, sf):
    """Sources as processes and languages as their steps and actors, written as lines and read back."""
    langs = F.sort_array(F.collect_set("lang"))
    rows = V.documents(spark, sf).groupBy(F.col("source").alias("name_contains")).agg(langs.alias("steps"), langs.alias("actors"))
    path = fresh_path(spark, "processes")
    rows.select(F.to_json(F.struct("name_contains", "steps", "actors")).alias("value")).write.text(path)
    read = I.load_process_golden(spark, path)
    return read.select("name_contains", F.size("steps").cast("long").alias("n_steps"), F.get("actors", F.lit(0)).alias("first_actor"))


@query(
    "src_11_example_files",
    "SELECT lang || ':' || source AS query, md5(text) AS positive, 1::BIGINT AS n_negatives FROM documents",
)
def example_files(spark, sf):
    """Every document as a training example, written as lines and read back whole."""
    rows = V.documents(spark, sf).select(F.concat_ws(":", "lang", "source").alias("query"), F.col("text").alias("positive"), F.array("source").alias("negatives"))
    path = fresh_path(spark, "examples")
    I.write_training_examples(rows, path)
    read = I.load_training_examples(spark, path)
    return read.select("query", F.md5("positive").alias("positive"), F.size("negatives").cast("long").alias("n_negatives"))


@query(
    "src_13_skills_sink",
    """SELECT c_nationkey::VARCHAR AS tenant_id, 1::BIGINT AS line_no, 'refund ' || c_name AS name, NULL::BIGINT AS fresh FROM customer
    UNION ALL SELECT c_nationkey::VARCHAR, 0, NULL, count(*) FROM customer GROUP BY 1""",
)
def skills_sink(spark, sf):
    """One skill per customer, written as JSON lines in tenant folders under a manifest line, and read back."""
    steps = F.array(F.struct(F.lit("check").alias("action"), F.lit(None).cast("string").alias("actor")))
    named = V.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("tenant_id"), F.concat(F.lit("refund "), "c_name").alias("name"), F.lit("t").alias("trigger"),
        F.lit(1).alias("version"), F.lit("fresh").alias("freshness"), steps.alias("steps"),
    )
    path = fresh_path(spark, "skills")
    sinks.write_skills(SV.skills_lines(named, SV.freshness_manifest(named), "2024-01-31"), path)
    line = F.from_json("value", "name string, freshness_manifest struct<fresh: bigint>")
    read = spark.read.schema("value string, tenant_id string").text(path).withColumn("j", line)
    head = F.col("j.freshness_manifest").isNotNull()
    return read.select("tenant_id", F.when(head, 0).otherwise(1).cast("long").alias("line_no"), "j.name", "j.freshness_manifest.fresh")
