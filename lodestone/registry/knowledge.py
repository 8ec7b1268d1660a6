"""Queries over the knowledge graph and process extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import graph as G
from lodestone.operators import neighbours as NB
from lodestone.operators import process as P
from lodestone.operators.phrases import Phrases
from lodestone.registry import views as V
from lodestone.session import cut_lineage

QUERIES, SQL = {}, {}

# The driver prose is invented: these are words it does contain.
LEXICON = [("that", "role"), ("this", "role"), ("with", "team"), ("from", "team"), ("eau", "system"), ("der", "role"), ("ment", "system")]
SYNONYMS = [("this", "that"), ("from", "with")]
CUES = [r"with\s+(?:the\s+)?([a-z ]+?)(?:\.|,)", r"from\s+(?:the\s+)?([a-z ]+?)(?:\.|,)"]
ACTIONS = ["the", "der", "que", "les"]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_LEX = "(VALUES " + ", ".join(f"('{n}', '{t}', {i})" for i, (n, t) in enumerate(LEXICON)) + ") lex(name, type, priority)"
_SYN = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ") syn(short, long)"
MENTIONS_SQL = rf"""{V.ARTIFACT_CHUNKS_SQL},
found AS (SELECT tenant_id, artifact_id, chunk_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS name FROM chunks),
cand AS (SELECT found.*, lex.type, coalesce(syn.long, found.name) AS key FROM found JOIN {_LEX} USING (name) LEFT JOIN {_SYN} ON syn.short = found.name)"""


def cands(spark, sf):
    """The mentions, extracted once: resolution, edges and neighbourhoods each read them several times."""
    return V._once(spark, ("mentions", sf), lambda: cut_lineage(G.extract_entities(V.chunks(spark, sf), LEXICON)))


@query("kg_01_entities", f"WITH {MENTIONS_SQL} SELECT chunk_id, name, type, count(*)::BIGINT AS n FROM cand GROUP BY 1, 2, 3")
def entities(spark, sf):
    return cands(spark, sf).groupBy("chunk_id", "name", "type").agg(F.count("*").alias("n"))


# Every run of one to three words of the benchmark passages is a phrase; longer ones come first.
LEXICON_SQL = r"""
bw AS (SELECT item_id, unnest(list_transform(w, lambda t, i: {'t': t, 'p': i})) AS x, w FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark)),
lexicon AS (SELECT name, type, row_number() OVER (ORDER BY type DESC, name) AS priority FROM (
  SELECT DISTINCT array_to_string(w[x.p:x.p + k - 1], ' ') AS name, 'words ' || k AS type FROM bw, range(1, 4) r(k) WHERE x.p + k - 1 <= len(w)))"""
PLACES_SQL = rf"""{V.ARTIFACT_CHUNKS_SQL}, {LEXICON_SQL},
runs AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS r FROM chunks),
spots AS (SELECT chunk_id, unnest(range(1, len(r) + 1)) AS i, r FROM runs),
placed AS (SELECT chunk_id, i, len(array_to_string(r[1:i - 1], '')) AS s, unnest([1, 2, 3]) AS k, r FROM spots WHERE regexp_matches(r[i], '^[\p{{L}}\p{{N}}_]')),
cand AS (SELECT chunk_id, priority, s, s + len(name) AS e, name, type FROM (SELECT *, array_to_string(r[i:i + 2 * k - 2], '') AS name FROM placed WHERE i + 2 * k - 2 <= len(r)) JOIN lexicon USING (name)
  WHERE type = 'words ' || k),
folded AS (SELECT chunk_id, list_reduce(list([{{'priority': priority, 's': s, 'e': e, 'name': name, 'type': type}}] ORDER BY priority, s),
  lambda a, x: CASE WHEN len(list_filter(a, lambda o: x[1].s < o.e AND o.s < x[1].e)) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM cand GROUP BY 1),
ents AS (SELECT chunk_id, unnest(kept) AS k FROM folded)"""


def phrase_lexicon(spark, sf):
    runs = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = V.table(spark, sf, "benchmark").select(runs.alias("w"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("k")).filter("size(w) >= k")
    rows = words.select(F.concat(F.lit("words "), F.col("k")).alias("type"), F.explode(F.expr("transform(sequence(1, size(w) - k + 1), p -> array_join(slice(w, p, k), ' '))")).alias("name"))
    order = Window.orderBy(F.desc("type"), "name")
    return rows.distinct().withColumn("priority", F.row_number().over(order))


@query("kg_01_phrases", f"WITH {PLACES_SQL} SELECT chunk_id, k.s::BIGINT AS start, k.name AS name, k.type AS type FROM ents")
def phrases(spark, sf):
    """Every phrase of the benchmark in every chunk, longer ones first, with offsets."""
    found = Phrases(phrase_lexicon(spark, sf)).entities(V.chunks(spark, sf))
    return found.select("chunk_id", F.col("start").cast("long").alias("start"), "name", "type")


RELATIONS_SQL = rf"""{V.ARTIFACT_CHUNKS_SQL}, lex AS (SELECT * FROM {_LEX}),
low AS (SELECT chunk_id, lower(text) AS t FROM chunks),
runs AS (SELECT chunk_id, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS r FROM low),
ents AS (SELECT chunk_id, len(array_to_string(r[1:i - 1], '')) AS s, lex.name FROM (SELECT chunk_id, r, unnest(range(1, len(r) + 1)) AS i FROM runs) JOIN lex ON r[i] = lex.name),
said AS (""" + " UNION ALL ".join(
    rf"""SELECT chunk_id, '{p}' AS predicate, sum(len(w.gap) + len(w.cue)) OVER (PARTITION BY chunk_id ORDER BY w.i) - len(w.cue) AS start, w.obj AS obj FROM (
  SELECT chunk_id, unnest(list_transform(regexp_extract_all(t, '{c}'), lambda m, i: {{'i': i, 'cue': m, 'obj': trim(regexp_extract_all(t, '{c}', 1)[i]), 'gap': regexp_split_to_array(t, '{c}')[i]}})) AS w FROM low)"""
    for p, c in (("with", CUES[0]), ("from", CUES[1]))
) + r"""),
known AS (SELECT chunk_id, predicate, start, min_by(lex.name, priority) AS object FROM said JOIN lex ON contains(obj, lex.name) OR contains(lex.name, obj) GROUP BY ALL)"""


@query(
    "kg_02_relations",
    f"""WITH {RELATIONS_SQL}, r AS (SELECT k.chunk_id, k.predicate, k.start, k.object, max_by(e.name, e.s) AS subject FROM known k JOIN ents e ON e.chunk_id = k.chunk_id AND e.s < k.start AND e.name <> k.object GROUP BY ALL)
    SELECT subject, predicate, object, count(*)::BIGINT AS n FROM r GROUP BY 1, 2, 3""",
)
def relations(spark, sf):
    lexicon = spark.createDataFrame([(n, t, i) for i, (n, t) in enumerate(LEXICON)], "name string, type string, priority int")
    found = Phrases(lexicon).relations(V.chunks(spark, sf), [(CUES[0], "with"), (CUES[1], "from")])
    return found.groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@query(
    "kg_03_merge_key",
    rf"""WITH w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[^.\n]+'), lambda s, i: {{'s': s, 'i': i - 1}})) AS x FROM documents),
    k AS (SELECT doc_id, x.i AS pos, regexp_replace(trim(regexp_replace(lower(regexp_replace(x.s, '^\s+|\s+$', '', 'g')), '^(the|a|an)\s+', ''), ' .'), '\s+', ' ', 'g') AS k FROM w)
    SELECT doc_id, pos, coalesce(long, k) AS merge_key FROM k LEFT JOIN {_SYN} ON short = k""",
)
def merge_key(spark, sf):
    """Every run of text between full stops and line ends, as a name."""
    said = F.regexp_extract_all("text", F.lit(r"[^.\n]+"), F.lit(0))
    named = V.documents(spark, sf).select("doc_id", F.posexplode(said).alias("pos", "name"))
    return named.select("doc_id", F.col("pos").cast("long").alias("pos"), G.merge_key("name", SYNONYMS).alias("merge_key"))


def _entity_sql(scope: str) -> str:
    return f"""SELECT {scope}, type, list_sort(list(DISTINCT name)) AS aliases,
      min_by(name, (-len(name), name)) AS name, max(0.8::DOUBLE) AS confidence FROM cand GROUP BY {scope}, type, key"""


@query("kg_04_resolve", f"WITH {MENTIONS_SQL}, e AS ({_entity_sql('tenant_id, artifact_id')}) SELECT artifact_id, type, name, array_to_string(aliases, '|') AS aliases, confidence FROM e")
def resolve(spark, sf):
    found, _ = G.resolve_entities(cands(spark, sf), "artifact", SYNONYMS)
    return found.select("artifact_id", "type", "name", F.array_join("aliases", "|").alias("aliases"), "confidence")


@query("kg_05_similar_names")
def similar_names(spark, sf):
    """The words of each language as entity names, folded into similar ones."""
    words = V.documents(spark, sf).select(F.col("lang").alias("type"), F.explode(F.array_distinct(X.fulltext_tokens("text"))).alias("name"))
    named = words.groupBy("type", "name").agg(F.count("*").cast("double").alias("confidence")).withColumn("aliases", F.array("name"))
    out = G.merge_similar(named, [])
    return out.select("type", "name", F.array_join("aliases", "|").alias("aliases"), "confidence")


@query("kg_08_tenant_scope", f"WITH {MENTIONS_SQL}, e AS ({_entity_sql('tenant_id')}) SELECT tenant_id, type, name, array_to_string(aliases, '|') AS aliases FROM e")
def tenant_scope(spark, sf):
    found, _ = G.resolve_entities(cands(spark, sf), "tenant", SYNONYMS)
    return found.select("tenant_id", "type", "name", F.array_join("aliases", "|").alias("aliases"))


@query(
    "kg_06_upsert",
    f"""WITH {MENTIONS_SQL}, e AS ({_entity_sql('tenant_id, artifact_id, kind_of')}),
    x AS (SELECT tenant_id, type, name, unnest(aliases) AS a FROM e)
    SELECT tenant_id, type, name, array_to_string(list_sort(list(DISTINCT a)), '|') AS aliases, md5(tenant_id || '|' || type || '|' || name) AS entity_id FROM x GROUP BY 1, 2, 3""".replace(", kind_of", ""),
)
def upsert(spark, sf):
    """Entities of the mail artifacts are stored first, then those of all others."""
    chunks = V.chunks(spark, sf)
    first, _ = G.resolve_entities(G.extract_entities(chunks.filter("kind = 'email'"), LEXICON), "artifact", SYNONYMS)
    rest, _ = G.resolve_entities(G.extract_entities(chunks.filter("kind <> 'email'"), LEXICON), "artifact", SYNONYMS)
    state = G.upsert_entities(first, rest)
    return state.select("tenant_id", "type", "name", F.array_join("aliases", "|").alias("aliases"), "entity_id")


@query(
    "kg_06_mentions",
    f"""WITH {MENTIONS_SQL}, e AS ({_entity_sql('tenant_id, artifact_id, key')})
    SELECT DISTINCT md5(c.tenant_id || '|' || c.type || '|' || e.name) AS entity_id, c.chunk_id FROM cand c JOIN e USING (tenant_id, artifact_id, type, key)""".replace("artifact_id, key, type, list", "artifact_id, key, type, list").replace("GROUP BY tenant_id, artifact_id, key, type, key", "GROUP BY tenant_id, artifact_id, type, key"),
)
def mentions(spark, sf):
    _, seen = G.resolve_entities(cands(spark, sf), "artifact", SYNONYMS)
    none = spark.createDataFrame([], "entity_id string, chunk_id string")
    return G.new_mentions(none, seen).select("entity_id", "chunk_id")


@query(
    "kg_07_edges",
    f"""WITH {MENTIONS_SQL}, e AS ({_entity_sql('tenant_id, artifact_id')}),
    al AS (SELECT artifact_id, tenant_id, type, name, unnest(aliases) AS alias FROM e),
    pick AS (SELECT artifact_id, tenant_id, alias, max_by(md5(tenant_id || '|' || type || '|' || name), (type, name)) AS id FROM al GROUP BY 1, 2, 3),
    r AS (SELECT DISTINCT a.artifact_id, a.chunk_id, a.name AS s, b.name AS o FROM cand a JOIN cand b ON a.chunk_id = b.chunk_id AND a.type = 'role' AND b.type = 'team')
    SELECT DISTINCT r.chunk_id AS source_chunk_id, ps.id AS subject_id, po.id AS object_id FROM r JOIN pick ps ON ps.artifact_id = r.artifact_id AND ps.alias = r.s
    JOIN pick po ON po.artifact_id = r.artifact_id AND po.alias = r.o""",
)
def edges(spark, sf):
    """Relations given by co-mention of a role and a team, resolved through aliases."""
    found = cands(spark, sf)
    known, _ = G.resolve_entities(found, "artifact", SYNONYMS)
    once = found.select("tenant_id", "artifact_id", "chunk_id", "type", "name").distinct()
    left = once.filter("type = 'role'").drop("type").withColumnRenamed("name", "subject")
    right = once.filter("type = 'team'").select("chunk_id", F.col("name").alias("object"))
    said = left.join(right, "chunk_id").withColumns({"predicate": F.lit("with"), "confidence": F.lit(0.7)})
    out = G.resolve_relations(said, known, ["tenant_id", "artifact_id"])
    return out.select("source_chunk_id", "subject_id", "object_id")


# --- around the graph --------------------------------------------------------


@query(
    "kg_09_neighbourhood",
    f"""WITH RECURSIVE {MENTIONS_SQL},
    e AS (SELECT DISTINCT tenant_id, 'name:' || name AS a, artifact_id AS b FROM cand),
    u AS (SELECT tenant_id, a, b FROM e UNION SELECT tenant_id, b, a FROM e),
    reach AS (SELECT DISTINCT tenant_id, a AS seed, a AS node, 0 AS hop FROM e
      UNION SELECT r.tenant_id, r.seed, u.b, r.hop + 1 FROM reach r JOIN u ON u.tenant_id = r.tenant_id AND u.a = r.node WHERE r.hop < 2)
    SELECT tenant_id, seed, node, min(hop) AS hop FROM reach GROUP BY 1, 2, 3""",
)
def neighbourhood(spark, sf):
    """Artifacts that name each entity, and the other entities that these name."""
    said = cands(spark, sf).select("tenant_id", F.concat(F.lit("name:"), "name").alias("source"), F.col("artifact_id").alias("target"))
    return NB.neighbourhood(said, said.select("tenant_id", F.col("source").alias("node")), 2, hub_edges=50)


def told(spark, sf):
    """Who said what kind of thing when: each event replaces the last one of its user."""
    return V.table(spark, sf, "events").select(F.col("user_id"), "event_id", "event_type", F.col("ts").cast("timestamp").alias("asserted_at"))


VALID_SQL = """
once AS (SELECT user_id, ts, max({'e': event_id, 't': event_type}) AS r FROM events GROUP BY 1, 2),
valid AS (SELECT user_id, r.e AS event_id, r.t AS event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS valid_to FROM once)"""


@query(
    "kg_10_as_of",
    f"""WITH {VALID_SQL}, m AS (SELECT user_id, event_id AS moment_id, ts + INTERVAL 1 HOUR AS moment FROM events WHERE event_type = 'purchase')
    SELECT moment_id, event_id, event_type FROM m JOIN valid USING (user_id) WHERE valid_from <= moment AND (valid_to IS NULL OR moment < valid_to)""",
)
def as_of(spark, sf):
    """What held of each user an hour after each purchase."""
    said = told(spark, sf)
    edges = NB.with_validity(said, ["user_id"])
    moments = said.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("moment_id"), (F.col("asserted_at") + F.expr("INTERVAL 1 HOUR")).alias("moment"))
    return NB.as_of(edges, moments, ["user_id"], 3600).select("moment_id", "event_id", "event_type")


@query(
    "kg_11_overlaps",
    """WITH v AS (SELECT event_id, user_id, event_type, ts AS f, ts + (1 + event_id % 90) * INTERVAL 1 HOUR AS t FROM events)
    SELECT a.event_id AS edge_id, max_by(b.event_id, (b.t, b.event_id)) AS other FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_type = b.event_type
      AND (b.f, b.event_id) < (a.f, a.event_id) AND b.t > a.f GROUP BY 1""",
)
def overlapping(spark, sf):
    """Statements of one kind about one user that begin before an earlier one has ended."""
    end = F.col("asserted_at") + F.make_dt_interval(hours=(1 + F.col("event_id") % 90).cast("int"))
    edges = told(spark, sf).select("user_id", "event_type", F.col("event_id").alias("edge_id"), F.col("asserted_at").alias("valid_from"), end.alias("valid_to"))
    return NB.overlaps(edges, ["user_id", "event_type"], "edge_id").select("edge_id", "other")


# --- processes ---------------------------------------------------------------

_STOPS = "[" + ",".join(f"'{w}'" for w in X.fv.FAITH_STOPWORDS) + "]"
SENT_SQL = rf"""{V.ARTIFACT_CHUNKS_SQL},
sent AS (SELECT tenant_id, artifact_id, chunk_id, ordinal AS co, i, s FROM (
   SELECT *, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'),
      lambda x, i: {{'i': i, 's': regexp_replace(x, '^\s+|\s+$', '', 'g')}}), lambda x: x.s <> ''), recursive := true) FROM chunks)),
steps AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY co, i) AS ordinal FROM sent
   WHERE len(list_intersect(list_transform(regexp_split_to_array(s, '\s+'), lambda w: lower(trim(w, '.,:;'))), {ACTIONS})) > 0)"""


@query("prc_01_sentences", f"WITH {SENT_SQL} SELECT chunk_id, md5(s) AS sentence, count(*)::BIGINT AS n FROM sent GROUP BY 1, 2")
def sentences(spark, sf):
    said = V.chunks(spark, sf).select("chunk_id", F.explode_outer(X.sentences("text")).alias("s")).filter("s IS NOT NULL")
    return said.groupBy("chunk_id", F.md5("s").alias("sentence")).agg(F.count("*").alias("n"))


@query("prc_02_procedural", f"WITH {SENT_SQL} SELECT chunk_id, md5(s) AS sentence, count(*)::BIGINT AS n FROM steps GROUP BY 1, 2")
def procedural(spark, sf):
    said = V.chunks(spark, sf).select("chunk_id", F.explode_outer(X.sentences("text")).alias("s"))
    return (
        said.filter(F.col("s").isNotNull() & X.is_procedural("s", ACTIONS))
        .groupBy("chunk_id", F.md5("s").alias("sentence")).agg(F.count("*").alias("n"))
    )


def _sal(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9$]+'), lambda t: len(t) > 1 AND NOT list_contains({_STOPS}, t)))"


@query(
    "prc_03_coverage",
    rf"""WITH {V.ARTIFACT_CHUNKS_SQL}, a AS (SELECT artifact_id, {_sal("content")} AS body FROM artifacts),
    c AS (SELECT artifact_id, chunk_id, {_sal("text")} AS part FROM chunks)
    SELECT chunk_id, round(CASE WHEN len(body) = 0 THEN 1.0 ELSE len(list_intersect(body, part)) / len(body) END, 6) AS coverage FROM c JOIN a USING (artifact_id)""",
)
def coverage(spark, sf):
    """How much of an artifact's content words each of its chunks holds."""
    body = V.artifacts(spark, sf).select("artifact_id", X.salient("content").alias("body"))
    part = V.chunks(spark, sf).select("artifact_id", "chunk_id", X.salient("text").alias("part"))
    return part.join(body, "artifact_id").select(
        "chunk_id", F.round(X.coverage(F.col("body"), F.col("part")), 6).alias("coverage")
    )


def steps(spark, sf):
    return V._once(spark, ("steps", sf), lambda: cut_lineage(P.synthesize_steps(V.chunks(spark, sf), ACTIONS)))


@query("prc_04_synthesis", f"WITH {SENT_SQL} SELECT artifact_id, ordinal, md5(s) AS action, chunk_id FROM steps")
def synthesis(spark, sf):
    return steps(spark, sf).select("artifact_id", "ordinal", F.md5("action").alias("action"), F.get("citations", F.lit(0))["chunk_id"].alias("chunk_id"))


def shifted(spark, sf):
    """Steps that cite the artifact's first chunk, whatever they were taken from."""
    first = V.chunks(spark, sf).filter("ordinal = 0").select("artifact_id", F.col("chunk_id").alias("first"))
    return steps(spark, sf).join(first, "artifact_id").withColumn(
        "citations", F.array(F.struct(F.col("first").alias("chunk_id"), F.col("action").alias("quote")))
    ).drop("first")


SHIFT_SQL = rf"""{SENT_SQL},
shifted AS (SELECT s.artifact_id, s.ordinal, s.s, {_sal('s.s')} AS st, {_sal('c.text')} AS ct FROM steps s JOIN chunks c ON c.artifact_id = s.artifact_id AND c.ordinal = 0),
judged AS (SELECT *, CASE WHEN len(st) = 0 THEN 1.0 ELSE len(list_intersect(st, ct)) / len(st) END AS cov FROM shifted)"""


@query("prc_05_faithfulness", f"WITH {SHIFT_SQL} SELECT artifact_id, md5(s) AS action, row_number() OVER (PARTITION BY artifact_id ORDER BY ordinal) AS ordinal FROM judged WHERE cov >= 0.5")
def faithfulness(spark, sf):
    kept = P.gate_steps(shifted(spark, sf), V.chunks(spark, sf))
    return kept.select("artifact_id", F.md5("action").alias("action"), "ordinal")


@query(
    "prc_06_invariants",
    f"""WITH {SENT_SQL}, p AS (SELECT a.artifact_id, count(s.ordinal) AS n FROM artifacts a LEFT JOIN steps s USING (artifact_id) GROUP BY 1)
    SELECT artifact_id, CASE WHEN n = 0 THEN 'no steps' ELSE 'valid' END AS verdict, n::BIGINT AS n_steps FROM p""",
)
def invariants(spark, sf):
    made = P.assemble(steps(spark, sf)).select("artifact_id", "steps")
    every = V.artifacts(spark, sf).select("artifact_id").join(made, "artifact_id", "left")
    every = every.withColumn("steps", F.coalesce("steps", F.expr("filter(steps, x -> false)"), F.array().cast(made.schema["steps"].dataType)))
    valid, rejected = P.check_invariants(every)
    size = F.size("steps").cast("long").alias("n_steps")
    return valid.select("artifact_id", F.lit("valid").alias("verdict"), size).unionByName(
        rejected.select("artifact_id", F.col("reason").alias("verdict"), size)
    )


@query(
    "prc_07_actors",
    f"""WITH {SENT_SQL}, found AS (SELECT artifact_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS name FROM chunks),
    c AS (SELECT DISTINCT artifact_id, name, type, coalesce(long, name) AS key FROM found JOIN {_LEX} USING (name) LEFT JOIN {_SYN} ON short = name),
    e AS (SELECT artifact_id, type, key, min_by(name, (-len(name), name)) AS canon FROM c GROUP BY 1, 2, 3),
    al AS (SELECT c.artifact_id, c.name AS alias, e.type, e.canon FROM c JOIN e USING (artifact_id, type, key))
    SELECT s.artifact_id, s.ordinal, min_by(al.canon, (-len(al.alias), al.type, al.canon, al.alias)) AS actor
    FROM steps s LEFT JOIN al ON al.artifact_id = s.artifact_id AND contains(lower(s.s), al.alias) GROUP BY 1, 2""",
)
def actors(spark, sf):
    known, _ = G.resolve_entities(cands(spark, sf), "artifact", SYNONYMS)
    return P.detect_actors(steps(spark, sf), known).select("artifact_id", "ordinal", "actor")


# --- evaluation of processes ---------------------------------------------------


@query(
    "evl_12_citation_validity",
    f"WITH {SHIFT_SQL} SELECT round(avg(CASE WHEN cov >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS validity, count(*)::BIGINT AS n_steps FROM judged",
)
def citation_validity(spark, sf):
    from lodestone.operators.process_metrics import citation_validity as rate

    return rate(shifted(spark, sf), V.chunks(spark, sf)).select(F.round("validity", 6).alias("validity"), "n_steps")
