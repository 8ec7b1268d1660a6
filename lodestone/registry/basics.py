"""Queries over scalars, scope, chunks and blurbs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions import text as X
from lodestone.operators import chunking as C
from lodestone.operators.artifacts import canonical
from lodestone.operators.blurbs import with_blurbs
from lodestone.operators.embedding import sparse_counts, unit_vector
from lodestone.operators.inverted import BLOCKS
from lodestone.operators.sparse import build_postings
from lodestone.registry import views as V

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query(
    "prj_01_tenant_scope",
    f"WITH {V.ARTIFACTS_SQL} SELECT tenant_id, external_id FROM artifacts WHERE tenant_id = 'src3'",
)
def tenant_scope(spark, sf):
    rows = V.artifacts(spark, sf)
    none = ids.scoped(rows, "").unionByName(ids.scoped(rows, None))
    return ids.scoped(rows, "src3").unionByName(none).select("tenant_id", "external_id")


@query(
    "prj_02_source_kinds",
    f"""WITH {V.ARTIFACTS_SQL} SELECT source_kind, external_id FROM artifacts WHERE source_kind IN ('notion', 'gmail')""",
)
def source_kinds(spark, sf):
    return ids.of_kinds(V.artifacts(spark, sf), ["notion", "gmail"]).select("source_kind", "external_id")


@query(
    "prj_03_tenant_id",
    f"""WITH h AS (SELECT source, sha1(unhex('{X.fv.DNS_NAMESPACE.replace("-", "")}') || encode('{X.fv.TENANT_PREFIX}' || source)) AS d FROM (SELECT DISTINCT source FROM documents))
    SELECT source, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' ||
      CASE WHEN d[17] IN ('0', '4', '8', 'c') THEN '8' WHEN d[17] IN ('1', '5', '9', 'd') THEN '9' WHEN d[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END ||
      d[18:20] || '-' || d[21:32] AS tenant_id FROM h""",
)
def tenant_id(spark, sf):
    return V.documents(spark, sf).select("source").distinct().select("source", ids.tenant_id("source").alias("tenant_id"))


@query(
    "prj_04_content_hash",
    "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents",
)
def content_hash(spark, sf):
    return V.documents(spark, sf).select("doc_id", X.content_hash("text").alias("content_hash"))


@query(
    "prj_05_token_count",
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents",
)
def token_count(spark, sf):
    return V.documents(spark, sf).select("doc_id", X.token_count("text").cast("long").alias("n"))


@query("prj_06_head", f"WITH {V.ARTIFACTS_SQL}, {V.HEAD_SQL} SELECT artifact_id, head FROM heads")
def head(spark, sf):
    return V.artifacts(spark, sf).select("artifact_id", "head")


@query(
    "prj_07_blurb",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL}, {V.HEAD_SQL}
    SELECT c.chunk_id, {V.BLURB_SQL} AS blurb
    FROM chunks c JOIN heads h USING (artifact_id)""",
)
def blurb(spark, sf):
    return with_blurbs(V.chunks(spark, sf)).select("chunk_id", "blurb")


@query(
    "prj_08_embedding_text",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL}
    SELECT chunk_id, md5(kind || chr(10) || chr(10) || text) AS embedded, md5(kind || ' ' || text) AS searched FROM chunks""",
)
def embedding_text(spark, sf):
    return V.chunks(spark, sf).select(
        "chunk_id",
        F.md5(X.embedding_text("text", "kind")).alias("embedded"),
        F.md5(X.searchable("text", "kind")).alias("searched"),
    )


_STOP = "['the','of','de','and','la']"


@query(
    "prj_11_tokenisers",
    f"""SELECT doc_id,
      md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS hash_tokens,
      md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: len(t) > 1 AND NOT list_contains({_STOP}, t)))), ' ')) AS salient,
      md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda t: len(t) > 2))), ' ')) AS match_tokens
    FROM documents""",
)
def tokenisers(spark, sf):
    return V.documents(spark, sf).select(
        "doc_id",
        F.md5(F.array_join(X.hash_tokens("text"), " ")).alias("hash_tokens"),
        F.md5(F.array_join(F.array_sort(X.salient("text", ["the", "of", "de", "and", "la"])), " ")).alias("salient"),
        F.md5(F.array_join(F.array_sort(X.match_tokens("text")), " ")).alias("match_tokens"),
    )


@query(
    "chk_01_dispatch",
    rf"""WITH {V.ARTIFACT_CHUNKS_SQL} SELECT artifact_id, ordinal::BIGINT AS ordinal, chunk_id, md5(text) AS text_hash,
      len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::BIGINT AS token_count FROM chunks""",
)
def dispatch(spark, sf):
    return V.chunks(spark, sf).select(
        "artifact_id", "ordinal", "chunk_id", F.md5("text").alias("text_hash"), "token_count"
    )


@query(
    "chk_02_fixed_window",
    r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents),
    t AS (SELECT doc_id, CASE WHEN len(ws) <= 50 THEN [regexp_replace(text, '^\s+|\s+$', '', 'g')]
         ELSE list_transform(range(0, 1 + CAST(ceil((len(ws) - 50) / 35.0) AS BIGINT)), lambda i: array_to_string(ws[i * 35 + 1 : i * 35 + 50], ' ')) END AS texts FROM w)
    SELECT doc_id, (p.o)::BIGINT AS ordinal, md5(p.t) AS text_hash
    FROM (SELECT doc_id, unnest(list_transform(texts, lambda t, i: {'o': i - 1, 't': t})) AS p FROM t)""",
)
def fixed_window(spark, sf):
    return (
        V.documents(spark, sf)
        .select("doc_id", F.posexplode(C.fixed_window("text", 50, 15)).alias("ordinal", "t"))
        .select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("t").alias("text_hash"))
    )


@query(
    "chk_03_markdown",
    r"""WITH d AS (
      SELECT source, doc_id, regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents),
    s AS (SELECT source, doc_id, '## part ' || doc_id AS heading, body,
            list_filter(regexp_split_to_array(body, '\s+'), lambda w: w <> '') AS ws FROM d),
    c AS (SELECT source, doc_id,
        CASE WHEN len(ws) + 3 <= 200 THEN [heading || chr(10) || body]
             WHEN len(ws) <= 197 THEN [heading || chr(10) || body]
             WHEN len(ws) <= 200 THEN [body]
             ELSE list_transform(range(0, 1 + CAST(ceil((len(ws) - 200) / 160.0) AS BIGINT)),
               lambda i: array_to_string(ws[i * 160 + 1 : i * 160 + 200], ' ')) END AS texts FROM s)
    SELECT source, md5(t) AS text_hash, count(*)::BIGINT AS n FROM (SELECT source, unnest(texts) AS t FROM c) GROUP BY 1, 2""",
)
def markdown(spark, sf):
    """Two documents per text, each under its own heading, when they share source and hundred."""
    docs = V.documents(spark, sf).withColumn("shelf", F.floor(F.col("doc_id") / 100))
    part = F.concat(F.lit("## part "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"))
    texts = docs.groupBy("source", "shelf").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"]), "\n").alias("text")
    )
    return (
        texts.select("source", F.explode(C.markdown("text")).alias("t"))
        .groupBy("source", F.md5("t").alias("text_hash"))
        .agg(F.count("*").alias("n"))
    )


_THREADS = r"""
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
         role || ': ' || array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS line
  FROM conversations),
sized AS (SELECT *, len(string_split(line, ' ')) AS n FROM turns),
total AS (SELECT conv_id, sum(n) AS n_all, max(i) AS last FROM sized GROUP BY 1)"""


@query(
    "chk_04_thread",
    rf"""WITH RECURSIVE {_THREADS},
    fold AS (
      SELECT t.conv_id, 0::BIGINT AS i, []::VARCHAR[] AS open, 0::BIGINT AS size, []::VARCHAR[] AS emitted, t.last
      FROM total t WHERE t.n_all > 200
      UNION ALL
      SELECT f.conv_id, s.i,
        CASE WHEN s.n > 200 THEN []
             WHEN f.size + s.n > 200 AND len(f.open) > 0 THEN [f.open[-1], s.line]
             ELSE list_append(f.open, s.line) END,
        CASE WHEN s.n > 200 THEN 0
             WHEN f.size + s.n > 200 AND len(f.open) > 0 THEN len(string_split(f.open[-1], ' ')) + s.n
             ELSE f.size + s.n END,
        CASE WHEN s.n > 200 THEN
               list_concat(CASE WHEN len(f.open) > 0 THEN [array_to_string(f.open, chr(10))] ELSE [] END,
                 list_transform(range(0, 1 + CAST(ceil((s.n - 200) / 160.0) AS BIGINT)),
                   lambda j: array_to_string(string_split(s.line, ' ')[j * 160 + 1 : j * 160 + 200], ' ')))
             WHEN f.size + s.n > 200 AND len(f.open) > 0 THEN [array_to_string(f.open, chr(10))]
             ELSE [] END,
        f.last
      FROM fold f JOIN sized s ON s.conv_id = f.conv_id AND s.i = f.i + 1),
    out AS (
      SELECT conv_id, unnest(emitted) AS t FROM fold
      UNION ALL SELECT conv_id, array_to_string(open, chr(10)) FROM fold WHERE i = last AND len(open) > 0
      UNION ALL SELECT s.conv_id, string_agg(s.line, chr(10) ORDER BY s.i) FROM sized s JOIN total t ON s.conv_id = t.conv_id AND t.n_all <= 200 GROUP BY 1)
    SELECT conv_id, md5(t) AS text_hash, count(*)::BIGINT AS n FROM out GROUP BY 1, 2""",
)
def thread(spark, sf):
    line = F.concat("role", F.lit(": "), F.array_join(X.words("text"), " "))
    texts = (
        V.table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    )
    return (
        texts.select("conv_id", F.explode(C.thread("text")).alias("t"))
        .groupBy("conv_id", F.md5("t").alias("text_hash"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "chk_05_email",
    r"""WITH t AS (
      SELECT conv_id, turn, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS text FROM conversations),
    w AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body,
                 list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM t),
    c AS (SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 200 THEN [body]
             ELSE list_transform(range(0, 1 + CAST(ceil((len(ws) - 200) / 160.0) AS BIGINT)),
               lambda i: array_to_string(ws[i * 160 + 1 : i * 160 + 200], ' ')) END AS texts FROM w)
    SELECT conv_id, turn, md5(t) AS text_hash FROM (SELECT conv_id, turn, unnest(texts) AS t FROM c)""",
)
def email(spark, sf):
    """Every turn as a mail that quotes itself and carries a reply tail."""
    quoted = F.concat(F.lit("> "), F.regexp_replace(X.unify_breaks("text"), "\n", "\n> "))
    mail = F.concat("text", F.lit("\n"), quoted, F.lit("\nOn Monday someone wrote:\nquoted words below"))
    return (
        V.table(spark, sf, "conversations")
        .withColumn("mail", mail)
        .select("conv_id", "turn", F.explode(C.email("mail")).alias("t"))
        .select("conv_id", "turn", F.md5("t").alias("text_hash"))
    )


@query(
    "chk_06_pack",
    r"""WITH RECURSIVE sized AS (
      SELECT source, doc_id, row_number() OVER (PARTITION BY source, doc_id // 10 ORDER BY doc_id) AS i, doc_id // 10 AS grp,
             array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ') AS line FROM documents),
    n AS (SELECT *, len(string_split(line, ' ')) AS n FROM sized),
    last AS (SELECT source, grp, max(i) AS last FROM n GROUP BY 1, 2),
    fold AS (
      SELECT source, grp, 0::BIGINT AS i, []::VARCHAR[] AS open, 0::BIGINT AS size, []::VARCHAR[] AS emitted, last FROM last
      UNION ALL
      SELECT f.source, f.grp, s.i,
        CASE WHEN s.n > 298 THEN [] WHEN f.size + s.n > 298 AND len(f.open) > 0 THEN [s.line] ELSE list_append(f.open, s.line) END,
        CASE WHEN s.n > 298 THEN 0 WHEN f.size + s.n > 298 AND len(f.open) > 0 THEN s.n ELSE f.size + s.n END,
        CASE WHEN s.n > 298 THEN
               list_concat(CASE WHEN len(f.open) > 0 THEN ['# head' || chr(10) || array_to_string(f.open, chr(10))] ELSE [] END,
                 CASE WHEN s.n <= 300 THEN [s.line] ELSE
                 list_transform(range(0, 1 + CAST(ceil((s.n - 300) / 250.0) AS BIGINT)),
                   lambda j: array_to_string(string_split(s.line, ' ')[j * 250 + 1 : j * 250 + 300], ' ')) END)
             WHEN f.size + s.n > 298 AND len(f.open) > 0 THEN ['# head' || chr(10) || array_to_string(f.open, chr(10))] ELSE [] END,
        f.last
      FROM fold f JOIN n s ON s.source = f.source AND s.grp = f.grp AND s.i = f.i + 1),
    out AS (SELECT source, grp, unnest(emitted) AS t FROM fold
      UNION ALL SELECT source, grp, '# head' || chr(10) || array_to_string(open, chr(10)) FROM fold WHERE i = last AND len(open) > 0)
    SELECT source, grp, md5(t) AS text_hash, count(*)::BIGINT AS n FROM out GROUP BY 1, 2, 3""",
)
def pack(spark, sf):
    """Documents of one source and decade of ids packed as units under a prefix."""
    line = F.array_join(X.words("text"), " ")
    units = (
        V.documents(spark, sf)
        .groupBy("source", F.floor(F.col("doc_id") / 10).alias("grp"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("l")))), lambda x: x["l"]).alias("u"))
    )
    return (
        units.select("source", "grp", F.explode(C.pack("u", 300, 50, prefix="'# head'")).alias("t"))
        .groupBy("source", "grp", F.md5("t").alias("text_hash"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "emb_01_hashing",
    f"WITH {V.CORPUS_CHUNKS_SQL} {V.SLOTS_SQL.format(key='chunk_id', text='text', source='chunks')}",
)
def hashing(spark, sf):
    return (
        V.embedded(V.corpus_chunks(spark, sf))
        .select("chunk_id", F.posexplode("vector").alias("slot", "value"))
        .filter(F.col("value") != 0)
        .select("chunk_id", F.col("slot").cast("long").alias("slot"), F.col("value").cast("long").alias("value"))
    )


@query(
    "emb_01_unit_vectors",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, s AS ({V.SLOTS_SQL.format(key='chunk_id', text='text', source='chunks')}), n AS (SELECT chunk_id, sqrt(sum(value * value)::DOUBLE) AS n FROM s GROUP BY 1)
    SELECT chunk_id, slot, round(value / n, 6) AS value FROM s JOIN n USING (chunk_id)""",
)
def unit_vectors(spark, sf):
    """The hashing embedder's vectors at unit length."""
    rows = V.stored_chunks(spark, sf).select("chunk_id", F.posexplode(unit_vector("vector")).alias("slot", "value"))
    return rows.filter("value <> 0").select("chunk_id", F.col("slot").cast("long").alias("slot"), F.round("value", 6).alias("value"))


@query(
    "emb_01_hashing_relation",
    f"{V.SLOTS_SQL.format(key='doc_id', text='text', source='documents')}",
)
def hashing_relation(spark, sf):
    return sparse_counts(V.documents(spark, sf), "text", "doc_id")


@query(
    "spr_01_postings",
    f"""WITH {V.ARTIFACT_CHUNKS_SQL},
    tok AS (SELECT tenant_id, chunk_id, unnest(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM chunks)
    SELECT tenant_id, x.t AS term, chunk_id, count(*)::BIGINT AS tf, string_agg(x.p::VARCHAR, ' ' ORDER BY x.p) AS positions FROM tok GROUP BY 1, 2, 3""",
)
def postings(spark, sf):
    return build_postings(V.chunks(spark, sf), "simple").select(
        "tenant_id", "term", "chunk_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")
    )


@query(
    "spr_01_stored_blocks",
    f"""WITH {V.CORPUS_CHUNKS_SQL},
    tok AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM chunks)
    SELECT x.t AS term, chunk_id, string_agg(x.p::VARCHAR, ' ' ORDER BY x.p) AS positions, true AS in_slab FROM tok GROUP BY 1, 2""",
)
def stored_blocks(spark, sf):
    """Every posting as it lies in the stored index, its mask agreeing with its list, named by its chunk."""
    index = V.corpus_index(spark, sf, "simple", blurb=False)
    keys = ["segment", "tenant_id", "slab"]
    # blocks move whole, with their positions as text, and meet the names of their slab
    lists = F.transform("postings", lambda p: F.struct(p["at"].alias("at"), F.array_join(p["positions"].cast("array<string>"), " ").alias("positions")))
    slabs = index.docs().groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "id"))).alias("names"))
    met = index._read("blocks", BLOCKS).select(*keys, "term", "mask", lists.alias("lists")).join(slabs, keys)
    rows = met.select("term", "mask", "names", F.explode("lists").alias("p")).withColumn("chunk_id", F.expr("try_element_at(names, p.at)"))
    return rows.filter("chunk_id IS NOT NULL").select("term", "chunk_id", "p.positions", F.expr("(shiftright(mask, p.at) & 1) = 1").alias("in_slab"))
