"""Queries over dense, full-text and hybrid retrieval and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions import text as X
from lodestone.operators import dense as D
from lodestone.operators import evaluation as E
from lodestone.operators import fusion
from lodestone.operators import sparse as S
from lodestone.operators.embedding import hashing_vector, model_vector
from lodestone.operators.inverted import Search
from lodestone.plans.search import hybrid_search
from lodestone.registry import views as V
from lodestone.registry.english_sql import stems_sql

QUERIES, SQL = {}, {}
TOKENS = r"[\p{L}\p{N}]+"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def plain_queries(spark, sf):
    """Passages reduced to their words."""
    return V.queries(spark, sf).withColumn("query", bare_words(X.fulltext_tokens("query")))


def bare_words(tokens):
    """Words to be and-ed; a literal ``or`` is quoted, since bare it is an operator."""
    return F.array_join(F.transform(tokens, lambda t: F.when(t == "or", '"or"').otherwise(t)), " ")


def short_questions(spark, sf):
    """The first six telling words of every tenth chunk, as questions."""
    from lodestone.operators.training import synthetic_queries

    made = synthetic_queries(V.stored_chunks(spark, sf)).filter(F.pmod(F.xxhash64("chunk_id"), F.lit(10)) == 0)
    return made.select(F.xxhash64("chunk_id").alias("query_id"), F.lit("t0").alias("tenant_id"), bare_words(F.split("query", " ")).alias("query"))


def index_search(spark, sf, asked, scoring="cover_density", source_kinds=None):
    """Search of the stored index of plain words, as the SQL reads them."""
    return Search(V.corpus_index(spark, sf, "simple", blurb=False), asked, scoring, source_kinds)


def passage_labels(spark, sf):
    """(query_id, chunk_id): chunks in which the passage occurs word for word."""
    asked = V.queries(spark, sf).withColumn(
        "query", F.concat(F.lit('"'), F.array_join(X.fulltext_tokens("query"), " "), F.lit('"'))
    )
    return index_search(spark, sf, asked).matches().select("query_id", "chunk_id")


def centroids(spark, sf):
    """Mean vector of each label, as one query per label."""
    at = V.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = at.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector")
    ).select(F.col("label").cast("long").alias("query_id"), F.lit("t0").alias("tenant_id"), "vector")


def vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.lit("t0").alias("tenant_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
        F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("source_kind"), "label",
    )


CENTROID_SQL = """
means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
cents AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS v FROM means GROUP BY 1),
cos AS (SELECT query_id, vec_id AS chunk_id, e.label,
   list_dot_product(v, embedding::DOUBLE[]) / sqrt(list_dot_product(v, v) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score
   FROM cents, embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos)"""


@query(
    "emb_03_dense_topk",
    f"WITH {CENTROID_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
)
def dense_topk(spark, sf):
    hits = D.dense_topk(centroids(spark, sf), vectors(spark, sf), 10)
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "emb_03_dense_topk_kinds",
    f"""WITH {CENTROID_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r
      FROM cos WHERE label % 2 = 1) SELECT query_id, chunk_id, r AS rank FROM k WHERE r <= 5""",
)
def dense_topk_kinds(spark, sf):
    hits = D.dense_topk(centroids(spark, sf), vectors(spark, sf), 5, source_kinds=["odd"])
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    "emb_04_full_ranking",
    f"WITH {CENTROID_SQL} SELECT query_id, chunk_id, rank FROM ranked",
)
def full_ranking(spark, sf):
    hits = D.full_ranking(centroids(spark, sf), vectors(spark, sf))
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("emb_02_model_embedder")
def model_embedder(spark, sf):
    """A stand-in model: letter frequencies, scaled to unit length."""

    def load():
        import numpy as np

        def encode(texts):
            out = np.zeros((len(texts), 26), dtype=np.float32)
            for i, t in enumerate(texts):
                codes = np.frombuffer(str(t).lower().encode(), dtype=np.uint8)
                out[i] = np.bincount(codes[(codes >= 97) & (codes <= 122)] - 97, minlength=26)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, norms, out=out, where=norms > 0)

        return encode

    docs = V.documents(spark, sf).select("doc_id", model_vector(load, "text").alias("v"))
    return docs.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


@query("emb_05_approximate_recall", "SELECT count(*)::BIGINT AS n_queries, true AS recall_reached FROM embeddings WHERE vec_id % 20 = 0")
def approximate_recall(spark, sf):
    """Every 20th vector against all vectors, as it is by default, held against the exact search."""
    corpus = vectors(spark, sf)
    asked = corpus.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "tenant_id", "vector")
    reached = D.recall_against(D.approximate_topk(asked, corpus, 10), D.dense_topk(asked, corpus, 10))
    return reached.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"))


@query(
    "emb_06_tenant_layout",
    f"WITH {CENTROID_SQL} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 10",
)
def tenant_layout(spark, sf):
    """The same top-k through the block layout used for large query tables."""
    pairs = D.blocked_topk(centroids(spark, sf), vectors(spark, sf), 10, ["tenant_id"], "chunk_id", 4, 200)
    return D._ranked(pairs, 10, "chunk_id").select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


# --- full text ---------------------------------------------------------------

WORDS_SQL = rf"""
words AS (SELECT chunk_id, source_kind, x.t AS term, x.p AS pos FROM (
   SELECT chunk_id, source_kind, unnest(list_transform(regexp_extract_all(lower(text), '{TOKENS}'), lambda t, i: {{'t': t, 'p': i - 1}})) AS x FROM chunks))"""

WEB_SQL = rf"""
toks AS (SELECT item_id, t, CAST(ceil(len(t) / 2.0) AS BIGINT) AS h FROM (
  SELECT item_id, regexp_extract_all(lower(text), '{TOKENS}') AS t FROM benchmark)),
items AS (
  SELECT item_id * 10 AS query_id, 0 AS grp, unnest(t) AS term, FALSE AS neg FROM toks
  UNION ALL SELECT item_id * 10 + 2, 0, unnest(t[1:h]), FALSE FROM toks
  UNION ALL SELECT item_id * 10 + 2, 1, unnest(t[h + 1:]), FALSE FROM toks
  UNION ALL SELECT item_id * 10 + 3, 0, unnest(t[h + 1:]), FALSE FROM toks
  UNION ALL SELECT item_id * 10 + 3, 0, t[1], TRUE FROM toks),
bare AS (SELECT DISTINCT query_id, grp, term, neg FROM items),
occ AS (
  SELECT b.query_id, w.chunk_id, b.grp, b.term AS item, b.neg, w.pos AS s, w.pos AS e, 1 AS n FROM bare b JOIN words w USING (term)
  UNION ALL
  SELECT item_id * 10 + 1, chunk_id, 0, 'phrase', FALSE, s, s + n - 1, n FROM (
    SELECT k.item_id, w.chunk_id, w.pos - k.i AS s, max(k.n) AS n
    FROM (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS i, len(t) AS n FROM toks) k JOIN words w USING (term)
    GROUP BY 1, 2, 3 HAVING count(*) = max(k.n)))"""

COVER_SQL = r"""
need AS (SELECT query_id, grp, count(DISTINCT term) FILTER (NOT neg) AS need FROM bare GROUP BY 1, 2
         UNION ALL SELECT item_id * 10 + 1, 0, 1 FROM toks),
ok AS (SELECT DISTINCT query_id, chunk_id FROM (
   SELECT o.query_id, o.chunk_id, o.grp FROM occ o JOIN need USING (query_id, grp)
   GROUP BY 1, 2, 3, need.need HAVING count(DISTINCT item) FILTER (NOT neg) = need.need AND NOT bool_or(neg))),
pos AS (SELECT occ.* FROM occ JOIN ok USING (query_id, chunk_id) WHERE NOT neg),
latest AS (SELECT a.query_id, a.chunk_id, a.e, b.grp, b.item, max(b.s) AS s
   FROM (SELECT DISTINCT query_id, chunk_id, e FROM pos) a
   JOIN pos b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.e <= a.e GROUP BY 1, 2, 3, 4, 5),
opened AS (SELECT query_id, chunk_id, e, max(s) AS s FROM (
   SELECT l.query_id, l.chunk_id, l.e, l.grp, min(l.s) AS s FROM latest l JOIN need USING (query_id, grp)
   GROUP BY 1, 2, 3, 4, need.need HAVING count(*) = need.need) GROUP BY 1, 2, 3),
covers AS (SELECT * FROM (SELECT *, lag(s) OVER (PARTITION BY query_id, chunk_id ORDER BY e) AS prev FROM opened) WHERE prev IS NULL OR s > prev),
inside AS (SELECT c.query_id, c.chunk_id, c.s, c.e, sum(p.n) AS hits FROM covers c
   JOIN (SELECT query_id, chunk_id, e, min(s) AS s, max(n) AS n FROM pos GROUP BY 1, 2, 3) p
     ON p.query_id = c.query_id AND p.chunk_id = c.chunk_id AND p.s >= c.s AND p.e <= c.e GROUP BY 1, 2, 3, 4),
scored AS (SELECT query_id, chunk_id, CAST(CAST(sum(0.1::DOUBLE / (1 + greatest(e - s + 1 - hits, 0))) AS FLOAT) AS DOUBLE) AS score FROM inside GROUP BY 1, 2)"""


def web_queries(spark, sf):
    """Per passage: all its words and-ed, as a phrase, its halves as alternatives, and the later half without the first word."""
    t = X.fulltext_tokens("query")
    h = F.ceil(F.size(t) / 2).cast("int")
    early, late = F.slice(t, F.lit(1), h), F.slice(t, h + 1, F.size(t))
    forms = [
        bare_words(t),
        F.concat(F.lit('"'), F.array_join(t, " "), F.lit('"')),
        F.concat_ws(" OR ", bare_words(early), bare_words(late)),
        F.concat_ws(" -", bare_words(late), bare_words(F.slice(t, 1, 1))),
    ]
    return (
        V.queries(spark, sf)
        .select("query_id", "tenant_id", F.posexplode(F.array(*forms)).alias("form", "query"))
        .withColumn("query_id", F.col("query_id") * 10 + F.col("form"))
    )


@query(
    "spr_03_web_query",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {WORDS_SQL}, {WEB_SQL}, {COVER_SQL} SELECT query_id, chunk_id FROM ok""",
)
def web_query(spark, sf):
    return index_search(spark, sf, web_queries(spark, sf)).matches().select("query_id", "chunk_id")


@query(
    "spr_04_rank_and_cut",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {WORDS_SQL}, {WEB_SQL}, {COVER_SQL},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
    SELECT query_id, chunk_id, rank FROM r WHERE rank <= 10""",
)
def rank_and_cut(spark, sf):
    hits = index_search(spark, sf, web_queries(spark, sf)).topk(10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    "spr_05_cover_density",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {WORDS_SQL}, {WEB_SQL}, {COVER_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM scored""",
)
def cover_density(spark, sf):
    hits = index_search(spark, sf, web_queries(spark, sf)).matches()
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "spr_05_bm25",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {WORDS_SQL},
    q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS term FROM benchmark),
    tf AS (SELECT query_id, chunk_id, term, count(*) AS tf FROM q JOIN words USING (term) GROUP BY 1, 2, 3),
    df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
    len AS (SELECT c.chunk_id, coalesce(n, 0) AS n FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM words GROUP BY 1) USING (chunk_id)),
    st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM len),
    need AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)
    SELECT query_id, chunk_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score
    FROM tf JOIN df USING (query_id, term) JOIN len USING (chunk_id) JOIN need USING (query_id), st
    GROUP BY query_id, chunk_id, need HAVING count(*) = need""",
)
def bm25(spark, sf):
    asked = web_queries(spark, sf).filter(F.col("form") == 0).withColumn("query_id", (F.col("query_id") / 10).cast("long"))
    hits = index_search(spark, sf, asked, "bm25").matches()
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


ENGLISH_SQL = stems_sql(rf"SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS word FROM documents")


@query("spr_02_english_terms", f"WITH {ENGLISH_SQL} SELECT word, stem AS term FROM stems")
def english_terms(spark, sf):
    """Every word of the documents that is not a stop word, and its index term."""
    raw = X.fulltext_tokens("text")
    pairs = V.documents(spark, sf).select(F.explode(F.arrays_zip(raw.alias("word"), S._terms(raw, "english").alias("term"))).alias("p"))
    return pairs.select("p.word", "p.term").filter("term IS NOT NULL").distinct()


# --- fusion and hybrid -------------------------------------------------------

DENSE_SQL = rf"""
qs AS ({V.SLOTS_SQL.format(key='item_id', text='text', source='benchmark')}),
cs AS ({V.SLOTS_SQL.format(key='chunk_id', text='text', source='chunks')}),
qn AS (SELECT item_id, sum(value * value)::DOUBLE AS n FROM qs GROUP BY 1),
cn AS (SELECT chunk_id, sum(value * value)::DOUBLE AS n FROM cs GROUP BY 1),
dots AS (SELECT item_id, chunk_id, sum(qs.value * cs.value)::DOUBLE AS dot FROM qs JOIN cs USING (slot) GROUP BY 1, 2),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
   SELECT b.item_id AS query_id, c.chunk_id, CASE WHEN qn.n * cn.n > 0 THEN coalesce(dot, 0) / sqrt(qn.n * cn.n) ELSE 0.0 END AS score
   FROM benchmark b CROSS JOIN chunks c LEFT JOIN qn ON qn.item_id = b.item_id LEFT JOIN cn ON cn.chunk_id = c.chunk_id
   LEFT JOIN dots d ON d.item_id = b.item_id AND d.chunk_id = c.chunk_id)
   QUALIFY rank <= 50)"""

PASSAGE_SQL = rf"""
toks AS (SELECT item_id, regexp_extract_all(lower(text), '{TOKENS}') AS t FROM benchmark),
bare AS (SELECT DISTINCT item_id AS query_id, 0 AS grp, unnest(t) AS term, FALSE AS neg FROM toks),
occ AS (SELECT b.query_id, w.chunk_id, b.grp, b.term AS item, b.neg, w.pos AS s, w.pos AS e, 1 AS n FROM bare b JOIN words w USING (term)),
"""
SPARSE_SQL = PASSAGE_SQL + COVER_SQL.replace("UNION ALL SELECT item_id * 10 + 1, 0, 1 FROM toks", "") + r""",
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 50)"""

FUSED_SQL = r"""
both_lists AS (SELECT query_id, chunk_id, rank, 0 AS l FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM sparse),
rrf AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l) AS first_list FROM both_lists GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf)"""

HYBRID_SQL = f"{V.CORPUS_CHUNKS_SQL}, {WORDS_SQL}, {DENSE_SQL}, {SPARSE_SQL}, {FUSED_SQL}"


def legs(spark, sf):
    raw = V.queries(spark, sf).select("query_id", "tenant_id", hashing_vector("query").alias("vector"))
    return D.dense_topk(raw, V.stored_chunks(spark, sf), 50), index_search(spark, sf, plain_queries(spark, sf)).topk(50)


@query("fus_01_rrf", f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fused")
def rrf(spark, sf):
    dense, sparse = legs(spark, sf)
    fused = fusion.reciprocal_rank_fusion([dense, sparse])
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "fus_02_first_list_wins",
    f"WITH {HYBRID_SQL} SELECT query_id, chunk_id, CASE first_list WHEN 0 THEN 'dense' ELSE 'sparse' END AS leg FROM rrf",
)
def first_list_wins(spark, sf):
    dense, sparse = legs(spark, sf)
    return fusion.first_list_wins(
        [dense.withColumn("leg", F.lit("dense")), sparse.withColumn("leg", F.lit("sparse"))], ["leg"]
    ).drop("tenant_id")


RERANK_SQL = rf"""
pair AS (SELECT f.query_id, f.chunk_id, f.score,
   len(list_intersect(qt, ct))::DOUBLE / len(qt) AS p
   FROM fused f JOIN (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(array_to_string(t, ' ')), '[a-z0-9$]+'), lambda x: len(x) > 1 AND NOT list_contains(STOPS, x))) AS qt FROM toks) USING (query_id)
   JOIN (SELECT chunk_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9$]+'), lambda x: len(x) > 1 AND NOT list_contains(STOPS, x))) AS ct FROM chunks) USING (chunk_id)
   WHERE f.rank <= 50)""".replace("STOPS", "[" + ",".join(f"'{w}'" for w in X.fv.FAITH_STOPWORDS) + "]")


@query(
    "fus_03_rerank_pairs",
    f"""WITH {HYBRID_SQL}, {RERANK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, chunk_id) AS rank FROM pair)
    SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM r WHERE rank <= 10""",
)
def rerank_pairs(spark, sf):
    """Lexical pair score: share of the query's content words found in the chunk."""
    dense, sparse = legs(spark, sf)
    fused = fusion.reciprocal_rank_fusion([dense, sparse]).filter(F.col("rank") <= 50)
    pairs = fused.join(V.corpus_chunks(spark, sf).select("chunk_id", "text"), "chunk_id").join(
        plain_queries(spark, sf).select("query_id", "query"), "query_id"
    )
    score = X.coverage(X.salient("query"), X.salient("text"))
    top = fusion.rerank(pairs, 10, "bge", score)
    return top.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def hybrid(spark, sf, k=10, **options):
    return hybrid_search(plain_queries(spark, sf), V.stored_chunks(spark, sf), k, index=V.corpus_index(spark, sf, "simple", False), **options)


@query(
    "fus_04_hybrid_search",
    f"""WITH {HYBRID_SQL.replace("text='text', source='benchmark'", "")} SELECT query_id, chunk_id, source_kind, artifact_id, created_s AS created_at, round(score, 9) AS score, rank
    FROM fused JOIN chunks USING (chunk_id) WHERE rank <= 10""",
)
def hybrid_hits(spark, sf):
    hits = hybrid(spark, sf)
    return hits.select(
        "query_id", "chunk_id", "source_kind", "artifact_id", F.unix_timestamp("created_at").alias("created_at"),
        F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"),
    )


@query(
    "fus_04_dense_mode",
    f"WITH {V.CORPUS_CHUNKS_SQL}, {DENSE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense WHERE rank <= 100",
)
def dense_mode(spark, sf):
    hits = hybrid(spark, sf, k=100, mode="dense")
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# The default of search: English terms, and each chunk's blurb before its text.
SITUATED_SQL = rf"""{V.CORPUS_CHUNKS_SQL}, {V.HEAD_SQL},
blurbed AS (SELECT c.* EXCLUDE (text), {V.BLURB_SQL} || ' ' || c.text AS text FROM chunks c JOIN heads h USING (artifact_id)),
{stems_sql(rf"SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS word FROM blurbed UNION ALL SELECT unnest(regexp_extract_all(lower(text), '{TOKENS}')) FROM benchmark")},
raw_words AS ({WORDS_SQL.split("words AS (", 1)[1].rstrip()[:-1].replace("FROM chunks", "FROM blurbed")}),
words AS (SELECT chunk_id, source_kind, stem AS term, pos FROM raw_words JOIN stems ON word = term),
asked_terms AS (SELECT DISTINCT item_id, stem FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS word FROM benchmark) JOIN stems USING (word))"""
SITUATED_SPARSE_SQL = SPARSE_SQL.replace(
    "SELECT DISTINCT item_id AS query_id, 0 AS grp, unnest(t) AS term, FALSE AS neg FROM toks", "SELECT item_id AS query_id, 0 AS grp, stem AS term, FALSE AS neg FROM asked_terms"
)


@query("spr_04_english_blurb", f"WITH {SITUATED_SQL}, {SITUATED_SPARSE_SQL} SELECT query_id, chunk_id, rank FROM sparse WHERE rank <= 10")
def english_blurb(spark, sf):
    hits = Search(V.corpus_index(spark, sf), plain_queries(spark, sf)).topk(10)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query(
    "fus_04_hybrid_default",
    f"""WITH {SITUATED_SQL}, {DENSE_SQL.replace("FROM chunks)", "FROM blurbed)").replace("CROSS JOIN chunks c", "CROSS JOIN blurbed c")}, {SITUATED_SPARSE_SQL}, {FUSED_SQL}
    SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM fused WHERE rank <= 10""",
)
def hybrid_default(spark, sf):
    """Search as it is by default: English index with blurbs, vectors of situated text."""
    chunks = V.stored_chunks(spark, sf).drop("vector").withColumnRenamed("situated", "vector")
    hits = hybrid_search(plain_queries(spark, sf), chunks, 10, index=V.corpus_index(spark, sf))
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# --- evaluation --------------------------------------------------------------

LABELS_SQL = rf"""
chunk_words AS (SELECT chunk_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{TOKENS}'), ' ') || ' ' AS t FROM chunks),
labels_v AS (SELECT item_id AS query_id, chunk_id FROM chunk_words JOIN
   (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{TOKENS}'), ' ') || ' ' AS q FROM benchmark) ON contains(t, q)),
n_rel AS (SELECT query_id, count(*) AS n FROM labels_v GROUP BY 1)"""

METRICS_SQL = (
    r"""
found AS (SELECT l.query_id, l.chunk_id, f.rank FROM labels_v l LEFT JOIN (SELECT * FROM fused WHERE rank <= 20) f USING (query_id, chunk_id)),
labelled AS (SELECT query_id, coalesce(1.0 / min(rank), 0) AS mrr"""
    + "".join(
        f""", count(*) FILTER (rank <= {k}) / count(*) AS recall_at_{k},
      coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(count(*), {k}) + 1) r(i)) AS ndcg_at_{k}"""
        for k in (5, 10, 20)
    )
    + " FROM found GROUP BY query_id),\n"
    + "per_query AS (SELECT item_id AS query_id, coalesce(mrr, 0) AS mrr"
    + "".join(f", coalesce({m}_at_{k}, 0) AS {m}_at_{k}" for k in (5, 10, 20) for m in ("recall", "ndcg"))
    + " FROM benchmark LEFT JOIN labelled ON labelled.query_id = item_id)"
)
METRICS_SQL = METRICS_SQL.replace(
    "(SELECT sum(1 / log2(i + 1)) FROM range(1, least(count(*), 5) + 1) r(i))", "list_sum(list_transform(range(1, least(count(*), 5) + 1), lambda i: 1 / log2(i + 1)))"
).replace(
    "(SELECT sum(1 / log2(i + 1)) FROM range(1, least(count(*), 10) + 1) r(i))", "list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1)))"
).replace(
    "(SELECT sum(1 / log2(i + 1)) FROM range(1, least(count(*), 20) + 1) r(i))", "list_sum(list_transform(range(1, least(count(*), 20) + 1), lambda i: 1 / log2(i + 1)))"
)
EVAL_SQL = f"{HYBRID_SQL}, {LABELS_SQL}, {METRICS_SQL}"


def evaluated(spark, sf):
    asked = plain_queries(spark, sf)
    hits = hybrid(spark, sf, 20)
    return E.unlabelled(E.query_metrics(hits, passage_labels(spark, sf)), asked.select("query_id"))


@query("evl_01_recall", f"WITH {EVAL_SQL} SELECT query_id, round(recall_at_5, 6) AS recall_at_5, round(recall_at_10, 6) AS recall_at_10 FROM per_query")
def recall(spark, sf):
    return evaluated(spark, sf).select("query_id", F.round("recall_at_5", 6).alias("recall_at_5"), F.round("recall_at_10", 6).alias("recall_at_10"))


@query("evl_02_mrr", f"WITH {EVAL_SQL} SELECT query_id, round(mrr, 6) AS mrr FROM per_query")
def mrr(spark, sf):
    return evaluated(spark, sf).select("query_id", F.round("mrr", 6).alias("mrr"))


@query("evl_03_ndcg", f"WITH {EVAL_SQL} SELECT query_id, round(ndcg_at_5, 6) AS ndcg_at_5, round(ndcg_at_10, 6) AS ndcg_at_10 FROM per_query")
def ndcg(spark, sf):
    return evaluated(spark, sf).select("query_id", F.round("ndcg_at_5", 6).alias("ndcg_at_5"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


@query(
    "evl_04_resolve_labels",
    f"""WITH {V.CORPUS_CHUNKS_SQL}, {LABELS_SQL} SELECT query_id, external_id, ordinal::BIGINT AS ordinal, chunk_id FROM labels_v JOIN chunks USING (chunk_id)""",
)
def resolve_labels(spark, sf):
    chunks = V.stored_chunks(spark, sf)
    stable = passage_labels(spark, sf).join(chunks, "chunk_id").select("query_id", "external_id", "ordinal")
    return E.resolve_labels(stable, chunks).select("query_id", "external_id", "ordinal", "chunk_id")


LONG_SQL = "SELECT metric, round(avg(value), 6) AS value FROM (UNPIVOT (SELECT * EXCLUDE query_id FROM per_query) ON COLUMNS(*) INTO NAME metric VALUE value) GROUP BY 1"


@query("evl_05_retrieval_run", f"WITH {EVAL_SQL} {LONG_SQL}")
def retrieval_run(spark, sf):
    return E.long_metrics(evaluated(spark, sf)).select("metric", F.round("value", 6).alias("value"))


@query(
    "evl_06_embedder",
    f"""WITH {CENTROID_SQL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT query_id, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(count(*) FILTER (rank <= 20) / max(n), 6) AS recall_at_20
    FROM ranked JOIN n ON n.label = query_id WHERE ranked.label = query_id GROUP BY query_id""",
)
def embedder(spark, sf):
    """Label centroids as queries; every vector of that label is relevant."""
    corpus = vectors(spark, sf)
    asked, labels = centroids(spark, sf), corpus.select(F.col("label").cast("long").alias("query_id"), "chunk_id")
    return E.embedder_metrics(asked, corpus, labels, 20).select(
        "query_id", F.round("mrr", 6).alias("mrr"), F.round("recall_at_20", 6).alias("recall_at_20")
    )


def sparse_metrics(spark, sf):
    """The full-text leg alone, as a second run to compare with."""
    asked = plain_queries(spark, sf)
    hits = index_search(spark, sf, asked).topk(20)
    return E.unlabelled(E.query_metrics(hits, passage_labels(spark, sf)), asked.select("query_id"))


TWO_RUNS_SQL = f"""{EVAL_SQL}, found2 AS (SELECT l.query_id, l.chunk_id, s.rank FROM labels_v l LEFT JOIN (SELECT * FROM sparse WHERE rank <= 20) s USING (query_id, chunk_id)),
{METRICS_SQL[METRICS_SQL.index('labelled AS'):].replace('per_query', 'per_query2').replace('labelled', 'labelled2').replace('FROM found ', 'FROM found2 ')},
cur AS ({LONG_SQL.replace('round(avg(value), 6)', 'avg(value)')}), prev AS ({LONG_SQL.replace('round(avg(value), 6)', 'avg(value)').replace('per_query', 'per_query2')})"""


@query(
    "evl_07_report",
    f"""WITH {TWO_RUNS_SQL} SELECT metric, round(cur.value, 6) AS value, round(cur.value - prev.value, 6) AS delta FROM cur LEFT JOIN prev USING (metric)""",
)
def report(spark, sf):
    now, before = E.long_metrics(evaluated(spark, sf)), E.long_metrics(sparse_metrics(spark, sf))
    return E.report_deltas(now, before).select("metric", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


@query("evl_07_worst_queries", f"WITH {EVAL_SQL} SELECT query_id, round(mrr, 6) AS mrr FROM per_query ORDER BY per_query.mrr, query_id LIMIT 5")
def worst_queries(spark, sf):
    return E.worst_queries(evaluated(spark, sf)).select("query_id", F.round("mrr", 6).alias("mrr"))


@query(
    "evl_08_gate",
    f"""WITH {EVAL_SQL}, m AS ({LONG_SQL.replace('round(avg(value), 6)', 'avg(value)')}),
    f AS (SELECT count(*) AS n FROM m JOIN (VALUES ('recall_at_10', 0.85), ('ndcg_at_10', 0.70)) t(metric, threshold) USING (metric) WHERE value < threshold)
    SELECT 'blocking' AS mode, n = 0 AS passed, n AS n_failures FROM f UNION ALL SELECT 'advisory', TRUE, n FROM f""",
)
def gate(spark, sf):
    metrics = E.long_metrics(evaluated(spark, sf))
    return (
        E.gate(metrics, "blocking").unionByName(E.gate(metrics, "advisory"))
        .select("mode", "passed", F.size("failures").cast("long").alias("n_failures"))
    )


@query(
    "evl_09_ab",
    f"""WITH {TWO_RUNS_SQL}, d AS (SELECT coalesce(cur.metric, prev.metric) AS metric, coalesce(cur.value, 0) - coalesce(prev.value, 0) AS delta FROM cur FULL JOIN prev USING (metric))
    SELECT round(max(delta) FILTER (metric = 'recall_at_10'), 6) AS d_recall, round(max(delta) FILTER (metric = 'ndcg_at_10'), 6) AS d_ndcg,
      max(delta) FILTER (metric = 'recall_at_10') >= 0.05 - 1e-9 AND max(delta) FILTER (metric = 'ndcg_at_10') >= 0.03 - 1e-9 AS passed FROM d""",
)
def ab(spark, sf):
    base, candidate = E.long_metrics(sparse_metrics(spark, sf)), E.long_metrics(evaluated(spark, sf))
    verdict = E.ab_verdict(E.ab_deltas(base, candidate))
    return verdict.select(F.round("d_recall", 6).alias("d_recall"), F.round("d_ndcg", 6).alias("d_ndcg"), "passed")


@query(
    "evl_14_latency",
    r"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, n::BIGINT AS requests, round(max(value) FILTER (i = least(n - 1, floor(0.5 * n))), 6) AS p50_ms,
      round(max(value) FILTER (i = least(n - 1, floor(0.95 * n))), 6) AS p95_ms, round(max(value) FILTER (i = least(n - 1, floor(0.99 * n))), 6) AS p99_ms,
      round(max(value), 6) AS max_ms, round(avg(value), 6) AS mean_ms, round(n / 3600.0, 6) AS throughput_rps
    FROM r GROUP BY event_type, n""",
)
def latency(spark, sf):
    out = E.latency_summary(V.table(spark, sf, "events"), ["event_type"], 3600.0, ms="value")
    return out.select("event_type", "requests", *[F.round(c, 6).alias(c) for c in out.columns if c.endswith(("ms", "rps"))])
