"""Dense retrieval: exact cosine top-k, and approximate top-k by a coarse quantiser.

Exact top-k needs every (query, vector) score once.  It is done as block matrix
products inside tasks that hand on only their own best ``k`` per query:

* a query table under a counted bound is sent to every task, and the corpus is
  scanned once, in place, with no shuffle of vectors;
* a larger one is cut, with the corpus, into blocks of bounded size per key, and
  each pair of blocks meets in one task; the blocks travel as compressed packs.  A hot tenant or bucket simply has more
  blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone import fixed_values as fv
from lodestone.functions import ids
from lodestone.session import broadcast_if_small, cut_lineage

QUERY_BOUND = 4096
QUERY_BLOCK = 2048
CORPUS_BLOCK = 16384
TRAIN_PER_CELL = 64
CENTRE_BYTES = 256 << 20
PACKED_QUERIES = 16384
PACKED_CORPUS = 262144
WIDTH = 8192
CALIBRATION = 256
RECALL = 0.95
_CELLS = 8_000_000
_PAIRS = 16384
_NEAR = 1_000_000


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(pairs: pa.Table, k: int) -> pa.Table:
    """Best ``k`` rows per query by score, then id."""
    order = pc.sort_indices(
        pairs, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")]
    )
    pairs = pairs.take(order)
    q = pairs["q"].to_numpy()
    first = np.searchsorted(q, q, side="left")
    return pairs.filter(pa.array(np.arange(len(q)) - first < k))


class _Best:
    """The running best ``k`` rows of each query over blocks of vectors.

    Single-precision cosines only sort out what cannot be among the best, with a
    margin above their error; what passes is scored in double precision.  Queries
    of few components (short texts, hashed) are scored on these alone.
    """

    def __init__(self, matrix: np.ndarray, k: int):
        self.matrix, self.k, self.dim = matrix, k, matrix.shape[1]
        self.norms = (matrix * matrix).sum(axis=1)
        lengths = np.sqrt(self.norms)[:, None]
        self.unit = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0).astype(np.float32)
        self.margin = np.float32((self.dim + 8) * 1.2e-7)
        self.kth = np.full(len(matrix), -np.inf)
        used = int((matrix != 0).sum(axis=1).max(initial=0))
        self.slots = None
        if 0 < used <= self.dim // 8:
            self.slots = np.argsort(matrix == 0, axis=1, kind="stable")[:, :used]
            self.unit = np.take_along_axis(self.unit, self.slots, axis=1)
            self.matrix = np.take_along_axis(matrix, self.slots, axis=1)
        self.held, self.waiting, self.n_held, self.n_waiting = None, [], 0, 0
        self.blocks, self.n_rows = [], 0

    def add(self, ids_: pa.Array, vectors: np.ndarray) -> None:
        self.blocks.append((ids_, vectors))
        self.n_rows += len(ids_)
        if self.n_rows >= WIDTH:
            self._flush()

    def result(self) -> pa.Table | None:
        """(q, id, score), at most ``k`` rows a query; None where nothing was added."""
        self._flush()
        self._settle()
        return self.held

    def _flush(self) -> None:
        if not self.n_rows:
            return
        names = pa.concat_arrays([_flat(i) for i, _ in self.blocks])
        vectors = np.concatenate([v for _, v in self.blocks])
        self.blocks, self.n_rows = [], 0
        for start in range(0, len(names), WIDTH):
            self._score(names.slice(start, WIDTH), vectors[start : start + WIDTH].astype(np.float64))

    def _score(self, names: pa.Array, block: np.ndarray) -> None:
        norms = (block * block).sum(axis=1)
        lengths = np.sqrt(norms)[:, None]
        across = np.ascontiguousarray(np.divide(block, lengths, out=np.zeros_like(block), where=lengths > 0).T.astype(np.float32))
        step = max(1, _CELLS // len(block))
        for start in range(0, len(self.norms), step):
            near = None if self.slots is not None else self.unit[start : start + step] @ across
            qs, cs = [], []
            for q in range(start, min(start + step, len(self.norms))):
                row = near[q - start] if near is not None else self.unit[q] @ across[self.slots[q]]
                at = np.flatnonzero(row >= self.kth[q] - self.margin) if self.kth[q] > -np.inf else np.arange(len(row))
                if len(at) > 4 * self.k:
                    own = row[at]
                    at = at[own >= np.partition(own, len(own) - self.k)[len(own) - self.k] - 2 * self.margin]
                if len(at):
                    qs.append(np.full(len(at), q))
                    cs.append(at)
            if qs:
                self._keep(names, block, norms, np.concatenate(qs), np.concatenate(cs))
        self._settle(spare=max(self.n_held, 1 << 16))

    def _keep(self, names, block, norms, qi, ci) -> None:
        for start in range(0, len(qi), _PAIRS):
            q, c = qi[start : start + _PAIRS], ci[start : start + _PAIRS]
            found = block[c] if self.slots is None else block[c[:, None], self.slots[q]]
            dots = np.einsum("ij,ij->i", self.matrix[q], found)
            scale = np.sqrt(self.norms[q] * norms[c])
            scores = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
            good = scores >= self.kth[q]
            self.waiting.append(pa.table({"q": q[good], "id": names.take(pa.array(c[good])), "score": scores[good]}))
            self.n_waiting += int(good.sum())
            self._settle(spare=max(self.n_held, 1 << 18))

    def _settle(self, spare: int = 0) -> None:
        """Cut what is held and what waits to the best; ids are compared only where scores tie at the cut."""
        if not self.waiting or (spare and self.n_waiting < spare and self.held is not None):
            return
        rows = pa.concat_tables([*([self.held] if self.held is not None else []), *self.waiting])
        q, score = rows["q"].to_numpy(), rows["score"].to_numpy()
        order = np.lexsort((-score, q))
        q, score = q[order], score[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        last = first + self.k - 1
        full = (last < len(q)) & (q[np.minimum(last, len(q) - 1)] == q)
        cut = np.where(full, score[np.minimum(last, len(q) - 1)], -np.inf)
        stays = (place < self.k) | (score == cut)
        self.kth[q[full]] = cut[full]
        rows = rows.take(pa.array(order[stays]))
        crowded = np.bincount(q[stays], minlength=len(self.kth))[q[stays]] > self.k
        if crowded.any():
            rows = pa.concat_tables([rows.filter(pa.array(~crowded)), _best(rows.filter(pa.array(crowded)), self.k)])
        self.held, self.n_held = rows.combine_chunks(), rows.num_rows
        self.waiting, self.n_waiting = [], 0


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _schema(queries: DataFrame, corpus: DataFrame, key: str, id_col: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("tenant_id", corpus.schema["tenant_id"].dataType),
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(id_col, corpus.schema[id_col].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _ranked(pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    w = Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("score"), F.asc(id_col))
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan(queries_rows, corpus: DataFrame, k: int, id_col: str, schema) -> DataFrame:
    by_tenant: dict = {}
    for row in queries_rows:
        by_tenant.setdefault(row["tenant_id"], []).append((row["query_id"], row["vector"]))
    packed = {
        t: ([q for q, _ in rows], np.array([v for _, v in rows], dtype=np.float64))
        for t, rows in by_tenant.items()
    }
    shared = corpus.sparkSession.sparkContext.broadcast(packed)
    arrow = pa.schema(
        [
            ("tenant_id", to_arrow_type(schema["tenant_id"].dataType)),
            ("query_id", to_arrow_type(schema["query_id"].dataType)),
            (id_col, to_arrow_type(schema[id_col].dataType)),
            ("score", pa.float64()),
        ]
    )

    def run(batches):
        best: dict = {}
        for batch in batches:
            tenants = batch.column("tenant_id")
            for tenant in pc.unique(tenants).to_pylist():
                held = shared.value.get(tenant)
                if held is None:
                    continue
                part = batch.filter(pc.equal(tenants, tenant))
                if tenant not in best:
                    best[tenant] = _Best(held[1], k)
                best[tenant].add(part.column(id_col), _matrix(part.column("vector")))
        for tenant, kept in best.items():
            pairs = kept.result()
            names = pa.array(shared.value[tenant][0], type=arrow.field("query_id").type)
            own = pa.array([tenant] * pairs.num_rows, type=arrow.field("tenant_id").type)
            table = pa.table(
                [own, names.take(_flat(pairs["q"])), _flat(pairs["id"]), _flat(pairs["score"])], schema=arrow
            )
            yield from table.to_batches()

    wanted = [t for t in packed if t is not None]
    narrow = corpus.filter(F.col("tenant_id").isin(wanted)).select("tenant_id", id_col, "vector")
    return narrow.mapInArrow(run, schema)


def blocked(queries: DataFrame, corpus: DataFrame, keys: list[str], id_col: str, meet, schema, query_block: int = QUERY_BLOCK, corpus_block: int = CORPUS_BLOCK) -> DataFrame:
    """``meet(queries, corpus)`` for every pair of bounded blocks with equal ``keys``."""
    queries = queries.toDF(*queries.columns)  # columns of its own, since queries may come from the corpus
    more = [c for c in queries.columns if c not in ("query_id", *keys)]
    nq = queries.groupBy(*keys).agg(F.ceil(F.count("*") / query_block).cast("int").alias("_nq"))
    nc = corpus.groupBy(*keys).agg(F.ceil(F.count("*") / corpus_block).cast("int").alias("_nc"))
    shape = nq.join(nc, keys)

    def spot(column: str, parts: str):
        return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")

    left = (
        queries.join(shape, keys)
        .withColumn("_qb", spot("query_id", "_nq"))
        .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
        .select(*keys, "_qb", "_cb", "query_id", *more)
    )
    right = (
        corpus.join(shape, keys)
        .withColumn("_cb", spot(id_col, "_nc"))
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
        .select(*keys, "_qb", "_cb", id_col, "vector")
    )

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return pa.table([pa.array([], to_arrow_type(f.dataType)) for f in schema], names=schema.names)
        return meet(q, c)

    group = [*keys, "_qb", "_cb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)


def _packed(rows: DataFrame, keys: list[str], spot: str, name: str) -> DataFrame:
    """Rows (keys, ``spot``, ``name``, vector) as compressed packs of a batch's rows with equal keys and spot.

    Vectors of whole numbers up to 127 are packed as bytes; nothing is rounded.
    """
    by = [*keys, spot]
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("names", T.ArrayType(rows.schema[name].dataType)), T.StructField("kind", T.StringType()), T.StructField("size", T.LongType()), T.StructField("pack", T.BinaryType())])
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = table.append_column("_at", pa.array(np.arange(table.num_rows))).group_by(by).aggregate([("_at", "list")])
            for group in groups.to_pylist():
                part = table.take(pa.array(group["_at_list"]))
                vectors = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                if (np.abs(vectors) <= 127).all() and (np.rint(vectors) == vectors).all():
                    vectors = vectors.astype(np.int8)
                raw = np.ascontiguousarray(vectors).tobytes()
                cells = {**{c: group[c] for c in by}, "names": part[name].to_pylist(), "kind": vectors.dtype.str, "size": len(raw), "pack": pa.compress(raw, codec="zstd", asbytes=True)}
                yield pa.RecordBatch.from_arrays([pa.array([cells[n]], t) for n, t in fields], schema=pa.schema(fields))

    return rows.select(*by, name, "vector").mapInArrow(run, schema)


def _unpacked(table: pa.Table):
    """(names, matrix) of each pack."""
    for i in range(table.num_rows):
        names = _flat(table["names"].slice(i, 1)).flatten()
        raw = pa.decompress(table["pack"][i].as_buffer(), table["size"][i].as_py(), codec="zstd")
        yield names, np.frombuffer(raw, dtype=table["kind"][i].as_py()).reshape(len(names), -1)


def blocked_topk(
    queries: DataFrame, corpus: DataFrame, k: int, keys: list[str], id_col: str,
    query_block: int = PACKED_QUERIES, corpus_block: int = PACKED_CORPUS,
) -> DataFrame:
    """Best ``k`` per query within equal ``keys``, by bounded pairs of blocks.

    Blocks travel as compressed packs, so a pair of blocks can be large and a
    vector is copied once for each ``query_block`` queries of its keys.
    """
    queries = queries.toDF(*queries.columns)  # columns of its own, since queries may come from the corpus
    nq = queries.groupBy(*keys).agg(F.ceil(F.count("*") / query_block).cast("int").alias("_nq"))
    nc = corpus.groupBy(*keys).agg(F.ceil(F.count("*") / corpus_block).cast("int").alias("_nc"))
    shape = broadcast_if_small(cut_lineage(nq.join(nc, keys)))
    schema = _schema(queries, corpus, "query_id", id_col)
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def dealt(rows: DataFrame, name: str, own: str, parts: str, other: str, others: str) -> DataFrame:
        spot = F.pmod(F.xxhash64(name), F.col(parts)).cast("int")
        packs = _packed(rows.join(shape, keys).withColumn(own, spot), keys, own, name)
        return packs.join(shape, keys).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_nq", "_nc")

    left = dealt(queries, "query_id", "_qb", "_nq", "_cb", "_nc")
    right = dealt(corpus, id_col, "_cb", "_nc", "_qb", "_nq")

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return arrow.empty_table()
        asked = list(_unpacked(q))
        best = _Best(np.concatenate([m for _, m in asked]).astype(np.float64), k)
        for names, vectors in _unpacked(c):
            best.add(names, vectors)
        pairs, names = best.result(), pa.concat_arrays([n for n, _ in asked])
        own = pa.array([q["tenant_id"][0].as_py()] * pairs.num_rows, arrow.field("tenant_id").type)
        return pa.table([own, names.take(_flat(pairs["q"])), _flat(pairs["id"]), _flat(pairs["score"])], schema=arrow)

    group = [*keys, "_qb", "_cb"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = fv.SEARCH_K,
    source_kinds=None,
    id_col: str = "chunk_id",
    query_bound: int = QUERY_BOUND,
) -> DataFrame:
    """Exact cosine top-k per query within its tenant.

    ``queries``: query_id, tenant_id, vector.  ``corpus``: tenant_id, ``id_col``,
    vector (and source_kind when filtered).  Ties go to the smaller id.
    """
    corpus = ids.of_kinds(corpus, source_kinds)
    queries = queries.select("query_id", "tenant_id", "vector")
    rows = queries.limit(query_bound + 1).collect()
    if len(rows) <= query_bound:
        pairs = _scan(rows, corpus, k, id_col, _schema(queries, corpus, "query_id", id_col))
    else:
        pairs = blocked_topk(queries, corpus, k, ["tenant_id"], id_col)
    return _ranked(pairs, k, id_col)


class Cells:
    """A coarse quantiser: cells around centres, of which a query probes the nearest.

    The centres come from a bounded sample (TRAIN_PER_CELL rows a cell); every row
    is put into the cell of the centre with the largest cosine.  There are about
    as many cells as rows in a cell, so centres and cells grow with the square
    root of the corpus; centres are sent to the tasks, and their size is checked.
    """

    def __init__(self, centres: np.ndarray):
        if centres.nbytes > CENTRE_BYTES:
            raise ValueError(f"{len(centres)} centres take {centres.nbytes} bytes; up to {CENTRE_BYTES} are sent to every task")
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        self.centres = np.divide(centres, norms, out=np.zeros_like(centres), where=norms > 0)

    @classmethod
    def fit(cls, corpus: DataFrame, id_col: str = "chunk_id", cells: int | None = None, seed: int = 42) -> Cells:
        rows = corpus.select(id_col, F.col("vector").cast("array<double>").alias("vector")).filter(F.exists("vector", lambda x: x != 0))
        n = rows.count()
        if n == 0:
            return cls(np.zeros((1, 1)))
        k = cells or max(1, round(n**0.5))
        share = max(1, n // (k * TRAIN_PER_CELL))
        sample = rows.filter(F.pmod(F.xxhash64(id_col), F.lit(share)) == 0)
        model = KMeans(k=k, maxIter=10, seed=seed, distanceMeasure="cosine").fit(sample.select(array_to_vector("vector").alias("features")))
        return cls(np.array(model.clusterCenters()))

    def nearest(self, vector: str, probes: int = 1):
        """The ``probes`` nearest cells of each vector, nearest first; ties go to the smaller number."""
        centres, probes = self.centres, min(probes, len(self.centres))

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def cells(vectors: pa.Array) -> pa.Array:
            if not len(vectors):
                return pa.array([], pa.list_(pa.int32()))
            matrix, step = _matrix(vectors), max(1, _NEAR // len(centres))
            order = np.empty((len(matrix), probes), dtype=np.int32)
            for start in range(0, len(matrix), step):
                away = -(matrix[start : start + step] @ centres.T)
                order[start : start + step] = away.argmin(axis=1)[:, None] if probes == 1 else np.argsort(away, axis=1, kind="stable")[:, :probes]
            offsets = np.arange(0, (len(vectors) + 1) * probes, probes, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(order.ravel()))

        return cells(vector)


def probes_for(cells: Cells, queries: DataFrame, corpus: DataFrame, k: int, recall: float = RECALL, id_col: str = "chunk_id") -> int:
    """How many cells a query must probe to find ``recall`` of its true top-k.

    Measured: up to CALIBRATION queries are answered exactly, and their
    neighbours' cells are looked up in each query's order of cells.
    """
    n = queries.count()
    share = max(1, n // CALIBRATION)
    asked = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(share)) == 0) if share > 1 else queries
    asked = cut_lineage(asked.select("tenant_id", "query_id", "vector"))
    exact = cut_lineage(dense_topk(asked, corpus, k, id_col=id_col).select("tenant_id", "query_id", id_col))
    at = corpus.select("tenant_id", id_col, "vector").join(exact, ["tenant_id", id_col]).select("tenant_id", "query_id", F.get(cells.nearest("vector"), F.lit(0)).alias("cell"))
    order = asked.select("tenant_id", "query_id", cells.nearest("vector", len(cells.centres)).alias("order"))
    place = at.join(order, ["tenant_id", "query_id"]).groupBy(F.array_position("order", F.col("cell")).cast("int").alias("p")).agg(F.count("*").alias("n"))
    counts = sorted((r.p, r.n) for r in place.collect())  # a row for each cell at most
    need, total = recall * sum(n for _, n in counts), 0
    for p, n in counts:
        total += n
        if total >= need:
            return p
    return 1


def approximate_topk(
    queries: DataFrame, corpus: DataFrame, k: int, cells: Cells | None = None, probes: int | None = None,
    recall: float = RECALL, id_col: str = "chunk_id",
) -> DataFrame:
    """Top-k among the vectors of the cells that a query probes, exactly scored.

    Without ``cells`` they are fitted, and without ``probes`` as many are probed
    as reach ``recall`` on a sample of the queries.  ``dense_topk`` is the exact
    way.  A crowded cell is cut into blocks like a large tenant.
    """
    cells = cells or Cells.fit(corpus, id_col)
    probes = probes or probes_for(cells, queries, corpus, k, recall, id_col)
    q = queries.select("query_id", "tenant_id", "vector", F.explode(cells.nearest("vector", probes)).alias("cell"))
    c = corpus.select("tenant_id", id_col, "vector", F.get(cells.nearest("vector"), F.lit(0)).alias("cell"))
    return _ranked(blocked_topk(q, c, k, ["tenant_id", "cell"], id_col), k, id_col)


def ranks_of_marks(queries: DataFrame, corpus: DataFrame, marks: DataFrame, id_col: str = "chunk_id", digits: int = 12) -> DataFrame:
    """(tenant_id, query_id, id, rank): the rank of one corpus row per query, by counting the rows before it.

    ``marks``: tenant_id, query_id, id.  Each pair of blocks counts the rows that
    score higher (or equal, with a smaller id); the counts are summed.  Nothing is
    sorted, and one number per query and block moves.  Scores count as equal when
    they agree in ``digits`` decimals.
    """
    at = marks.join(corpus.select("tenant_id", id_col, F.col("vector").alias("_mark")), ["tenant_id", id_col])
    asked = queries.select("query_id", "tenant_id", "vector").join(at.select("tenant_id", "query_id", F.col(id_col).alias("_id"), "_mark"), ["tenant_id", "query_id"])

    def count(q: pa.Table, c: pa.Table) -> pa.Table:
        matrix, vectors, own = _matrix(q["vector"]), _matrix(c["vector"]), _matrix(q["_mark"])
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        names, mark = c[id_col].to_numpy(zero_copy_only=False), q["_id"].to_numpy(zero_copy_only=False)

        def cosines(dots, others):
            scale = lengths[:, None] * np.sqrt((others * others).sum(axis=-1))
            return np.round(np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0), digits)

        level = cosines((matrix * own).sum(axis=1)[:, None], own[:, None, :])
        before = np.zeros(len(matrix), dtype=np.int64)
        width = max(256, _CELLS // max(1, len(matrix)))
        for start in range(0, len(names), width):
            block, ids_ = vectors[start : start + width], names[start : start + width]
            scores = cosines(matrix @ block.T, block[None, :, :])
            before += ((scores > level) | ((scores == level) & (ids_[None, :] < mark[:, None]))).sum(axis=1)
        return pa.table({"tenant_id": q["tenant_id"], "query_id": q["query_id"], id_col: q["_id"], "before": before})

    schema = T.StructType([*_schema(queries, corpus, "query_id", id_col).fields[:3], T.StructField("before", T.LongType())])
    counts = blocked(asked, corpus, ["tenant_id"], id_col, count, schema)
    return counts.groupBy("tenant_id", "query_id", id_col).agg((F.sum("before") + 1).alias("rank"))


def best_marks(queries: DataFrame, corpus: DataFrame, labels: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(tenant_id, query_id, id): of each query's relevant rows (labels: query_id, id) the best."""
    met = queries.select("query_id", "tenant_id", F.col("vector").alias("_q")).join(labels.select("query_id", id_col).distinct(), "query_id")
    both = met.join(corpus.select("tenant_id", id_col, "vector"), ["tenant_id", id_col])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scale = F.sqrt(dot("_q", "_q") * dot("vector", "vector"))
    score = F.round(F.when(scale > 0, dot("_q", "vector") / scale).otherwise(0.0), 12)
    return both.groupBy("tenant_id", "query_id").agg(F.min(F.struct((-score).alias("s"), id_col)).alias("m")).select("tenant_id", "query_id", f"m.{id_col}")


def full_ranking(queries: DataFrame, corpus: DataFrame, id_col: str = "chunk_id", bins: int = 4096) -> DataFrame:
    """Every corpus row's score and rank for each query of its tenant.

    Rows are ranked inside narrow bins of their score; the counts of the bins
    above give the rest, so no task holds all rows of a query.
    """
    schema = _schema(queries, corpus, "query_id", id_col)

    def score(q: pa.Table, c: pa.Table) -> pa.Table:
        matrix, vectors = _matrix(q["vector"]), _matrix(c["vector"])
        dots = matrix @ vectors.T
        scale = np.sqrt((matrix * matrix).sum(axis=1)[:, None] * (vectors * vectors).sum(axis=1)[None, :])
        scores = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
        qi, ci = (pa.array(x.ravel()) for x in np.indices(scores.shape))
        return pa.table({"tenant_id": _flat(q["tenant_id"]).take(qi), "query_id": _flat(q["query_id"]).take(qi), id_col: _flat(c[id_col]).take(ci), "score": scores.ravel()})

    pairs = blocked(queries.select("query_id", "tenant_id", "vector"), corpus, ["tenant_id"], id_col, score, schema, 64)
    pairs = pairs.withColumn("_bin", F.floor((1 - F.col("score")) * (bins / 2)))
    keys = ["tenant_id", "query_id"]
    above = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = pairs.groupBy(*keys, "_bin").agg(F.count("*").alias("n")).withColumn("_above", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    inside = Window.partitionBy(*keys, "_bin").orderBy(F.desc("score"), F.asc(id_col))
    return pairs.withColumn("_nth", F.row_number().over(inside)).join(counts, [*keys, "_bin"]).select(*keys, id_col, "score", (F.col("_above") + F.col("_nth")).alias("rank"))


def recall_against(found: DataFrame, exact: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Mean share of the exact top-k that an approximate search found."""
    keys = ids.ask_keys(found, exact)
    hit = exact.select(*keys, id_col).join(found.select(*keys, id_col, F.lit(1).alias("hit")), [*keys, id_col], "left")
    per_query = hit.groupBy(*keys).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return per_query.agg(F.avg("recall").alias("recall"), F.count("*").alias("n_queries"))
