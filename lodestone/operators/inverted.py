"""A stored inverted index in segments of bitmap blocks, and top-k search that reads nothing else.

Chunks of a tenant lie in *slabs* of at most 64.  The posting block of a term in
a slab holds one 64-bit mask of the chunks it stands in, its greatest count in
one chunk, and the positions by chunk.  So the and of a query's words is the
bitwise and of a few numbers per slab, found from the light columns alone, from
the rarest word outwards; positions are read only for what passes.

Tables of an index, each with ``segment`` as a partition column:

* ``docs``    tenant_id, slab, at, id, length, source_kind, owner
* ``terms``   tenant_id, term, df (chunks of the segment that hold the term)
* ``blocks``  tenant_id, term, slab, mask, most, postings; partitioned by ``bucket``, sorted by term
* ``gone``    tenant_id, owner: their chunks in earlier segments count no more
* ``manifest/<version>``  one name a segment, in order; the greatest version counts

A segment is written whole, then named in a new manifest, so a reader never sees
half of one, and a batch that is played again overwrites its own segment.  One
writer at a time adds segments.  ``compacted`` merges all segments into one
without the texts, and drops what is gone.

Block-max: a chunk's cover density is at most the weight times the occurrences
of the query's words, and a slab's bound is the sum of its blocks' greatest
counts.  The best-bounded slabs of each query are scored first; slabs whose
bound is under the k-th score found there are never read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import fixed_values as fv
from lodestone.functions.text import fulltext_tokens
from lodestone.operators.sparse import _FULFILLED, cover_density_sql, index_text, indexed, n_terms, parse_queries
from lodestone.session import cut_lineage, name_list, names_in, pinned_if_small, sized

SLAB = 64
GROUP_CHUNKS = 4096
BUCKETS = 32
FIRST_SLABS = 8
PACK_ROWS = 1 << 19
LOOKUP_ROWS = 200_000
LOOKUP_PARTS = 4
QUERY_ROWS = 5_000

DOCS = "tenant_id string, slab bigint, at int, id string, length bigint, source_kind string, owner string"
TERMS = "tenant_id string, term string, df bigint"
POSTINGS = "array<struct<at:int,positions:array<int>>>"
BLOCKS = f"tenant_id string, term string, slab bigint, mask bigint, most int, postings {POSTINGS}, bucket int"
GONE = "tenant_id string, owner string"


def placed(rows: DataFrame, *more: str) -> DataFrame:
    """Add slab and at (and ``_group``, where asked for): at most SLAB rows a slab, by tenant and a hash of ``id``."""
    shape = rows.groupBy(F.col("tenant_id").alias("_t")).agg(F.ceil(F.count("*") / GROUP_CHUNKS).alias("_groups"))
    shape, small = pinned_if_small(shape)  # few tenants go to the rows, so these do not move to their tenant first
    shape = F.broadcast(shape) if small else shape
    dealt = rows.join(shape, F.col("tenant_id").eqNullSafe(F.col("_t"))).withColumn("_group", F.pmod(F.xxhash64("id"), F.col("_groups")))
    nth = F.row_number().over(Window.partitionBy("tenant_id", "_group").orderBy("id")) - 1
    slab = F.col("_group") * (1 << 20) + F.floor(nth / SLAB)
    return dealt.select(*rows.columns, slab.cast("long").alias("slab"), (nth % SLAB).cast("int").alias("at"), *more)


def blocks_of(occurrences: DataFrame) -> DataFrame:
    """Blocks of rows (tenant_id, term, slab, at, positions)."""
    keys = ["tenant_id", "term", "slab"]
    return occurrences.groupBy(*keys).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"),
        F.max(F.size("positions")).alias("most"),
        F.sort_array(F.collect_list(F.struct("at", "positions"))).cast(POSTINGS).alias("postings"),
    )


#: Blocks on their way to their bucket: the postings as flat lists, since nested ones take several times the bytes.
FLAT = "tenant_id string, term string, slab bigint, mask bigint, most int, ats array<tinyint>, starts array<int>, spots array<int>"


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _cut(at: np.ndarray, total: int) -> pa.Array:
    return pa.array(np.append(at, total).astype(np.int32))


def _flat_blocks(rows: pa.Table) -> pa.Table:
    """The blocks of one group of whole slabs, of rows (tenant_id, slab, at, words); an empty word only takes a place."""
    rows = rows.combine_chunks()
    lists = pc.split_pattern(rows["words"].cast(pa.large_string()), " ").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    held = np.repeat(np.arange(len(lists)), sizes)
    spot = np.arange(len(held)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code, names = words.indices.to_numpy(), words.dictionary
    kept = pc.not_equal(names, "").to_numpy(zero_copy_only=False)[code] if len(names) else np.zeros(0, dtype=bool)
    code, held, spot = code[kept], held[kept], spot[kept]
    slab, at = rows["slab"].to_numpy()[held], rows["at"].to_numpy()[held]
    order = np.lexsort((spot, at, slab, code))  # blocks of a term in a row: they shrink best on their way
    code, slab, at, spot = code[order], slab[order], at[order], spot[order]
    each = _starts(slab, code, at) if len(code) else np.zeros(0, dtype=np.int64)
    first = _starts(slab[each], code[each]) if len(code) else each
    counts = np.diff(np.append(each, len(code)))
    ends = np.append(each[first], len(code))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(each))))
    masks = np.bitwise_or.reduceat(np.uint64(1) << at[each].astype(np.uint64), first) if len(first) else np.zeros(0, dtype=np.uint64)
    most = np.maximum.reduceat(counts, first) if len(first) else counts
    lead = each[first]
    return pa.table({
        "tenant_id": pa.repeat(rows["tenant_id"][0], len(first)), "term": names.take(pa.array(code[lead])).cast(pa.string()), "slab": slab[lead],
        "mask": masks.view(np.int64), "most": most.astype(np.int32),
        "ats": pa.ListArray.from_arrays(_cut(first, len(each)), pa.array(at[each].astype(np.int8))),
        "starts": pa.ListArray.from_arrays(_cut(first, len(each)), pa.array((each - ends[of]).astype(np.int32))),
        "spots": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(spot.astype(np.int32))),
    })


def _nested(blocks: DataFrame) -> DataFrame:
    """Flat blocks as they are stored."""
    end = "coalesce(get(starts, i + 1), size(spots))"
    each = f"transform(ats, (a, i) -> named_struct('at', CAST(a AS int), 'positions', slice(spots, starts[i] + 1, {end} - starts[i])))"
    return blocks.withColumn("postings", F.expr(each).cast(POSTINGS)).drop("ats", "starts", "spots")


def _packs(batches):
    """Flat blocks with their bucket as packs of one bucket each: as Parquet they take a fraction of their bytes as rows."""

    def packed(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("bucket", "ascending")])).combine_chunks()
        buckets = rows["bucket"].to_numpy()
        at = _starts(buckets)
        packs = []
        for a, b in zip(at, [*at[1:], len(buckets)]):
            sink = pa.BufferOutputStream()
            pq.write_table(rows.slice(a, b - a).drop_columns(["bucket"]), sink, compression="zstd")
            packs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(buckets[at], pa.int32()), pa.array(packs, pa.binary())], ["bucket", "pack"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK_ROWS:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _unpacked(batches):
    for batch in batches:
        for bucket, pack in zip(batch["bucket"].to_pylist(), batch["pack"]):
            rows = pq.read_table(pa.BufferReader(pack.as_buffer()))
            rows = rows.append_column("bucket", pa.array(np.full(len(rows), bucket, dtype=np.int32)))
            yield from rows.to_batches(max_chunksize=10_000)


class Index:
    """The index under ``path``; ``config`` and ``buckets`` are those of all its segments."""

    def __init__(self, spark: SparkSession, path: str, config: str = "english", buckets: int = BUCKETS):
        self.spark, self.path, self.config, self.buckets = spark, path, config, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("tenant_id", "term"), F.lit(self.buckets)).cast("int")

    def segments(self) -> list[str]:
        """The live segments, oldest first."""
        versions = names_in(self.spark, f"{self.path}/manifest")
        if not versions:
            return []
        return [n.split("-", 1)[1] for n in names_in(self.spark, f"{self.path}/manifest/{max(versions)}")]

    def _publish(self, segments: list[str]) -> None:
        versions = names_in(self.spark, f"{self.path}/manifest")
        version = f"{int(max(versions, default='0')) + 1:08d}"
        name_list(self.spark, f"{self.path}/manifest/{version}", [f"{k:06d}-{s}" for k, s in enumerate(segments)])

    def _read(self, name: str, schema: str) -> DataFrame:
        segments = self.segments()
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        rows = self.spark.read.schema(f"{schema}, segment string").parquet(f"{self.path}/{name}")
        return rows.filter(F.col("segment").isin(segments))

    def docs(self) -> DataFrame:
        """Live chunks: those whose owner no later segment names as gone."""
        segments = self.segments()
        docs = self._read("docs", DOCS)
        if len(segments) < 2:
            return docs
        seq = F.create_map(*[x for k, s in enumerate(segments) for x in (F.lit(s), F.lit(k))])
        last = self._read("gone", GONE).groupBy(F.col("tenant_id").alias("_t"), F.col("owner").alias("_o")).agg(F.max(seq[F.col("segment")]).alias("_seq"))
        met = docs.join(last, F.col("tenant_id").eqNullSafe(F.col("_t")) & (F.col("owner") == F.col("_o")), "left")
        return met.filter(F.col("_seq").isNull() | (seq[F.col("segment")] >= F.col("_seq"))).drop("_t", "_o", "_seq")

    def _write(self, segment: str, docs: DataFrame, blocks: DataFrame, gone: DataFrame | None) -> None:
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/segment={segment}")
        blocks = blocks.withColumn("bucket", self.bucket())
        if "spots" in blocks.columns:
            flat = f"{FLAT}, bucket int"
            blocks = blocks.select(*[c.split()[0] for c in flat.split(", ")]).mapInArrow(_packs, "bucket int, pack binary")
            blocks = blocks.hint("rebalance", "bucket").mapInArrow(_unpacked, flat)
        else:
            blocks = blocks.hint("rebalance", "bucket")
        blocks = blocks.sortWithinPartitions("bucket", "tenant_id", "term", "slab")
        blocks = _nested(blocks) if "spots" in blocks.columns else blocks
        at = f"{self.path}/blocks/segment={segment}"
        blocks.select(*[c.split()[0] for c in BLOCKS.replace(POSTINGS, "_").split(", ")]).write.mode("overwrite").partitionBy("bucket").parquet(at)
        if names_in(self.spark, at):
            light = self.spark.read.schema("tenant_id string, term string, mask bigint").parquet(at)
        else:
            light = self.spark.createDataFrame([], "tenant_id string, term string, mask bigint")
        terms = light.groupBy("tenant_id", "term").agg(F.sum(F.bit_count("mask")).cast("long").alias("df"))
        terms.write.mode("overwrite").parquet(f"{self.path}/terms/segment={segment}")
        gone = gone if gone is not None else self.spark.createDataFrame([], GONE)
        gone.select("tenant_id", "owner").distinct().write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")

    def add(self, chunks: DataFrame, segment: str = "s0", gone: DataFrame | None = None, id_col: str = "chunk_id") -> None:
        """Add chunk rows as a segment; ``gone`` (tenant_id, owner) takes its owners' older chunks out.

        ``chunks``: tenant_id, id, text, and blurb, source_kind, artifact_id (the
        owner) where they have them.  It is read twice, so it should be a table.
        A segment of the same name is replaced.
        """
        kind = F.col("source_kind") if "source_kind" in chunks.columns else F.lit(None).cast("string")
        owner = F.col("artifact_id") if "artifact_id" in chunks.columns else F.col(id_col)
        named = F.col(id_col).cast("string").alias("id")
        length = n_terms(fulltext_tokens(index_text(chunks)), self.config).alias("length")  # words are stemmed once, for the blocks
        docs = placed(chunks.select("tenant_id", named, length, kind.alias("source_kind"), owner.alias("owner")))
        docs = docs.select("tenant_id", "slab", "at", "id", "length", "source_kind", "owner")
        # the words of a group of slabs meet as one text a chunk, and leave as blocks
        wide = indexed(chunks, self.config, id_col).select("tenant_id", named, F.array_join("terms", " ", "").alias("words"))
        texts = placed(wide, "_group")
        dealt = texts.select("tenant_id", "_group", "slab", "at", "words")
        self._write(segment, docs, dealt.groupBy("tenant_id", "_group").applyInArrow(_flat_blocks, FLAT), gone)
        known = self.segments()
        if segment not in known:
            self._publish([*known, segment])

    def compacted(self, segment: str) -> None:
        """Merge all segments into one, from the postings alone; what is gone is left out."""
        held = self.docs().withColumnRenamed("slab", "_slab").withColumnRenamed("at", "_at")
        moved = cut_lineage(placed(held))
        where = moved.groupBy("segment", "tenant_id", "_slab").agg(F.map_from_entries(F.collect_list(F.struct("_at", F.struct("slab", "at")))).alias("to"))
        old = self._read("blocks", BLOCKS).select("segment", "tenant_id", "term", F.col("slab").alias("_slab"), "postings")
        met = old.join(where.withColumnRenamed("tenant_id", "_t"), (F.col("tenant_id").eqNullSafe(F.col("_t"))) & (old["segment"] == where["segment"]) & (old["_slab"] == where["_slab"]))
        each = met.select("tenant_id", "term", "to", F.explode("postings").alias("p")).withColumn("place", F.expr("try_element_at(to, p.at)"))
        each = each.filter("place IS NOT NULL").select("tenant_id", "term", "place.slab", "place.at", "p.positions")
        self._write(segment, moved.select("tenant_id", "slab", "at", "id", "length", "source_kind", "owner"), blocks_of(each), None)
        self._publish([segment])

    def admitted(self, source_kinds=None) -> DataFrame | None:
        """(segment, tenant_id, slab, live mask); None where every chunk counts."""
        if source_kinds is None and len(self.segments()) < 2:
            return None
        docs = self.docs()
        if source_kinds is not None:
            docs = docs.filter(F.col("source_kind").isin(list(source_kinds)))
        return docs.groupBy("segment", "tenant_id", "slab").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("live"))


_WORDS = (
    "array_distinct(flatten(transform(items, it -> transform(it.lex, l -> l.term))))"
)
_HITS = (
    "sort_array(flatten(transform(items, it -> transform(filter(coalesce(try_element_at(held, it.lex[0].term), CAST(array() AS array<int>)), "
    "p -> forall(it.lex, l -> coalesce(array_contains(try_element_at(held, l.term), p + l.off), false))), p -> named_struct("
    "'end', p + element_at(it.lex, -1).off, 'start', p, 'grp', CAST(it.grp AS int), 'slot', it.slot, 'n_lex', it.n_lex, 'neg', it.neg)))))"
)
SLAB_KEYS = ["segment", "tenant_id", "slab"]


class Search:
    """One table of queries against one index.

    What is looked up in the blocks is written and counted first.  It goes to the
    tasks that read the blocks, in slices of whole buckets: so a block is read
    once, no posting moves before it is asked for, and no broadcast has more
    than LOOKUP_ROWS rows, however large the corpus.
    """

    def __init__(self, index: Index, queries: DataFrame, scoring: str = "cover_density", source_kinds=None, k1: float = 1.2, b: float = 0.75):
        if scoring not in ("cover_density", "bm25"):
            raise ValueError(f"unknown scoring: {scoring!r}")
        self.index, self.scoring, self.k1, self.b = index, scoring, k1, b
        self.parsed = sized(cut_lineage(parse_queries(queries, index.config)), QUERY_ROWS)
        self.live = index.admitted(source_kinds)
        if self.live is not None:
            self.live = sized(cut_lineage(self.live), LOOKUP_ROWS)
        self.blocks = index._read("blocks", BLOCKS)
        self.light = self.blocks.select("segment", "tenant_id", "term", "slab", "mask", "most")

    def _living(self, rows: DataFrame) -> DataFrame:
        """Masks without the chunks that do not count; rows whose mask is empty go."""
        if self.live is not None:
            rows = rows.join(self.live, SLAB_KEYS).withColumn("mask", F.col("mask").bitwiseAND(F.col("live"))).drop("live")
        return rows.filter("mask <> 0")

    def _looked_up(self, wanted: DataFrame, *columns) -> DataFrame:
        """``columns`` of the blocks that ``wanted`` names by SLAB_KEYS and term, once each."""
        wanted = cut_lineage(wanted.withColumn("bucket", self.index.bucket()))
        counts = sorted((r[0], r[1]) for r in wanted.groupBy("bucket").count().collect())  # a row for each bucket at most

        def met(blocks: DataFrame, own: DataFrame) -> DataFrame:
            return blocks.drop("bucket").join(own.drop("bucket"), [*SLAB_KEYS, "term"]).select(*columns)

        if sum(n for _, n in counts) <= LOOKUP_ROWS:
            return met(self.blocks, F.broadcast(wanted))
        slices: list[tuple[list[int], int]] = []
        for bucket, n in counts:
            if slices and slices[-1][1] + n <= LOOKUP_ROWS:
                slices[-1] = ([*slices[-1][0], bucket], slices[-1][1] + n)
            else:
                slices.append(([bucket], n))
        found = []
        for buckets, n in slices:
            inside, parts = F.col("bucket").isin(buckets), -(-n // LOOKUP_ROWS)
            blocks, own = self.blocks.filter(inside), wanted.filter(inside)
            if parts > LOOKUP_PARTS:
                found.append(cut_lineage(met(blocks, own.hint("merge"))))
                continue
            for part in range(parts):  # a bucket that is asked for much is read more than once
                mine = F.pmod(F.xxhash64(*SLAB_KEYS), F.lit(parts)) == part
                found.append(cut_lineage(met(blocks, F.broadcast(own.filter(mine)))))
        return reduce(DataFrame.unionByName, found)

    def candidates(self, bounded: bool = True) -> DataFrame:
        """(query, tenant, segment, slab, mask, bound): the chunks that hold all words of some alternative.

        The rarest word of an alternative names slabs, the next one leaves few of
        them; only there the other words are looked up.  ``bound`` limits the cover
        density of a chunk of the slab; it is null where the query has several
        alternatives, whose other words are not looked up.  Without ``bounded`` the
        two rarest words decide, the masks may have chunks without the others, and
        no bound is known.
        """
        alts = self.parsed.select("query_id", "tenant_id", "items", F.size("shape").alias("n_alts"), F.posexplode("wanted").alias("alt", "words"))
        wanted = alts.filter(F.size("words") > 0).select(
            "query_id", "tenant_id", "alt", "n_alts", F.explode("words").alias("term"), F.size("words").alias("need"), "items"
        )
        uses = F.expr("size(filter(items, it -> exists(it.lex, l -> l.term = term)))")
        wanted = wanted.select("query_id", "tenant_id", "alt", "n_alts", "term", "need", uses.alias("uses"))
        df = self.index._read("terms", TERMS).groupBy("tenant_id", "term").agg(F.sum("df").alias("df"))
        alt_keys = ["query_id", "tenant_id", "alt"]
        known = wanted.join(df, ["tenant_id", "term"]).withColumn("nth", F.row_number().over(Window.partitionBy(*alt_keys).orderBy("df", "term")))
        known = known.withColumn("have", F.count("*").over(Window.partitionBy(*alt_keys))).filter("have = need")
        known = cut_lineage(known)
        pairs = known.filter("nth <= 2").select("tenant_id", "term").distinct()
        rare = self._living(self.light.join(sized(pairs, LOOKUP_ROWS), ["tenant_id", "term"]).select(*SLAB_KEYS, "term", "mask"))
        rare = sized(cut_lineage(rare), LOOKUP_ROWS)
        led = sized(known.filter("nth = 1"), LOOKUP_ROWS).join(rare, ["tenant_id", "term"]).select(*alt_keys, "need", "n_alts", "segment", "slab", "mask")
        second = sized(known.filter("nth = 2").select(*alt_keys, "term"), LOOKUP_ROWS)
        both = led.join(second, alt_keys).join(rare.withColumnRenamed("mask", "other"), [*SLAB_KEYS, "term"])
        both = both.withColumn("mask", F.col("mask").bitwiseAND(F.col("other"))).filter("mask <> 0").select(*led.columns)
        led = both.unionByName(led.filter("need = 1"))
        if bounded:
            found = self._bounded(known, cut_lineage(led), alt_keys)
        else:
            found = led.groupBy("query_id", *SLAB_KEYS).agg(F.bit_or("mask").alias("mask"), F.lit(None).cast("double").alias("bound"))
        # an alternative of exclusions alone is met by every chunk that they do not hit
        lone = alts.filter(F.size("words") == 0).select("query_id", "tenant_id").distinct()
        everything = self.live
        if everything is None:
            everything = self.index.docs().groupBy(*SLAB_KEYS).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("live"))
        open_rows = lone.join(everything, "tenant_id").select("query_id", *SLAB_KEYS, F.col("live").alias("mask"), F.lit(None).cast("double").alias("bound"))
        both = found.select("query_id", *SLAB_KEYS, "mask", "bound").unionByName(open_rows)
        return both.groupBy("query_id", *SLAB_KEYS).agg(F.bit_or("mask").alias("mask"), F.when(F.count("bound") == F.count("*"), F.max("bound")).alias("bound"))

    def _bounded(self, known: DataFrame, led: DataFrame, alt_keys: list[str]) -> DataFrame:
        """What holds all words of an alternative among the slabs of ``led``, with bounds."""
        rest = sized(known, LOOKUP_ROWS).select(*alt_keys, "term", "uses").join(sized(led, LOOKUP_ROWS).withColumnRenamed("mask", "lead"), alt_keys)
        each = cut_lineage(rest)
        held = self._looked_up(each.select(*SLAB_KEYS, "term").distinct(), *SLAB_KEYS, "term", "mask", "most")
        met = (
            sized(each, LOOKUP_ROWS).join(held, [*SLAB_KEYS, "term"])
            .withColumn("mask", F.col("mask").bitwiseAND(F.col("lead"))).filter("mask <> 0")
            .groupBy(*alt_keys, "segment", "slab", "need", "n_alts")
            .agg(F.bit_and("mask").alias("mask"), F.count("*").alias("have"), F.sum(F.col("most") * F.col("uses")).alias("most"))
            .filter("have = need AND mask <> 0")
        )
        # scores are rounded to single precision, so the bound is widened by more than that
        bound = F.when(F.max("n_alts") == 1, F.max("most") * F.lit(fv.COVER_WEIGHT * 1.000001))
        return met.groupBy("query_id", *SLAB_KEYS).agg(F.bit_or("mask").alias("mask"), bound.alias("bound"))

    def scored(self, slabs: DataFrame) -> DataFrame:
        """(query, tenant, segment, slab, at, score, tfs) of the matching chunks in the given slabs' masks."""
        asked = self.parsed.select("query_id", "tenant_id", F.explode(F.expr(_WORDS)).alias("term"))
        # queries that ask a slab for the same word look it up together
        wanted = slabs.select("query_id", *SLAB_KEYS, "mask").join(asked, ["query_id", "tenant_id"]).groupBy(*SLAB_KEYS, "term").agg(F.bit_or("mask").alias("asked"))
        passed = F.expr("filter(postings, p -> (shiftright(asked, p.at) & 1) = 1)")
        met = self._looked_up(wanted, *SLAB_KEYS, "term", F.explode(passed).alias("p")).select(*SLAB_KEYS, "p.at", "term", "p.positions")
        chunks = met.groupBy(*SLAB_KEYS, "at").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("held"))
        # a chunk that meets a query of exclusions only may hold none of its words
        pairs = slabs.select("query_id", *SLAB_KEYS, F.explode(F.expr(f"filter(sequence(0, {SLAB - 1}), i -> (shiftright(mask, i) & 1) = 1)")).alias("at"))
        rows = pairs.join(chunks, [*SLAB_KEYS, "at"], "left").withColumn("held", F.coalesce("held", F.create_map().cast("map<string,array<int>>")))
        rows = rows.join(self.parsed.select("query_id", "tenant_id", "items", "shape", "wanted"), ["query_id", "tenant_id"])
        score = cover_density_sql("filter(hits, h -> NOT h.neg)", "shape") if self.scoring == "cover_density" else "0D"
        tfs = "transform(filter(array_distinct(flatten(wanted)), t -> map_contains_key(held, t)), t -> named_struct('term', t, 'tf', size(held[t])))"
        kept = f"IF(size({_FULFILLED}) > 0, array(named_struct('score', {score}, 'tfs', {tfs})), array())"
        tested = f"get(transform(array({_HITS}), hits -> {kept}), 0)"
        return rows.select("query_id", *SLAB_KEYS, "at", F.explode(F.expr(tested)).alias("m")).select("query_id", *SLAB_KEYS, "at", "m.score", "m.tfs")

    def _named(self, found: DataFrame, id_col: str) -> DataFrame:
        docs = self.index._read("docs", DOCS).select(*SLAB_KEYS, "at", F.col("id").alias(id_col), "length")
        return found.join(docs, [*SLAB_KEYS, "at"])

    def _okapi(self, found: DataFrame) -> DataFrame:
        """Okapi BM25 over the wanted words, with statistics of the tenant's chunks that count."""
        docs = self.index.docs()
        if self.live is not None:
            docs = docs.join(self.live, SLAB_KEYS).filter("(shiftright(live, at) & 1) = 1")
        corpus = docs.groupBy("tenant_id").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_len"))
        words = self.parsed.select("tenant_id", F.explode(F.flatten("wanted")).alias("term")).distinct()
        df = self._living(words.join(self.light, ["tenant_id", "term"])).groupBy("tenant_id", "term").agg(F.sum(F.bit_count("mask")).alias("df"))
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("t.tf") * (self.k1 + 1) / (F.col("t.tf") + self.k1 * (1 - self.b + self.b * F.col("length") / F.col("avg_len")))
        id_col = [c for c in found.columns if c not in ("query_id", *SLAB_KEYS, "at", "score", "tfs", "length")]
        each = found.select("query_id", "tenant_id", *id_col, "length", F.explode("tfs").alias("t")).withColumn("term", F.col("t.term"))
        return each.join(df, ["tenant_id", "term"]).join(corpus, "tenant_id").groupBy("query_id", "tenant_id", *id_col).agg(F.sum(part).alias("score"))

    def matches(self, id_col: str = "chunk_id") -> DataFrame:
        """(query_id, tenant_id, id, score) of every match."""
        found = self._named(self.scored(cut_lineage(self.candidates(bounded=False))), id_col)
        found = self._okapi(found) if self.scoring == "bm25" else found
        return found.select("query_id", "tenant_id", id_col, "score")

    def topk(self, k: int = fv.SEARCH_K, id_col: str = "chunk_id", first_slabs: int = FIRST_SLABS) -> DataFrame:
        """The best ``k`` of each query within its tenant; ties go to the smaller id."""
        order = Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("score"), F.asc(id_col))
        if self.scoring == "bm25":
            found = self.matches(id_col)
        else:
            by_bound = Window.partitionBy("tenant_id", "query_id").orderBy(F.desc_nulls_first("bound"), *SLAB_KEYS)
            slabs = cut_lineage(self.candidates().withColumn("turn", F.row_number().over(by_bound)))
            found = self.scored(slabs.filter(F.col("turn") <= first_slabs))
            later = slabs.filter(F.col("turn") > first_slabs)
            if not later.isEmpty():
                found = cut_lineage(found)
                best = Window.partitionBy("tenant_id", "query_id").orderBy(F.desc("score"))
                kth = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k)
                kth = kth.select("tenant_id", "query_id", F.col("score").alias("kth"))
                open_slabs = later.join(kth, ["tenant_id", "query_id"], "left").filter("kth IS NULL OR bound IS NULL OR bound >= kth")
                found = found.unionByName(self.scored(open_slabs))
            found = self._named(found, id_col)
        ranked = found.select("tenant_id", "query_id", id_col, "score").withColumn("rank", F.row_number().over(order))
        return ranked.filter(F.col("rank") <= k)
