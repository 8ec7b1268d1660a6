"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target is its weighted share of ``EXTENT`` times all sizes, stopped at
``MOST`` times its own size, the excess shared again by weight.  A document's
expected copies are its source's target over its source's size.  Whole copies
are given; the fractions are settled by pivotal rounding: two fractions meet,
and chance moves mass from one to the other until one of them is 0 or 1, so
expectations hold exactly and the sum changes by less than one document.

The reduction is a tree.  Documents of a source are dealt into size bands and
bounded buckets; each bucket folds its fractions in size order and passes on
one undecided document; ``FAN`` buckets meet in the next level, bands of a
source meet last, smallest first, so words stay near the target as well.
Chance is a hash of the two ids that meet, so reruns agree.

Sizes count words split at ASCII white space; null text has size 0 and takes
nothing.  Sources are ordered by code point, null last, and a null source is a
source.  Repeated rows (same id, source and size) are one unit of several rows;
their copies are spread so that two rows differ by at most one.  An empty table
gives an empty result; extra columns are ignored by ``mix`` and kept by
``mixed_rows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stored

WEIGHTS = (5, 2, 1)
EXTENT = 1.5
MOST = 2.0
BUCKET_ROWS = 48
FAN = 64
SALTS = 32
SEED = 20

ITEM = "struct<band:bigint,size:bigint,h:bigint,doc_id:bigint,n:bigint,copies:double,source_size:bigint,target:double>"

# a: what is carried and what is settled; x: the next one.  The one that loses its
# fraction is settled at 0, or, where both hold one or more, at 1.
FOLD = f"""
aggregate(items,
  named_struct('item', CAST(NULL AS {ITEM}), 'p', 0D,
               'settled', CAST(array() AS array<struct<item:{ITEM},extra:bigint>>)),
  (a, x) -> CASE WHEN a.item IS NULL THEN named_struct('item', x.item, 'p', x.p, 'settled', a.settled) ELSE
    transform(array((a.p + x.p, pmod(xxhash64(a.item.h, x.item.h, {SEED}), 1048576) / 1048576D)), v ->
      transform(array(CASE WHEN v.col1 < 1 THEN v.col2 * v.col1 < a.p ELSE v.col2 * (2 - v.col1) >= 1 - x.p END), stays ->
        named_struct(
          'item', CASE WHEN stays THEN a.item ELSE x.item END,
          'p', CASE WHEN v.col1 < 1 THEN v.col1 ELSE v.col1 - 1 END,
          'settled', concat(a.settled, array(named_struct(
              'item', CASE WHEN stays THEN x.item ELSE a.item END,
              'extra', CASE WHEN v.col1 < 1 THEN 0L ELSE 1L END))))
      )[0])[0] END)"""


def word_count(text="text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size, target of each row of (source, source_size).

    The windows hold one row per source, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1
    rows = per_source.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), turn))
    rows = rows.withColumn("most", F.col("source_size") * MOST)
    # sources stop in the order of most / w; ahead and after are sums over that order
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * EXTENT - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    rows = rows.withColumn("level", level).withColumn("stops", F.col("level") * F.col("w") > F.col("most"))
    # the common level is that of the first source that does not stop
    settled = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("w"), F.col("level")))).over(every)
    target = F.coalesce(F.least("most", settled["level"] * F.col("w")), F.col("most"))
    return rows.select("source", "source_size", target.alias("target"))


def _groups(dealt: DataFrame, by: list[str]) -> DataFrame:
    """Fold the fractions of each group; its settled documents and the one left over."""
    items = F.sort_array(F.collect_list(F.struct("item", "p"))).alias("items")
    return dealt.groupBy(*by).agg(items).select(*by, F.expr(FOLD).alias("f")).select(*by, "f.item", "f.p", "f.settled")


def decide(units: DataFrame) -> DataFrame:
    """source, item, extra: whether a unit takes one copy more than its whole ones."""
    units = stored(units)
    sizes = units.groupBy("source", "band").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("n")).alias("words"))
    bands = stored(sizes)
    per_source = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")))
    b, s = bands.alias("b"), per_source.alias("s")
    table = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.band", "b.units", "s.source_size", "s.target")
    salted = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).alias("t")
    u = units.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int")).alias("u")
    met = u.join(salted, F.col("u.source").eqNullSafe(F.col("t.source")) & (F.col("u.band") == F.col("t.band")) & (F.col("u.salt") == F.col("t.salt")))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    item = F.struct("u.band", "size", "h", "doc_id", "n", copies.alias("copies"), "source_size", "target")
    buckets = F.ceil(F.col("units") / BUCKET_ROWS)
    dealt = stored(
        met.select("u.source", item.cast(ITEM).alias("item"), (copies * F.col("n")).alias("expected"), F.pmod(F.xxhash64("h"), buckets).alias("bucket"))
        .select("source", "item", F.col("item.band").alias("band"), "bucket", (F.col("expected") - F.floor("expected")).alias("p"))
    )
    done = [dealt.filter("p = 0 OR item.size = 0").select("source", "item", F.lit(0).cast("long").alias("extra"))]
    open_rows = dealt.filter("p > 0 AND item.size > 0")
    most = bands.agg(F.max("units")).first()[0] or 1
    left = -(-most // BUCKET_ROWS)
    while True:
        held = stored(_groups(open_rows, ["source", "band", "bucket"]))
        done.append(held.select("source", F.explode("settled").alias("s")).select("source", "s.item", "s.extra"))
        open_rows = held.select("source", "band", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), "item", "p")
        if left <= 1:
            break
        left = -(-left // FAN)
    last = stored(_groups(open_rows, ["source"]))
    done.append(last.select("source", F.explode("settled").alias("s")).select("source", "s.item", "s.extra"))
    chance = F.pmod(F.xxhash64("item.h", F.lit(SEED)), F.lit(1048576)) / 1048576
    done.append(last.select("source", "item", (chance < F.col("p")).cast("long").alias("extra")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, n rows, hash and size band of each unit."""
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    band = F.when(F.col("size") > 0, F.floor(F.log2("size") * 4)).otherwise(-1)
    return sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).select("*", F.xxhash64("doc_id", "source", "size").alias("h"), band.alias("band"))


def _rows(decided: DataFrame) -> DataFrame:
    """Whole copies of each row of a unit, and how many of its rows take one more."""
    whole = F.floor("item.copies")
    total = F.floor(F.col("item.copies") * F.col("item.n")) + F.col("extra")
    return decided.select("source", "item.*", whole.alias("whole"), (total - whole * F.col("item.n")).alias("more"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    each = _rows(decide(units_of(docs))).select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    copies = F.col("whole") + (F.col("i") <= F.col("more")).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with ``copy`` counting from 1."""
    names = docs.columns
    taken = _rows(decide(units_of(docs))).select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "size", "n", "whole", "more")])
    on = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (word_count() == F.col("__size"))
    met = docs.join(taken.filter("__size > 0 AND __whole + __more > 0"), on)
    order = Window.partitionBy("doc_id", "source", "__size").orderBy(F.xxhash64(*[F.col(n) for n in names]))
    one = met.filter("__n = 1").withColumn("__i", F.lit(1))
    several = met.filter("__n > 1").withColumn("__i", F.row_number().over(order))
    copies = F.col("__whole") + (F.col("__i") <= F.col("__more")).cast("long")
    every = one.unionByName(several).withColumn("__copies", copies).filter("__copies > 0")
    return every.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "__copies")).alias("copy"))
