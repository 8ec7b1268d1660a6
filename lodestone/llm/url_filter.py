"""URL filtering by a ratio of character language models, in DataFrame operations only.

Rules settle the urls they fit: a rule (host, path) fits its host and all
subdomains when the path starts with the rule's; the longest rule wins.  The
urls settled by a rule, and otherwise those with a word of ``SEED_WORDS`` (as
rejected), train two smoothed variable-order Markov models of characters, one of
accepted and one of rejected urls.  The rest is judged by the difference of the
two log-likelihoods per character, against a threshold calibrated so that
``FALSE_BLOCKS`` of the accepted urls of a held-out fold would be blocked (0 if
that fold has none).

The models read host and path without the last host label (the suffix is what
rules are written by) in lower case with digits alike.  Order k is interpolated
with order k - 1 by ``BACK`` pseudo-counts.  Counts are a table by order and text,
which grows with the corpus; it is broadcast, order by order, where it is counted
to be small and joined by shuffle where not.  Equal strings are counted and scored
once, with their multiplicity, and so is each distinct window of ``ORDER`` + 1
characters, which keeps low orders and the start mark from gathering rows.

A null url, or one without ``://``, has an empty host and path and is allowed,
as is everything when there is nothing to train on.  Repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checked_broadcast, stored

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEED_WORDS = ("adult", "bets", "casino", "porn", "spam", "viagra", "xxx")
ORDER = 4
GRAM_BYTES = 128
BACK = 4.0
ALPHABET = 64
FOLDS = 5
FALSE_BLOCKS = 0.05
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("rest")).withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0)
    return rows.select("page_id", "url", F.translate("raw", UPPER, LOWER).alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and settled: the longest rule that fits, and what it says."""
    rule = settled = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest asks first
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, settled = F.when(fit, host + path).otherwise(rule), F.when(fit, says).otherwise(settled)
    return rows.withColumn("rule", rule).withColumn("settled", settled)


def _model_text() -> Column:
    """What the models read: host without its last label, and path; a start mark per order and one end mark."""
    name = F.regexp_replace("host", r"\.?[^.]*$", "")
    body = F.regexp_replace(F.lower(F.concat(name, "path")), "[0-9]", "0")
    return F.when(F.col("host") == "", F.lit(None)).otherwise(F.concat(F.lit("\u0002" * ORDER), body, F.lit("\u0003")))


def _windows(strings: DataFrame, *keep: str) -> DataFrame:
    """A row per character: w, the character after the ORDER before it."""
    spots = strings.select("s", *(c for c in keep if c != "s"), F.explode(F.expr(f"sequence({ORDER + 1}, length(s))")).alias("i"))
    return spots.select(*keep, F.expr(f"substring(s, i - {ORDER}, {ORDER + 1})").alias("w"))


def count_grams(strings: DataFrame) -> DataFrame:
    """k, gram, accepted, rejected: weighted counts, by order and text, over strings of (s, label, n)."""
    counts = [F.sum(F.when(F.col("label") == says, F.col("n")).otherwise(0)).alias(name) for says, name in (("allow", "accepted"), ("block", "rejected"))]
    seen = _windows(strings, "label", "n").groupBy("w").agg(*counts)
    grams = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"substring(w, {ORDER + 1 - k}, {k + 1})").alias("gram")) for k in range(ORDER + 1)])
    each = seen.select(F.explode(grams).alias("held"), "accepted", "rejected")
    return each.groupBy("held.k", "held.gram").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))


def scores(strings: DataFrame, model: DataFrame) -> DataFrame:
    """s, score: log-likelihood of rejected less accepted, per character."""
    places = _windows(strings, "s")
    windows = places.select("w").distinct().select("w", *[F.lit(1.0 / ALPHABET).alias(f"p_{side}") for side in "ar"])
    for k in range(ORDER + 1):
        grams = model.filter(F.col("k") == k).select(F.col("gram").alias("g"), F.col("accepted").alias("g_a"), F.col("rejected").alias("g_r"))
        contexts = grams.groupBy(F.expr(f"substring(g, 1, {k})").alias("c")).agg(F.sum("g_a").alias("c_a"), F.sum("g_r").alias("c_r"))
        windows = windows.withColumn("g", F.expr(f"substring(w, {ORDER + 1 - k}, {k + 1})")).withColumn("c", F.expr(f"substring(w, {ORDER + 1 - k}, {k})"))
        windows = windows.join(checked_broadcast(grams, GRAM_BYTES), "g", "left").join(checked_broadcast(contexts, GRAM_BYTES), "c", "left")
        chance = [((F.coalesce(f"g_{x}", F.lit(0)) + F.col(f"p_{x}") * BACK) / (F.coalesce(f"c_{x}", F.lit(0)) + BACK)).alias(f"p_{x}") for x in "ar"]
        windows = windows.select("w", *chance)
    windows = stored(windows.select("w", (F.log("p_r") - F.log("p_a")).alias("d")))
    return places.join(checked_broadcast(windows, GRAM_BYTES), "w").groupBy("s").agg(F.avg("d").alias("score"))


def judge(pages: DataFrame, rules=RULES, seed_words=SEED_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page (score: null where none was needed)."""
    rows = ruled(parsed(pages), rules).withColumn("s", _model_text())
    seeded = F.col("host").rlike("|".join(seed_words)) | F.col("path").rlike("|".join(seed_words))
    label = F.coalesce("settled", F.when(seeded, F.lit("block")))
    fold = F.pmod(F.xxhash64("s"), F.lit(FOLDS))
    strings = stored(
        rows.filter("s IS NOT NULL")
        .select("s", label.alias("label"), F.col("settled").isNull().alias("open"))
        .groupBy("s", "label", "open")
        .agg(F.count("*").alias("n"))
    )
    model = stored(count_grams(strings.filter(F.col("label").isNotNull() & (fold != 0))))
    held_out = F.col("label").isNotNull() & (fold == 0)
    scored = stored(scores(strings.filter(F.col("open") | held_out).select("s").distinct(), model))
    accepted = strings.filter((F.col("label") == "allow") & (fold == 0)).join(scored, "s")
    cut = accepted.agg(F.percentile_approx("score", F.lit(1 - FALSE_BLOCKS), F.lit(10_000))).first()[0]
    verdict = F.coalesce("settled", F.when(F.col("score") > F.lit(max(cut or 0.0, 0.0)), "block").otherwise("allow"))
    return rows.join(scored, "s", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("settled").isNull(), F.col("score")).alias("score"))
