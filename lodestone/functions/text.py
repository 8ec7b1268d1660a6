"""Text scalars as column expressions.

``WS`` is for use under the ``(?U)`` flag: Unicode white space plus the four
separator controls, which is what a word splitter outside the JVM breaks on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone import fixed_values as fv

WS = r"\s\x1c-\x1f"
SPACES = rf"(?U)[{WS}]+"
#: The characters of ``WS`` one by one: trimming looks at both ends of a text only, a pattern at all of it.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
INLINE_WS = rf"[{WS}&&[^\n]]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside ``body``; lambdas would otherwise re-evaluate it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column | str) -> Column:
    """Whitespace-separated words, no empties."""
    return F.array_remove(F.split(col(c), SPACES), "")


def token_count(c: Column | str) -> Column:
    return F.size(words(c))


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(BLANKS))


def unify_breaks(c: Column | str) -> Column:
    """Every line-break sequence becomes one newline."""
    return F.regexp_replace(col(c), BREAK, "\n")


def lines(c: Column | str) -> Column:
    return F.split(col(c), BREAK)


def stripped_lines(c: Column | str) -> Column:
    """Non-blank lines, stripped."""
    return F.filter(F.transform(lines(c), strip), lambda s: s != "")


def paragraphs(c: Column | str) -> Column:
    return F.filter(
        F.transform(F.split(col(c), rf"(?U)\n[{WS}]*\n"), strip), lambda p: p != ""
    )


def content_hash(c: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(c).cast("binary"), 256))


def head(c: Column | str, max_words: int = fv.HEAD_WORDS) -> Column:
    """First non-blank line without its leading heading marks, cut to ``max_words``."""
    first = F.regexp_extract(col(c), rf"(?U)[^{WS}][^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0)

    def cut(ws: Column) -> Column:
        kept = F.array_join(F.slice(ws, 1, max_words), " ")
        return F.concat(kept, F.when(F.size(ws) > max_words, F.lit("…")).otherwise(F.lit("")))

    return let(words(F.regexp_replace(first, r"\A#+", "")), cut)


def hash_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def fulltext_tokens(c: Column | str) -> Column:
    """Words of the full-text index: runs of letters and digits in any script."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _dollar_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9$]+"), F.lit(0))


def _literal_array(items) -> Column:
    return F.array(*[F.lit(i) for i in items])


def salient(c: Column | str, stopwords=fv.FAITH_STOPWORDS) -> Column:
    """Distinct content tokens used by every coverage test."""
    kept = F.filter(_dollar_tokens(c), lambda t: F.length(t) > 1)
    return F.array_except(kept, _literal_array(stopwords))


def match_tokens(c: Column | str) -> Column:
    """Distinct tokens of three characters or more."""
    return F.array_distinct(F.filter(_dollar_tokens(c), lambda t: F.length(t) > 2))


def leading_terms(c: Column | str, limit: int, stopwords=fv.QUERY_STOPWORDS) -> Column:
    """First ``limit`` distinct content tokens, in text order."""
    kept = F.filter(_dollar_tokens(c), lambda t: F.length(t) > 2)
    return F.slice(F.array_except(kept, _literal_array(stopwords)), 1, limit)


def coverage(action_tokens: Column, cited_tokens: Column) -> Column:
    """Share of the action's content tokens found in the cited tokens; 1.0 if it has none."""
    shared = F.size(F.array_intersect(action_tokens, F.coalesce(cited_tokens, F.array().cast("array<string>"))))
    return F.when(F.size(action_tokens) == 0, F.lit(1.0)).otherwise(
        shared.cast("double") / F.size(action_tokens).cast("double")
    )


def sentences(c: Column | str) -> Column:
    """Cut after ``.``, ``!`` or ``?`` plus whitespace, and at newlines."""
    parts = F.split(col(c), rf"(?U)(?<=[.!?])[{WS}]+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def is_procedural(c: Column | str, cues=fv.ACTION_CUES) -> Column:
    bare = F.transform(words(c), lambda w: F.lower(F.regexp_replace(w, r"\A[.,:;]+|[.,:;]+\z", "")))
    return F.arrays_overlap(bare, _literal_array(cues))


def searchable(text: Column | str, blurb: Column | str) -> Column:
    return F.concat(F.coalesce(col(blurb), F.lit("")), F.lit(" "), col(text))


def embedding_text(text: Column | str, blurb: Column | str) -> Column:
    b = col(blurb)
    return F.when(F.coalesce(b, F.lit("")) == "", col(text)).otherwise(
        F.concat(b, F.lit("\n\n"), col(text))
    )
