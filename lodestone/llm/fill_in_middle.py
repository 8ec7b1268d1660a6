"""Fill-in-the-middle forms of whole texts by one repeated-capture match per text.

A text is cut between tokens, where a token is a run of ASCII letters or any one
other character.  One ``fullmatch`` of ``(token)*`` keeps every repetition of
its group, so ``ends(1)`` is the list of token ends in code points: its length
is the number of tokens, and both cuts are two of its entries.  Nothing is
matched twice and no loop walks the tokens.  Python returns three numbers per
row; the texts are put together, and taken apart again, by column functions.

All chance is a hash of the key, so a rerun gives the same rows.  A null text
counts as empty, a null key as an empty one; both forms of an empty text are
plain.  A text that holds a mark itself stays plain, so a form can always be
read back.  Repeated rows are treated alike, rows never meet, an empty table
gives an empty result, and columns that are not asked for do not matter.
"""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from lodestone.llm.common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
FORMED_OF_100 = 90
SUFFIX_FIRST_OF_100 = 20

# possessive: a token never gives characters back, so no state is kept to go back to
TOKENS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")


CUTS = StructType().add("n", LongType()).add("first", IntegerType()).add("second", IntegerType())


@F.pandas_udf(CUTS)
def _cuts(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Tokens of each text, and the code points before its two cuts, a % (n + 1) and b % (n + 1) tokens in."""
    rows = []
    for text, x, y in zip(texts, a, b):
        ends = [0, *TOKENS.fullmatch(text).ends(1)]
        n = len(ends) - 1
        first, second = sorted((x % (n + 1), y % (n + 1)))
        rows.append((n, ends[first], ends[second]))
    return pd.DataFrame(rows, columns=["n", "first", "second"])


def draw(key: Column, k: int, seed: int = SEED) -> Column:
    """The k-th (from 0) of eight 32-bit numbers that the key stands for."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long")


def form_of(text: Column, key: Column, seed: int = SEED, formed: int = FORMED_OF_100, suffix_first: int = SUFFIX_FIRST_OF_100) -> Column:
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (draw(key, 2, seed) % 100 >= formed)
    return F.when(plain, "plain").when(draw(key, 3, seed) % 100 < suffix_first, "spm").otherwise("psm")


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """key, text, n, form, prefix_chars, middle_chars, output of each row.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix first), and
    the two lengths are null for plain ones.
    """
    rows = docs.select(key, text_or_empty(text).alias("text"))
    k = F.col(key)
    rows = rows.select("*", _cuts("text", draw(k, 0, seed), draw(k, 1, seed)).alias("cut"), form_of(F.col("text"), k, seed).alias("form"))
    first, second = F.col("cut.first"), F.col("cut.second")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    formed = F.col("form") != "plain"
    return rows.select(
        key,
        "text",
        F.col("cut.n").alias("n"),
        "form",
        F.when(formed, first.cast("long")).alias("prefix_chars"),
        F.when(formed, (second - first).cast("long")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from.

    No mark stands inside a part, and no mark can arise where a part meets one,
    so the first place of each mark is the one that was put there.
    """
    second = F.when(form == "psm", SUFFIX).otherwise(F.lit(PREFIX))
    head = F.split_part(F.substring(output, F.lit(len(PREFIX) + 1), F.length(output)), second, F.lit(1))
    rest = F.substring(output, F.length(head) + 2 * len(PREFIX) + 1, F.length(output))
    body = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = F.substring(rest, F.length(body) + len(MIDDLE) + 1, F.length(rest))
    return F.when(form == "psm", F.concat(head, middle, body)).when(form == "spm", F.concat(body, middle, head)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths and the hashes of output and restored text."""
    made = transform(docs)
    again = restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256")
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
  FROM documents),
cut AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
         CAST(('0x' || h[1:8]) AS BIGINT) % (len(tokens) + 1) AS a, CAST(('0x' || h[9:16]) AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST(('0x' || h[17:24]) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST(('0x' || h[25:32]) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS prefix,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle,
         array_to_string(tokens[greatest(a, b) + 1:], '') AS suffix
  FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
