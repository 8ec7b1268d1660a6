"""English term normalisation for the full-text index.

Whole token arrays go through one Arrow batch; each worker stems a word once.
The rules are Porter's published suffix-stripping algorithm (1980).
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import fixed_values as fv

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


def _shape(stem: str) -> str:
    """Consonant/vowel pattern; ``y`` is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    fits = [s for s in suffixes if word.endswith(s)]
    return max(fits, key=len) if fits else None


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = _longest(word, ("ed", "ing"))
        if cut and "v" in _shape(word[: -len(cut)]):
            word = word[: -len(cut)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _shape(word).endswith("cc") and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        cut = _longest(word, table)
        if cut and _measure(word[: -len(cut)]) > 0:
            word = word[: -len(cut)] + table[cut]
    cut = _longest(word, _STEP4)
    if cut:
        base = word[: -len(cut)]
        if _measure(base) > 1 and (cut != "ion" or base[-1:] in ("s", "t")):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def english_terms(tokens: Column, stopwords=tuple(fv.FULLTEXT_STOPWORDS)) -> Column:
    """Stem each token in place; a stop word becomes null and keeps its position."""
    stop = frozenset(stopwords)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(arrays: pa.Array) -> pa.Array:
        words = arrays.flatten().dictionary_encode()
        terms = [None if w in stop else stem(w) for w in words.dictionary.to_pylist()]
        flat = pa.array(terms, pa.string()).take(words.indices)
        lengths = pa.compute.fill_null(pa.compute.list_value_length(arrays), 0)
        offsets = pa.concat_arrays(
            [pa.array([0], pa.int32()), pa.compute.cumulative_sum(lengths).cast(pa.int32())]
        )
        return pa.ListArray.from_arrays(offsets, flat)

    return run(tokens)
