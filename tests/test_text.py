"""Scalars and chunking against plain-Python statements of the same rules."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.functions import ids
from lodestone.functions import text as X
from lodestone.operators import chunking as C

AWKWARD = ["a b", "a\x85b", "a\x1cb\x1dc", "a b c", "  lead\ttrail \n", "", "   ", "one​two three"]


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).collect()[0][0]


@pytest.mark.parametrize("text", AWKWARD)
def test_words_match_python_split(spark, text):
    assert one(spark, text, X.words("t")) == text.split()
    assert one(spark, text, X.strip("t")) == text.strip()


def test_lines_match_splitlines(spark):
    text = "a\r\nb\x0bc\x0cd\x1ce\x85f g\nh"
    assert one(spark, text, X.lines("t")) == text.splitlines()


def test_tenant_ids(spark):
    given = "6BA7B810-9DAD-11D1-80B4-00C04FD430C8"
    assert one(spark, given, ids.tenant_id("t")) == given.lower()
    from lodestone.fixed_values import TENANT_PREFIX

    for name in ("demo", "acmé", ""):
        assert one(spark, name, ids.tenant_id("t")) == str(uuid.uuid5(uuid.NAMESPACE_DNS, TENANT_PREFIX + name))


def test_scope_fails_closed(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "tenant_id string")
    assert ids.scoped(df, "").count() == 0
    assert ids.scoped(df, None).count() == 0
    assert ids.scoped(df, "a").count() == 1


def window_twin(text, size, overlap):
    ws = text.split()
    if len(ws) <= size:
        return [text.strip()]
    count = 1 + -(-(len(ws) - size) // (size - overlap))
    return [" ".join(ws[i * (size - overlap) :][:size]) for i in range(count)]


def pack_twin(units, size, overlap, prefix, carry):
    budget, out, held = size - len(prefix.split()), [], []

    def flush():
        if held:
            out.append("\n".join([prefix, *held] if prefix else held))

    for unit in units:
        n = len(unit.split())
        if n > max(budget, 1):
            flush()
            held = []
            out += window_twin(unit, size, overlap)
        elif held and sum(len(u.split()) for u in held) + n > budget:
            flush()
            held = (held[-carry:] if carry else []) + [unit]
        else:
            held.append(unit)
    flush()
    return out


@pytest.mark.parametrize("carry,prefix", [(0, ""), (1, ""), (2, ""), (0, "# a head")])
def test_pack_against_twin(spark, carry, prefix):
    rng = random.Random(carry)
    cases = [[" ".join(["w"] * rng.choice([1, 2, 3, 7, 12, 30])) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u array<string>")
    got = dict(df.select("i", C.pack("u", 10, 3, prefix=f"'{prefix}'", carry=carry)).collect())
    for i, units in enumerate(cases):
        assert got[i] == pack_twin(units, 10, 3, prefix, carry), units


def test_markdown(spark):
    text = "intro line\n# One  \nbody one\n\n## Two\n" + " ".join(["w"] * 8) + "\n\n" + " ".join(["v"] * 7) + "\n###no heading"
    assert one(spark, text, C.markdown("t", 10, 2)) == [
        "intro line", "# One\nbody one", "## Two\n" + " ".join(["w"] * 8), " ".join(["v"] * 7) + "\n###no heading",
    ]
    assert one(spark, "#hash is no heading", C.markdown("t")) == ["#hash is no heading"]


def test_email(spark):
    text = "Hello\n> old\n  > older\nBye\nOn Monday, A B wrote:\nquoted"
    assert one(spark, text, C.email("t")) == ["Hello\nBye"]
    assert one(spark, "> only\n> quotes", C.email("t")) == []
    assert one(spark, "x\n-- Original Message --\ny", C.email("t")) == ["x"]


def test_dispatch_and_errors(spark):
    df = spark.createDataFrame([("a\n# b\nc", None, "notion"), ("a\n# b\nc", "message", "notion"), ("   ", "doc", "file")], "content string, kind string, source_kind string")
    assert [r[0] for r in df.select(C.chunk_texts()).collect()] == [["a", "# b\nc"], ["a\n# b\nc"], []]
    with pytest.raises(ValueError):
        C.chunk_texts(max_tokens=0)
    with pytest.raises(ValueError):
        C.chunk_texts(max_tokens=10, overlap=10)


def test_head(spark):
    assert one(spark, "\n  ## Title here \nbody", X.head("t")) == "Title here"
    assert one(spark, " ".join(str(i) for i in range(14)), X.head("t")) == " ".join(str(i) for i in range(12)) + "…"
