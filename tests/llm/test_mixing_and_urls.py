"""Source mixing and URL filtering."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.llm import mixing, url_filter
from tests.llm import frames as X


def plain_targets(sizes: dict) -> dict:
    """Shares by weight, the excess over twice a source's size shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over
    return out


def check_mix(docs, rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in docs:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    assert len(rows) == len(docs)
    largest = defaultdict(int)
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for source, total in taken.items():
        assert abs(total - want[source]) <= 2 * largest[source] + 1e-6, source


def test_mix_on_awkward_rows(spark):
    check_mix(X.TEXTS, mixing.mix(X.frame(spark)).collect())
    assert mixing.mix(X.frame(spark).limit(0)).collect() == []
    assert mixing.mix(X.frame(spark, [(1, None, None, None), (2, "", None, "a")])).count() == 2


def test_mix_on_the_documents_and_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    check_mix([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], rows)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_many_rows_of_one_source_stay_near_the_target(spark):
    docs = [(i, "w " * (1 + i % 37), "en", "hot" if i % 10 else f"s{i % 70}") for i in range(6000)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    check_mix(docs, rows)
    hot = [r for r in rows if r.source == "hot"]
    assert abs(sum(r.taken for r in hot) - hot[0].target) < 100


def test_mixed_rows_follow_the_mix(spark):
    docs = X.frame(spark)
    rows = mixing.mixed_rows(docs).collect()
    assert rows[0].__fields__ == [*docs.columns, "copy"]
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += r.taken
    for r in rows:
        got[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(r.text.strip() for r in rows)
    assert {k: v for k, v in want.items() if v} == dict(got)


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest).group()
        host, path = raw.translate(X.FOLD), re.match(r"[^?#]*", rest[len(raw) :]).group()
    best = None
    for says, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return host, path, *(best or (None, None))


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "https://x.example.net", "https://x.example.net?q=/en/", "ftp://example.com/de/",
    "http://notnet/", "http://net/", "http://a.org/fr/é", "http://org/fr", "http://É.org/fr/x://y/z", "http:///path", "http://spam.example.com/en/1",
    "x://h/p://q", "http://example.com/de/" + "z" * 20_000, "http://a.b\nc.net/en/\n?", "http://user@x.net:80/p",
]


def test_urls(spark):
    some = [f"https://site{i}.example.{s}/{p}/{i}" for i in range(60) for s in ("net", "org", "com") for p in ("en", "fr")]
    names = ["".join(chr(97 + (i * k) % 26) for k in (3, 5, 7)) for i in range(60)]
    some += [f"http://casino-{name}.example.com/en/{i}" for i, name in enumerate(names)]
    urls = [*URLS, *URLS, *some]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, None, None, None)], "page_id long, url string, rule string, s string")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, says = plain_url(urls[r.page_id] if r.page_id is not None else None)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (says is None or r.verdict == says)
    by_url = {urls[r.page_id]: r for r in rows if r.page_id is not None}
    assert by_url[None].verdict == "allow"
    blocked = [by_url[u].verdict == "block" for u in some if "casino" in u]
    assert sum(blocked) / len(blocked) > 0.9
    fine = [by_url[u].verdict == "allow" for u in some if ".com/en" in u and "casino" not in u]
    assert sum(fine) / len(fine) > 0.9


def test_urls_without_training_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://plain.example.com/en/1")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_only_plain_operations(spark):
    for plan in (url_filter.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")), mixing.mix(X.frame(spark))):
        text = plan._jdf.queryExecution().toString()
        assert "Python" not in text and "Arrow" not in text


def test_url_model_keeps_every_gram_apart(spark):
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyz0-_/.~%é"
    held = [("\u0002" * url_filter.ORDER + "".join(rng.choices(alphabet, k=40)) + "\u0003", rng.choice(["allow", "block"]), rng.randint(1, 3)) for _ in range(15_000)]
    counts = {"allow": Counter(), "block": Counter()}
    for s, label, n in held:
        for i in range(url_filter.ORDER, len(s)):
            for k in range(url_filter.ORDER + 1):
                counts[label]["g", s[i - k : i + 1]] += n
                counts[label]["c", s[i - k : i]] += n

    def plain(s):
        total = 0.0
        for i in range(url_filter.ORDER, len(s)):
            chance = {}
            for label, seen in counts.items():
                p = 1 / url_filter.ALPHABET
                for k in range(url_filter.ORDER + 1):
                    p = (seen["g", s[i - k : i + 1]] + p * url_filter.BACK) / (seen["c", s[i - k : i]] + url_filter.BACK)
                chance[label] = p
            total += math.log(chance["block"]) - math.log(chance["allow"])
        return total / (len(s) - url_filter.ORDER)

    assert sum(map(len, counts.values())) > 1 << 20
    asked = [s for s, *_ in held[:40]] + ["\u0002" * url_filter.ORDER + "never/seen!" + "\u0003"]
    model = url_filter.count_grams(spark.createDataFrame(held, "s string, label string, n long")).cache()
    got = {r.s: r.score for r in url_filter.scores(spark.createDataFrame([(s,) for s in asked], "s string"), model).collect()}
    assert got == {s: pytest.approx(plain(s), abs=1e-9) for s in asked}
