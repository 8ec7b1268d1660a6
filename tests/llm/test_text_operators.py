"""Extraction, decontamination, language ID, personal data and license scans."""

from __future__ import annotations

import html
import random
import re
import time
from itertools import combinations

import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, html_main, language_id, license_scan, pii
from tests.llm import frames as X

PAGE = """<!DOCTYPE html><html lang="en"><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="with-sidebar"><header>Site name</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many.</p></div><!-- note -->
<div id="page"><div class="post"><h1>A &amp; B</h1><p>First   para&shy;,
one <b>bold<br>text.<p>Second, &lt;x&gt; &#233;.</p><div class="part"><p>Short.</p><ul><li>item</ul></div></div>
<div class="sidebar"><p>Side, side, side, side.</p></div></div>
<form><p>Name, mail, pass</p></form><section id="comments"><p>Nice, very nice, indeed.</p></section>
<aside>aside</aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    want = "A & B\nFirst para\xad, one bold text.\nSecond, <x> é.\nShort.\nitem"
    assert html_main.main_text(PAGE) == want
    assert html_main.main_text(PAGE[: PAGE.index("<li>item")]).endswith("Short.")
    assert html_main.main_text("plain &amp; simple") == "plain & simple"
    assert html_main.main_text("<article><p>a</p><section><p>b</p></section></article><div class='ad'>c</div>") == "a\nb"
    assert html_main.main_text("<nav>only</nav>") == ""
    assert html_main.main_text("<div>" * 20_000 + "<p>deep</p>") == "deep"
    assert html_main.main_text("<p>" + "x, " * 300_000)[:5] == "x, x,"


STORY = "<article><h1>T</h1>" + "".join(f"<p>Paragraph {i}, with commas, and some more text about it.</p>" for i in range(5)) + "</article>"
TOLD = "\n".join(["T"] + [f"Paragraph {i}, with commas, and some more text about it." for i in range(5)])


@pytest.mark.parametrize(
    "around",
    [
        "<div class='layout with-sidebar'>{}<div class='sidebar'><p>junk, junk, junk</p></div></div>",
        "<div class='has-banner'>{}</div>", "<div class='elementor-widget'>{}</div>", "<form id='aspnetForm'>{}<input value='x'></form>",
        "<div class='comments-open'><main>{}</main></div>", "<div>{}</div><div class='comments'>" + "<p>a long reader comment, again</p>" * 60 + "</div>",
        "<div class='page no-sidebar'>{}<section class='related'><article><p>a teaser, short</p></article></section></div>",
    ],
)
def test_layout_names_do_not_cut_the_article(around):
    assert html_main.main_text(around.format(STORY)) == TOLD


def test_furniture_alone_stays_cut():
    for page in ("<div class='cookie'><p>We use cookies, many of them.</p></div>", "<form><p>name</p></form>", "<div class='comments'>" + "<p>one, two</p>" * 9 + "</div>"):
        assert html_main.main_text(page) == ""


def test_void_elements_do_not_cut_words():
    assert html_main.main_text("<p>super<wbr>cali x<img>y a<br>b</p>") == "supercali xy a b"


def test_deep_and_unclosed_markup_is_read_in_time():
    started = time.process_time()
    for page in ("<div>x" * 4_000, "<b>y" * 8_000, "<p><b>z" * 8_000, "<li><i>q" * 8_000):
        assert html_main.main_text(page)
    assert time.process_time() - started < 20


def test_all_pages_by_a_plain_cut():
    """The articles of the driver's pages by regular expressions."""
    table = pyarrow.parquet.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])
    for page in table.column("html").to_pylist():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote|pre|table|tr|td)\b[^>]*>", re.sub(r"<br>", " ", body.group(1) if body else ""))
        plain = [" ".join(html.unescape(re.sub(r"<!--.*?-->|</?[a-z][^>]*>", "", b, flags=re.S)).split()) for b in blocks]
        assert html_main.main_text(page) == "\n".join(b for b in plain if b)


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = {tuple(r)[:2] + (r.n_chars,) for r in html_main.extract(pages).collect()}
    assert rows == {(1, "u", len(html_main.main_text(PAGE))), (2, None, 0), (None, "v", 0)}
    assert html_main.extract(pages.limit(0)).collect() == []


def test_masks_hit_every_window_with_two_substitutions():
    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(
            all(s + o not in gone for o in mask) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - mask[-1])
        )


def test_repeated_words_meet_repeated_words_in_time(monkeypatch):
    """A hot seed: few alignments that differ, however often they occur; the pieces do not matter."""
    item = " ".join(["no"] * 59)
    block = decontaminate.Block([7, 8], [item, " ".join(f"w{i}" for i in range(30))])
    started = time.process_time()
    (row,) = block.matches(decontaminate.word_hashes("yes " + "no " * 100_000))
    assert row == (7, 0, 59, 1.0) and time.process_time() - started < 20
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["no", "no", "no", "yes"]) for _ in range(draw.randrange(90))) for _ in range(60)]
    whole = [block.matches(decontaminate.word_hashes(t)) for t in texts]
    monkeypatch.setattr(decontaminate, "HIT_PAIRS", 5)
    monkeypatch.setattr(decontaminate, "KNOWN_ALIGNMENTS", 2)
    assert [block.matches(decontaminate.word_hashes(t)) for t in texts] == whole
    assert [bool(w) for w in whole] == [X.leaks(t, item) for t in texts] and any(whole) and not all(whole)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 12, 13, 20, 30])))) for k in range(25)] + [(90, None), (91, ""), (7, "w1 w2")]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 40))
        if d % 3 == 0:
            held = (items[rng.randrange(25)][1]).upper().split()
            for _ in range(rng.randint(0, 4)):
                held[rng.randrange(len(held))] = "other"
            text[len(text) // 2 : 0] = held
        docs.append((d, ", ".join(text)))
    docs += [(100, None), (None, items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, k) for d, t in docs for k, held in items if X.leaks(t, held)}
    for block in (decontaminate.BLOCK_WORDS, 30):
        found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench, block).collect()}
        assert found == want
        kept = decontaminate.clean(frame, bench, block)
        assert {r.doc_id for r in kept.collect()} == {d for d, t in docs if not any(X.leaks(t, h) for _, h in items)}
    assert decontaminate.contaminated(frame, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(frame.limit(0), bench).collect() == []


def test_word_pieces_do_not_matter(monkeypatch):
    text = "Straße, Été — “quoted” x1 " * 40
    whole = decontaminate.word_hashes(text)
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    assert (decontaminate.word_hashes(text) == whole).all()
    assert len(whole) == len(re.findall(r"\w+", text))


def language_rows(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"the house and the garden are near the river number {i} with many trees", "en", "a.example.com"))
        rows.append((100 + i, f"la maison et le jardin sont près de la rivière numéro {i} avec des arbres", "fr", "b.example.fr"))
    return rows


def test_language(spark):
    rows = language_rows(spark)
    odd = [
        (500, "*** &&& 123", "en", "a.example.com"), (501, None, "fr", None), (502, "", None, None), (503, "мы не знаем этот язык", "en", "a.example.com"),
        (504, "le jardin et la maison", None, "b.example.fr"), (505, "the garden " * 60_000, "xx", None), (None, "the river", "en", "a.example.com"),
        (506, "zqxj wvkq xzqj qqkz jxvz wqzk zzxq kqjv", None, None),
    ]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, declared string, host string")
    names, model = language_id.fit(frame.select(F.col("doc_id").alias("key"), "text", F.col("declared").alias("label")).filter("doc_id < 200"))
    assert names == ["en", "fr"]
    got = {r.doc_id: (r.lang, r.kept) for r in language_id.identify(frame, names, model).collect()}
    assert all(got[d] == (lang, True) for d, _, lang, _ in rows)
    assert [got[d] for d in (500, 501, 502, 503, 506)] == [("und", False)] * 5
    assert [got[d] for d in (504, 505, None)] == [("fr", True), ("en", True), ("en", True)]
    nothing = language_id.fit(frame.select(F.col("doc_id").alias("key"), "text", F.lit(None).cast("string").alias("label")))
    assert {r.lang for r in language_id.identify(frame, *nothing).collect()} == {"und"}
    assert language_id.identify(frame.limit(0), names, model).collect() == []


def test_language_of_repeated_rows_and_clashing_columns(spark):
    rows = X.frame(spark, [r for r in X.TEXTS if r[2]] * 2)
    names, model = language_id.fit(rows.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")))
    more = [F.lit("x").alias(c) for c in ("suffix", "domain", "ll", "own", "share", "says", "score", "best", "prior", "kept", "confidence", "host_sum", "p1")]
    asked = rows.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), *more)
    found = language_id.identify(asked, names, model)
    plain = language_id.identify(asked.select("doc_id", "text", "declared", "host"), names, model)
    cols = ["doc_id", "lang", "kept"]
    assert sorted(map(str, found.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    assert found.count() == rows.count() and {r.suffix for r in found.collect()} == {"x"}
    by_id = {}
    for r in plain.collect():
        assert by_id.setdefault(r.doc_id, (r.lang, r.confidence)) == (r.lang, r.confidence)


def test_host_prior_settles_silent_text(spark):
    rows = language_rows(spark) + [(700, "ok", None, "b.example.fr"), (701, "ok", None, "a.example.com")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string")
    names, model = language_id.fit(frame.select(F.col("doc_id").alias("key"), "text", F.col("declared").alias("label")))
    got = {r.doc_id: r.lang for r in language_id.identify(frame, names, model).collect()}
    assert (got[700], got[701]) == ("fr", "en")


SCRIPTS = {
    "el": "η γλώσσα αυτή είναι παλιά και την μιλούν πολλοί άνθρωποι στην χώρα",
    "ru": "мы не знаем этот язык совсем но его понимают многие люди в нашей стране",
    "uk": "ми знаємо цю мову і її розуміють усі люди в нашій країні",
    "zh": "我们知道这种语言，很多人在这个国家说它。",
    "ja": "私たちはこの言語を知っています。この国の多くの人が話します。",
    "ko": "우리는 이 언어를 알고 있으며 이 나라의 많은 사람들이 말합니다",
    "he": "אנחנו יודעים את השפה הזאת והרבה אנשים במדינה מדברים אותה",
}


@pytest.mark.parametrize("many", [100, 40_000])
def test_rare_languages_of_other_scripts_stay_at_any_size(spark, many):
    common = spark.range(many).select("id", F.lit("the garden of the house by the river").alias("text"), F.lit("en").alias("declared"))
    rare = [(1_000_000 + i, text, lang) for i, (lang, text) in enumerate(SCRIPTS.items())]
    rows = common.unionByName(spark.createDataFrame(rare, "id long, text string, declared string"))
    names, model = language_id.fit(rows.select(F.col("id").alias("key"), "text", F.col("declared").alias("label")))
    assert names == sorted(["en", *SCRIPTS])
    asked = [(i, text, None, "h") for i, text, _ in rare] + [(1, "ქართული ენა არის ძალიან ძველი და ლამაზი", None, "h"), (2, "♞♟♠♡♢ ☀☁☂☃", None, "h")]
    frame = spark.createDataFrame(asked, "id long, text string, declared string, host string")
    got = {r.id: (r.lang, r.kept) for r in language_id.identify(frame, names, model).collect()}
    assert got == {i: (lang, True) for i, _, lang in rare} | {1: ("und", False), 2: ("und", False)}


def test_every_label_is_a_language(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i % 50:02}") for i in range(200)]
    names, model = language_id.fit(spark.createDataFrame(rows, "key long, text string, label string"))
    assert len(names) == 50 and model.seen.shape[0] == 50


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        found = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (
                True,
                all(int(p) <= 255 for p in m.group().split(".")) if kind == 1 else True,
                16 <= len(digits) <= 19 and pii.luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if fits:
                found.append(m.span())
        out.append(found)
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("a1 2@.-+(9é.@") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("x" * 300_000 + "@" * 1000 + "9" * 100_000 + ".1.2.3")[0] == []


def test_field_learns_held_out_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    weights = pii.fit(pii.training_regions(docs.filter("doc_id < 5000")))
    hit = missed = wrong = 0
    for r in docs.filter("doc_id >= 5000").select("text").toLocalIterator():
        want = {(k, *s) for k, found in enumerate(pii.base_spans(r.text)) for s in found}
        got = {s for region in pii.regions(r.text) for s in pii.decode(r.text, region, weights)}
        hit, missed, wrong = hit + len(got & want), missed + len(want - got), wrong + len(got - want)
    assert hit > 100 and hit / (hit + missed) >= 0.9 and hit / (hit + wrong) >= 0.9


def test_decoding_is_the_best_cut():
    rng = random.Random(2)
    text = "call +1 (202) 555-0143 or bob@mail.example.com, 4111 1111 1111 1111"
    import numpy as np

    weights = np.array([[rng.uniform(-1, 1) for _ in range(pii.FEATURES + 1)] for _ in pii.KINDS])
    region = pii.regions(text)[0]
    segs = pii.segments(text, region)
    scores = {(s[0], s[1]): float(max(weights[:, s[4]].sum(axis=1) + weights[:, -1])) for s in segs}

    def best(i):
        if i == len(region):
            return 0.0
        return max([best(i + 1), *(v + best(j) for (a, j), v in scores.items() if a == i)])

    by_span = {(s[2], s[3]): float(max(weights[:, s[4]].sum(axis=1) + weights[:, -1])) for s in segs}
    assert abs(sum(by_span[a, b] for _, a, b in pii.decode(text, region, weights)) - best(0)) < 1e-9


def test_personal_data_rows(spark):
    rows = pii.find(X.frame(spark)).collect()
    assert len(rows) == len(X.TEXTS)
    by_id = {r.doc_id: r for r in rows}
    base = plain_spans(X.TEXTS[9][1])
    assert (by_id[10].n_email, by_id[10].n_ip, by_id[10].n_card, by_id[10].n_phone) == (1, 1, 1, 1)
    assert by_id[10].base_sha256 == X.sha(pii.joined(base))
    assert set(pii.joined(base).split(",")) <= set(by_id[10].spans.split(","))
    assert by_id[4].spans == "" and by_id[4].base_sha256 == X.sha("")
    assert pii.find(X.frame(spark).limit(0)).collect() == []


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", X.fold(text))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("seed", [1, 2])
def test_license_scan(spark, seed):
    rng = random.Random(seed)
    vocabulary = "cc by nc general public license all rights reserved the mit under été 4 0 GNU".split()
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(d, t) for d, t, *_ in X.TEXTS] + [(900, "Released under the MIT License."), (901, "x " * 50 + "Licensed under the Apache License, Version 2.0.")]
    docs += [(902, "license " * 30_000), (903, "Licensed beneath the Apache License, Version 2.0.")]
    rows = license_scan.scan_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    assert sorted(map(str, (tuple(r)[:6] for r in rows))) == sorted(str((d, *plain_scan(t))) for d, t in docs)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[d].labels for d in (900, 901, 902, 903, 11, 4)] == ["mit", "apache-2.0", "", "apache-2.0", "cc-by,cc-by-nc-4.0,reserved", ""]
    assert license_scan.scan_documents(X.frame(spark).limit(0)).collect() == []


def test_license_scan_of_every_template_in_one_text(spark):
    lines = [t[1] for t in license_scan.TEMPLATES]
    whole = "Third-party notices. " + ". ".join(lines) + ". Copy the forms of this source, with permission, for any purpose."
    few = "\n".join(next(t[1] for t in license_scan.TEMPLATES if t[0] == label) for label in ("bsd", "isc", "apache-2.0"))
    docs = [(1, whole), (2, few), (3, "padding " * 5_000 + whole), *((i, "Licensed under the Apache License, Version 2.0.") for i in range(10, 60))]
    rows = license_scan.scan_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: set(r.labels.split(",")) for r in rows}
    every = {t[0] for t in license_scan.TEMPLATES} | {label for _, label in license_scan.BASE}
    assert got[1] == got[3] == every
    assert got[2] == {"bsd", "isc", "apache-2.0"}
    assert all(got[d] == {"apache-2.0"} for d in range(10, 60))
