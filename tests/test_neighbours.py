"""Neighbourhoods with hubs, validity, and overlaps against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import neighbours as NB


def test_neighbourhood_is_the_plain_search_with_and_without_hubs(spark):
    draw = random.Random(1)
    edges = [(t, f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for t in "tu" for _ in range(40)] + [("t", "hub", f"n{i}") for i in range(30)] + [("t", None, "n1"), ("t", "n1", "n1")]
    rows = spark.createDataFrame(edges, "tenant_id string, source string, target string")
    seeds = spark.createDataFrame([("t", "n0"), ("t", "n0"), ("u", "n3"), ("u", "absent")], "tenant_id string, node string")
    near = {}
    for t, a, b in edges:
        if a is not None:
            near.setdefault((t, a), set()).add(b)
            near.setdefault((t, b), set()).add(a)
    want = set()
    for t, seed in {("t", "n0"), ("u", "n3"), ("u", "absent")}:
        seen, front = {seed: 0}, [seed]
        for hop in (1, 2, 3):
            front = [b for a in front for b in near.get((t, a), ()) if b not in seen and not seen.update({b: hop})]
        want |= {(t, seed, node, hop) for node, hop in seen.items()}
    for hub in (4, 10_000):
        got = [tuple(r) for r in NB.neighbourhood(rows, seeds, 3, hub).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def test_validity_lookups_and_overlaps(spark):
    draw = random.Random(2)
    said = [(draw.choice("ab"), i, at(draw.randrange(4000)), at(draw.randrange(2000, 9000)) if draw.random() < 0.4 else None) for i in range(80)]
    rows = spark.createDataFrame(said, "k string, edge_id int, asserted_at timestamp, ends timestamp")
    edges = NB.with_validity(rows, ["k"], until="ends")
    held = [(r.k, r.edge_id, r.valid_from, r.valid_to) for r in edges.collect()]
    for k, i, start, end in held:
        later = [s[2] for s in said if s[0] == k and s[2] > start]
        stop = next(s[3] for s in said if s[1] == i)
        assert end == min([x for x in (min(later, default=None), stop) if x is not None], default=None)
    moments = [(draw.choice("abc"), m, at(draw.randrange(-100, 10_000))) for m in range(60)]
    asked = spark.createDataFrame(moments, "k string, moment_id int, moment timestamp")
    want = sorted((m, i) for k, m, t in moments for k2, i, s, e in held if k == k2 and s <= t and (e is None or t < e))
    for width in (60, 3600, 86_400):
        assert sorted((r.moment_id, r.edge_id) for r in NB.as_of(edges, asked, ["k"], width).collect()) == want
    spans = [(draw.choice("ab"), i, s := at(draw.randrange(1000)), s + timedelta(minutes=draw.randrange(1, 60)) if draw.random() < 0.95 else None) for i in range(60)]
    rows = spark.createDataFrame(spans, "k string, edge_id int, valid_from timestamp, valid_to timestamp")
    got = {r.edge_id: r.other for r in NB.overlaps(rows, ["k"]).collect()}
    far = datetime(9999, 12, 31)
    plain = {}
    for k, i, s, _ in spans:
        before = [(e or far, j) for k2, j, s2, e in spans if k2 == k and (s2, j) < (s, i)]
        if before and max(before)[0] > s:
            plain[i] = max(before)[1]
    assert got == plain and len(got) > 5
    assert NB.as_of(edges.filter(F.lit(False)), asked, ["k"]).isEmpty()
