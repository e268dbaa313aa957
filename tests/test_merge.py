"""A batch folded into a corpus: long chains of Replaces, gaps that change later matches, parts of a component."""

from __future__ import annotations

import math
import random

import pytest
from test_operators import SCHEMA, SCHEMA_NAMES, fold, rec

from fathomline.operators import graph, merge

BANDS = {"longitude": 0.001, "latitude": 0.001}


@pytest.mark.parametrize("at_once", [merge.AT_ONCE, 7])
def test_random_batches_fold_in_order(spark, monkeypatch, at_once):
    """Also where a component is decided part by part."""
    monkeypatch.setattr(merge.decisions, "__defaults__", (at_once,))
    r = random.Random(11)
    pick = lambda *v: r.choice(v)
    make = lambda seq, source: rec(seq, round(r.randrange(120) * 0.0007, 4), pick("A", "B", "C", None), source, pick("c", "d", None), pick(None, float(seq)), pick("pending", "fail", "flagged"))
    corpus = [make(k, "src_a") for k in range(40)]
    batch = [make(100 + k, pick("src_b", "src_c")) for k in range(150)]
    want, want_log = fold(corpus, batch)
    got, log = merge.upsert(spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame(batch, SCHEMA), BANDS, tolerant_on=["cruise"])
    assert sorted(map(tuple, log.select("candidate", "slot", "disposition").collect())) == sorted(want_log)
    names = [n for n in SCHEMA_NAMES if n != "notes"]
    assert sorted((tuple(x[n] for n in names) for x in got.collect()), key=str) == sorted((tuple(x[n] for n in names) for x in want), key=str)
    assert {"Replace", "AbsorbInto", "Admit"} <= {x["disposition"] for x in log.collect()}


def test_a_gap_that_was_filled_decides_what_matches(spark):
    corpus = [rec(0, 0.0, "A", cruise=None)]
    batch = [rec(5, 0.0, "B", "src_b", cruise="x"), rec(6, 0.0, "B", "src_b", cruise="y")]
    _, log = merge.upsert(spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame(batch, SCHEMA), BANDS, tolerant_on=["cruise"])
    assert sorted(map(tuple, log.select("candidate", "disposition").collect())) == [(5, "AbsorbInto"), (6, "Admit")]


def test_ten_thousand_replaces_in_one_chain(spark):
    """One slot travels along a line: every candidate moves it to where only the next one finds it."""
    grade = lambda k: ["C", "B", "A"][k % 3]
    n = 15_000
    slots = [rec(k, 0.0024 * k, None) for k in range(n // 3 + 1)]
    batch = [rec(100_000 + k, 0.0008 * (k + 1) , grade(k), "src_b") for k in range(n)]
    _, log = merge.upsert(spark.createDataFrame(slots, SCHEMA), spark.createDataFrame(batch, SCHEMA), BANDS)
    want = fold_fast(slots, batch)
    got = {x["candidate"]: (x["slot"], x["disposition"]) for x in log.collect()}
    assert got == want and sum(d == "Replace" for _, d in want.values()) >= 9_990


def test_a_crowded_place_makes_few_edges(spark, monkeypatch):
    """Closeness is told by cells, so its edges do not grow with the square of what lies at one place; nothing close is parted."""
    r, seen = random.Random(4), []
    monkeypatch.setattr(merge, "components", lambda edges, *a: seen.append(edges.count()) or graph.components(edges, *a))
    place = lambda k: (k, "MASS", r.choice([0.0, 0.0004, 0.0021, 0.0095]) + r.random() * 0.001, r.choice([0.0, 0.003, -0.005]) + r.random() * 0.001)
    schema = "seq bigint, evidence_class string, longitude double, latitude double"
    slots, spots = [place(k) for k in range(300)], [place(1000 + k) for k in range(300)]
    slots += [(300, "COUNT", 0.0, 0.0), (301, "MASS", None, 0.0), (302, "MASS", float("nan"), 0.0)]
    cells = merge.near_cells(spark.createDataFrame(spots, schema), spark.createDataFrame(slots, schema), BANDS, ["evidence_class"]).collect()
    label = {tuple(x[:3]): x["component"] for x in cells}
    home = lambda p: label[(p[1], math.floor(p[2] / 0.001), math.floor(p[3] / 0.001))]
    for a in spots:
        assert all(home(a) == home(b) for b in spots + slots[:300] if abs(a[2] - b[2]) <= 0.001 and abs(a[3] - b[3]) <= 0.001)
    assert len(set(label.values())) > 3 and label[("COUNT", 0, 0)] not in {home(a) for a in spots}
    rows = [[rec(k, 0.0005 * r.random(), "A") for k in range(n, n + 400)] for n in (0, 1000)]
    merge.decisions(*(spark.createDataFrame(x, SCHEMA) for x in rows), BANDS, ["cruise"])
    assert max(seen) <= 9 * len(cells)


def fold_fast(slots, batch):
    """Matches of the ordered fold along one line, found among the slots near a candidate."""
    from collections import defaultdict

    at = {s[0]: (s[4], s[8]) for s in slots}
    cells = defaultdict(set)
    for k, (x, _) in at.items():
        cells[int(x / 0.002)].add(k)
    rank, out = {"A": 3, "B": 2, "C": 1, None: 0}, {}
    for c in batch:
        home = int(c[4] / 0.002)
        hit = min((k for d in (-1, 0, 1) for k in cells[home + d] if abs(at[k][0] - c[4]) <= 0.001), default=None)
        if hit is None:
            out[c[0]] = (None, "Admit")
            continue
        wins = rank[c[8]] > rank[at[hit][1]]
        out[c[0]] = (hit, "Replace" if wins else "AbsorbInto")
        if wins:
            cells[int(at[hit][0] / 0.002)].discard(hit)
            at[hit] = (c[4], c[8])
            cells[home].add(hit)
    return out
