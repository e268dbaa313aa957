"""Places on the sphere against brute force: close pairs, spanning edges, nearest points, polygons, grids, order statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import geo, merge, models, polygons, spatial, surfaces, validation


def km(a, b):
    return float(models.great_circle(np.array([a]), np.array([b]))[0, 0])


#: Around the date line, both poles and one place that many share; some have none.
EDGES = [(179.9995, 10.0), (-179.9995, 10.0), (180.0, 10.0), (-180.0, 10.01), (359.999, 0.0), (0.001, 0.0), (-0.0005, 0.001), (10.0, 89.999), (-170.0, 89.9995), (100.0, 90.0), (0.0, -90.0), (77.0, -89.9999)]


@pytest.mark.parametrize("reach", [0.3, 2.0, 300.0, 30_000.0])
def test_close_pairs_know_no_border(spark, reach):
    r = np.random.default_rng(2)
    at = EDGES + [(float(x), float(y)) for x, y in zip(r.uniform(-180, 180, 40), r.uniform(-90, 90, 40), strict=True)] + [(5.0, 5.0)] * 3
    rows = [(k, *p, f"k{k}") for k, p in enumerate(at)] + [(900, None, 1.0, "x"), (901, 1.0, float("nan"), "x")]
    df = spark.createDataFrame(rows, "id bigint, lon double, lat double, tag string")
    got = {(x["a"], x["b"]): x for x in geo.close_pairs(df, reach, ("tag",)).collect()}
    want = {(i, j): km(at[i], at[j]) for i, j in itertools.combinations(range(len(at)), 2) if km(at[i], at[j]) <= reach}
    assert got.keys() == want.keys() and want
    assert all(abs(got[k]["km"] - d) < 1e-6 and got[k]["a_tag"] == f"k{k[0]}" and got[k]["b_tag"] == f"k{k[1]}" for k, d in want.items())


def test_linkage_and_guards_cross_the_date_line(spark):
    df = spark.createDataFrame([(1, 179.999, 10.0, 0), (2, -179.999, 10.0, 1), (3, 170.0, 10.0, 0)], "id bigint, lon double, lat double, label int")
    assert {x["id"]: x["cluster"] for x in geo.single_linkage(df, 2.0).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["fold"]: x["min_km"] for x in validation.fold_separation(df, "label", 2.0).collect()} == {0: pytest.approx(0.219, abs=1e-3), 1: pytest.approx(0.219, abs=1e-3)}
    with pytest.raises(ValueError, match=r"0\.219 km"):
        validation.assert_separated(df, "label", 2.0)


def kruskal(rows):
    """(group, a, b, km) in the order of (km, a, b), over the whole graph."""
    parent, out = {}, set()

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    groups = {}
    for i, x, y, g in rows:
        groups.setdefault(g, []).append((i, x, y))
    for g, own in groups.items():
        at = models.great_circle(np.array([p[1:] for p in own]), np.array([p[1:] for p in own]))
        pairs = sorted((at[p, q], min(own[p][0], own[q][0]), max(own[p][0], own[q][0])) for p, q in itertools.combinations(range(len(own)), 2))
        for _, a, b in pairs:
            u, v = root((g, a)), root((g, b))
            if u != v:
                parent[u] = v
                out.add((g, a, b))
    return out


def scattered(seed):
    """Two dense spots far apart, a wide field, a shared place, points around the date line."""
    r = np.random.default_rng(seed)
    at = [*r.normal((170, 10), 0.003, (90, 2)), *r.normal((-172, 12), 0.5, (60, 2)), *r.uniform((160, 0), (200, 25), (120, 2)), *[(175.0, 5.0)] * 5, *np.array(EDGES)]
    return [(k, float(x) if x <= 180 else float(x) - 360, float(y)) for k, (x, y) in enumerate(at)]


@pytest.mark.parametrize(("pairs", "edges"), [(4096, 50_000), (64, 20)])
def test_spanning_by_scales_equals_kruskal(spark, monkeypatch, pairs, edges):
    """Also where cells are cut several times, and where labels are joined by rounds."""
    monkeypatch.setattr(spatial, "PAIRS", pairs)
    monkeypatch.setattr(spatial, "EDGES", edges)
    rows = [(i, x, y, "g") for i, x, y in scattered(1)] + [(1000 + i, x, y, None) for i, x, y in scattered(2)[::9]] + [(5000, 1.0, 1.0, "alone")]
    df = spark.createDataFrame([*rows, (6000, None, 1.0, "g")], "id bigint, lon double, lat double, g string")
    got = spatial.spanning_by_scales(df, "g").collect()
    assert {(x["g"], x["a"], x["b"]) for x in got} == kruskal(rows) and len(got) == len(rows) - 3
    at = {r[0]: r[1:3] for r in rows}
    assert all(abs(x["km"] - km(at[x["a"]], at[x["b"]])) < 1e-6 for x in got)
    assert spatial.spanning_by_scales(df.limit(0), "g").collect() == []


@pytest.mark.parametrize("label", [None, "fold"])
def test_nearest_points_equal_brute_force(spark, label):
    rows = [(i, x, y, float(i % 13), i % 3) for i, x, y in scattered(3) if label is None or i >= 90]
    df = spark.createDataFrame([*rows, (7000, None, 1.0, 0.0, 0)], "id bigint, lon double, lat double, y double, fold int")
    got = {x["id"]: [(p["id"], p["y"]) for p in x["around"]] for x in spatial.nearest_points(df, df, 24, label).collect()}
    for i, x, y, _, g in rows:
        others = sorted((km((x, y), r[1:3]), r[0], r[3]) for r in rows if label is None or r[4] != g)[:24]
        want = [d for d, *_ in others]
        at = {r[0]: km((x, y), r[1:3]) for r in rows}
        assert [at[p] for p, _ in got[i]] == pytest.approx(want, abs=1e-7)
        assert all(v == float(p % 13) for p, v in got[i])
    assert got[7000] == []
    few = spatial.nearest_points(df.limit(4), df.filter("id in (100, 101, 102)"), 7).collect()
    assert all(len(x["around"]) == 3 for x in few)


def test_a_dense_spot_meets_few_pairs(spark):
    """Half of all points within some hundred metres of each other: rows still meet a constant times the points they ask for."""
    r = np.random.default_rng(8)
    at = np.concatenate([r.normal((20, 20), 0.004, (1000, 2)), r.uniform((19, 19), (21, 21), (1000, 2))])
    df = spark.createDataFrame([(k, float(x), float(y), 0.0) for k, (x, y) in enumerate(at)], "id bigint, lon double, lat double, y double")
    _, placed = spatial._nodes(spatial._located(df, "id", "y"), 40, 5)
    assert placed.count() == 2000 and placed.groupBy("depth", "csx", "csy", "csz").count().agg(F.max("count")).first()[0] <= 40
    got = spatial.nearest_points(df, df, 40).select("id", F.element_at("around", -1)["km"].alias("km")).collect()
    far = np.sort(models.great_circle(at[:50], at), axis=1)[:, 39]
    assert [x["km"] for x in sorted(got, key=lambda x: x["id"])[:50]] == pytest.approx(far.tolist(), abs=1e-7)


def test_order_statistics_without_sorting(spark, monkeypatch):
    r = np.random.default_rng(3)
    cases = [r.exponential(5, 3000).tolist(), [1.0, 1.0, 1.0], [2.5], [0.0, 1.0, 2.0, 3.0], [0.5 * k for k in range(2000)] + [1e6, 1e6 + 300], r.integers(0, 40, 500).astype(float).tolist()]
    for bins, cut, few in ((1 << 14, 1 << 13, 4096), (4, 2, 3)):
        monkeypatch.setattr(geo, "BINS", bins)
        monkeypatch.setattr(geo, "CUT", cut)
        monkeypatch.setattr(geo, "FEW", few)
        for values in cases if bins > 4 else [cases[1], cases[3], cases[5][:60], cases[0][:100]]:
            got = geo.ordered_summary(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
            v = sorted(values)
            gap = max(((b - a, -a, b) for a, b in zip(v, v[1:], strict=False)), default=None)
            assert tuple(got)[:4] == (len(v), v[0], v[len(v) // 2], v[-1])
            assert (got["gap"], got["gap_from"]) == ((gap[0], -gap[1]) if gap else (None, None)) or (gap and gap[0] == 0 == got["gap"])
    assert geo.ordered_summary(spark.createDataFrame([], "v double"), "v").collect() == []


def crossings(x, y, rings):
    inside, border = 0, False
    for ring in rings:
        for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                inside += 1
            if (c - a) * (y - b) - (d - b) * (x - a) == 0 and min(a, c) <= x <= max(a, c) and min(b, d) <= y <= max(b, d):
                border = True
    return inside % 2 == 1 or border


def test_polygons_with_holes_and_parts(spark):
    r = np.random.default_rng(5)
    star = lambda n, size, x, y: [(x + size * (1 + 0.6 * (k % 2)) * math.cos(6.283 * k / n), y + size * (1 + 0.6 * (k % 2)) * math.sin(6.283 * k / n)) for k in range(n)]
    shapes = {
        "square": [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(1.75, 1.75), (2.25, 1.75), (2.25, 2.25), (1.75, 2.25)]],
        "star": [star(14, 3.0, -5.0, 2.0), star(6, 0.7, -5.0, 2.0)], "tiny": [[(0.5, 0.5), (0.5001, 0.5), (0.5, 0.5001)]],
        "flat": [[(0.0, 8.0), (9.0, 8.0), (9.0, 8.0), (3.0, 8.0)]], "wide": [star(9, 60.0, 10.0, 0.0)],
    }
    vertices = [(name, k, n, *p) for name, rings in shapes.items() for k, ring in enumerate(rings) for n, p in enumerate(ring)]
    index = polygons.Index(spark.createDataFrame(vertices, "polygon string, ring int, nth int, x double, y double"))
    spots = [*r.uniform((-10, -2), (6, 10), (400, 2)).tolist(), *itertools.product(np.arange(-1, 5, 0.5), repeat=2), (0.50002, 0.50002), (0.5, 0.5), (5.0, 8.0), (10.0, 8.0), (-5.0, 2.0), *shapes["star"][0]]
    spots = [(float(x), float(y)) for x, y in spots]
    rows = [(k, *p) for k, p in enumerate(spots)] + [(9000, None, 1.0), (9001, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double")
    want = {(k, name) for k, p in enumerate(spots) for name, rings in shapes.items() if crossings(*p, rings)}
    assert {tuple(x) for x in index.covering(df, "id", "x", "y").collect()} == want
    left = {x["id"] for x in index.outside(df, ["id"], "x", "y").collect()}
    assert left == {r[0] for r in rows} - {k for k, _ in want}
    inside = index.cells.filter("inside").count()
    assert inside > 300  # most places of a large polygon meet no edge
    none = polygons.Index(spark.createDataFrame([], "polygon string, ring int, nth int, x double, y double"))
    assert none.covering(df, "id", "x", "y").collect() == [] and none.outside(df, ["id"], "x", "y").count() == len(rows)


@pytest.mark.parametrize("target", [surfaces.Grid(-10.013, 5.021, 0.07), surfaces.Grid(-10.0, 5.0, 0.025), surfaces.Grid(-9.5, 4.0, 0.1), surfaces.Grid(-10.05, 5.05, 0.1)])
def test_resampling_keeps_what_there_is(spark, target):
    r = np.random.default_rng(6)
    source = surfaces.Grid(-10.0, 5.0, 0.1)
    cells = [(i, j, float(r.normal())) for i in range(12) for j in range(9) if (i, j) != (3, 3)]
    df = spark.createDataFrame([*cells, (3, 3, None)], "i int, j int, z double")
    got = {(x["i"], x["j"]): (x["z"], x["covered"]) for x in surfaces.resample(df, "z", source, target).collect()}
    want = {}
    for i, j, z in cells:
        y0, x0 = (i * 0.1 + target.north - 5.0) / target.step, (j * 0.1 - 10.0 - target.west) / target.step
        size = 0.1 / target.step
        for p in range(math.floor(y0) - 1, math.ceil(y0 + size) + 1):
            for q in range(math.floor(x0) - 1, math.ceil(x0 + size) + 1):
                w = max(0.0, min(y0 + size, p + 1) - max(y0, p)) * max(0.0, min(x0 + size, q + 1) - max(x0, q))
                if w > 1e-8:
                    a, b = want.get((p, q), (0.0, 0.0))
                    want[p, q] = (a + w * z, b + w)
    assert {k for k, v in got.items() if v[1] > 1e-6} == {k for k, v in want.items() if v[1] > 1e-6}
    assert all(got[k][0] == pytest.approx(a / b, abs=1e-6) and got[k][1] == pytest.approx(b, abs=1e-6) for k, (a, b) in want.items() if b > 1e-6)
    flat = surfaces.resample(df.withColumn("z", F.lit(7.5)), "z", source, target)
    assert {round(x["z"], 9) for x in flat.collect()} == {7.5}
    assert flat.agg(F.sum("covered")).first()[0] * target.step**2 == pytest.approx(108 * 0.01)
    with pytest.raises(ValueError, match="bands"):
        surfaces.classify(F.lit(1.0), [1.0], ["a"])


def test_signed_dispositions_in_any_order(spark):
    """Two sources offer the same place; whichever comes first, the sums tell what the corpus holds."""
    log = "disposition string, evidence_class string, source_id string, displaced_source string"
    forward = [("Admit", "MASS", "low", None), ("Replace", "MASS", "high", "low"), ("AlreadyPresent", "MASS", "high", "high")]
    backward = [("Admit", "MASS", "high", None), ("AbsorbInto", "MASS", "low", "high"), ("AlreadyPresent", "MASS", "high", "high")]
    told = [sorted(map(tuple, merge.dispositions(spark.createDataFrame(rows, log), "source_id", "evidence_class").collect())) for rows in (forward, backward)]
    assert told[0] == told[1] == [("high", "MASS", 1, 0, 1), ("low", "MASS", 0, 1, 0)]


def test_permutation_losses_equal_numpy(spark):
    """The drawn order is a permutation of the rows; the driving column loses most, an idle one nothing; a forest agrees."""
    import hashlib

    r = np.random.default_rng(9)
    x = r.normal(size=(240, 3))
    y = 4 * x[:, 0] - x[:, 1] + 0.01 * r.normal(size=240)
    rows = spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(240)], "id bigint, y double, a double, b double, c double")
    guess = lambda df: df.withColumn("prediction", 4 * F.col("a") - F.col("b"))
    got = models.permutation_importance(rows, ["a", "b", "c"], guess, [3, 4])
    base = math.sqrt(np.mean((4 * x[:, 0] - x[:, 1] - y) ** 2))
    for row in got.collect():
        order = sorted(range(240), key=lambda k: (hashlib.md5(f"{row['seed']}:{k}".encode()).hexdigest(), k))
        z = x.copy()
        z[:, "abc".index(row["feature"])] = x[order, "abc".index(row["feature"])]
        assert row["rmse"] == pytest.approx(math.sqrt(np.mean((4 * z[:, 0] - z[:, 1] - y) ** 2)))
        assert row["loss"] == pytest.approx(row["rmse"] - base)
    spread = {x["feature"]: x for x in models.importance_spread(got).collect()}
    assert [spread[f]["place"] for f in "abc"] == [1, 2, 3] and spread["c"]["mean_loss"] == pytest.approx(0) and spread["a"]["least"] <= spread["a"]["most"]
    forest = models.forest_importance(rows.filter("id % 4 <> 0"), rows.filter("id % 4 = 0"), ["a", "b", "c"], [0, 1])
    assert {x["feature"] for x in models.importance_spread(forest).filter("place = 1").collect()} == {"a"}
    shares = forest.groupBy("seed").agg(F.sum("impurity").alias("s"), F.max_by("feature", "impurity").alias("f")).collect()
    assert all(x["s"] == pytest.approx(1) and x["f"] == "a" for x in shares)


def test_every_row_a_fold_of_its_own(spark):
    """As many folds as rows: models come from bins by fold, and are those of plain kriging."""
    r = np.random.default_rng(4)
    n = 70
    at = r.uniform((-120, 10), (-119, 11), (n, 2))
    y = np.sin(6 * at[:, 0]) + np.cos(5 * at[:, 1])
    df = spark.createDataFrame([(k, float(at[k, 0]), float(at[k, 1]), float(y[k]), k) for k in range(n)], "id bigint, lon double, lat double, y double, label int")
    edges = [0.0, 15, 30, 45, 60, 80]
    near = {x["id"]: x for x in models.kriging_cv(df, edges, 20, most=10, near=n).collect()}
    for k in range(0, n, 9):
        rest = np.arange(n) != k
        p, sd = models.Kriging(at[rest], y[rest], np.array(edges), 20).predict(at[k : k + 1])
        assert near[k]["fold"] == k and near[k]["prediction"] == pytest.approx(p[0], abs=1e-5) and near[k]["sd"] == pytest.approx(sd[0], abs=1e-5)
    flat = models.kriging_cv(df.withColumn("y", F.when(F.col("id") == 3, 2.0).otherwise(1.0)), edges, 20, most=10)
    assert {(x["id"] == 3, x["refusal"]) for x in flat.filter("id in (3, 4)").collect()} == {(True, "the target is constant"), (False, None)}


def test_spanning_edges_that_a_cell_makes_out():
    """Of a cell's places most are joined before any scale, by edges of the whole's spanning tree only."""
    import pandas as pd


    rng, side = np.random.default_rng(9), 2.0**-9
    at = np.stack([np.full(900, 0.5 + side / 2), *(rng.random((2, 900)) * 2 * side)], axis=1)  # four cells
    rows = pd.DataFrame(at, columns=list(spatial.AXES)).assign(id=np.arange(900), label=np.arange(900) + 5000, depth=10, lon=at[:, 1], lat=at[:, 2])
    for k, a in enumerate(spatial.AXES):
        rows[f"c{a}"] = np.floor((at[:, k] + 1) / side).astype(int)
    square = ((at[:, None] - at[None]) ** 2).sum(2)
    near, to, left, whole, now = np.full(900, np.inf), np.zeros(900, int), np.ones(900, bool), set(), 0
    left[0] = False
    while left.any():
        closer = left & (square[now] < near)
        near[closer], to[closer] = square[now][closer], now
        now = int(np.where(left, near, np.inf).argmin())
        left[now] = False
        whole.add((min(now, int(to[now])), max(now, int(to[now]))))
    taken, roots = set(), set()
    for _, cell in rows.groupby(["csx", "csy", "csz"]):
        got = spatial._spanning_within(cell)
        edges, placed = got[got["root"].isna()], got[got["root"].notna()]
        taken |= set(zip(edges["a"], edges["b"], strict=True))
        roots |= set(placed["root"])
        assert len(placed) == len(cell) and len(cell) - len(edges) == placed["root"].nunique()
    assert taken <= whole and len(roots) < 300
