"""Hand-computed answers and invariants of single operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.geodesy import covered, radius_cells, window_cells
from fathomline.operators import geo, graph, grid, ingest, merge, models, provenance, validation
from fathomline.sources import readers


def test_window_resolution():
    assert window_cells(390, 100) == (3, False)
    assert window_cells(440, 100) == (5, False)
    assert window_cells(400, 100) == (5, False)
    assert window_cells(1400, 11132) == (3, True)
    assert radius_cells(40, 100) == 1


def test_metrics(spark):
    y, p, sd = [10.0, 12, 15, 9, 20], [11.0, 10, 15, 12, 14], [2.0, 1, 0, 3, 5]
    rows = spark.createDataFrame([("a", *map(float, r)) for r in zip(y, p, sd, strict=True)], "g string, y double, prediction double, sd double")
    r = validation.scores(rows, ["g"]).first()
    assert r["rmse"] == pytest.approx(math.sqrt(10))
    assert r["mae"] == pytest.approx(2.4)
    assert r["mean_error"] == pytest.approx(-0.8)
    assert r["coverage_1sigma"] == pytest.approx(0.6)
    assert r["standardized_rmse"] == pytest.approx(math.sqrt(6.69 / 5))
    assert r["r2_pooled"] == pytest.approx(1 - 50 / 78.8)
    wrong = rows.withColumn("sd", F.when(F.col("y") == 12, 0.0).otherwise(F.col("sd")))
    r = validation.scores(wrong, ["g"]).first()
    assert r["standardized_rmse"] is None
    assert (r["n_sd_zero"], r["n_sd_zero_wrong"]) == (2, 1)
    assert r["standardized_finite"] == pytest.approx(math.sqrt(2.69 / 4))


def plane(spark, z, n=9):
    return spark.createDataFrame([(i, j, float(z(i, j))) for i in range(n) for j in range(n)], "i int, j int, z double")


def test_slope_and_aspect(spark):
    step = 0.01 * grid.M_PER_DEGREE
    south = grid.slope_aspect(grid.gather(grid.metric(plane(spark, lambda i, j: -i * step / 100), 14, 0.01)))
    inner = south.filter("i between 1 and 7 and j between 1 and 7").agg(F.min("slope"), F.max("slope"), F.min("aspect"), F.max("aspect")).first()
    assert inner[0] == pytest.approx(math.degrees(math.atan(0.01))) and inner[1] == pytest.approx(inner[0])
    assert inner[2] == pytest.approx(180) and inner[3] == pytest.approx(180)
    assert south.filter("slope is null").count() == 81 - 49
    flat = grid.slope_aspect(grid.gather(grid.metric(plane(spark, lambda i, j: 5), 14, 0.01)))
    assert {r[0] for r in flat.filter("slope is not null").select("aspect").collect()} == {-1.0}
    east = grid.slope_aspect(grid.gather(grid.metric(plane(spark, lambda i, j: -j), 14, 0.01)))
    assert east.filter("i = 4 and j = 4").first()["aspect"] == pytest.approx(90)


def test_tpi_roughness_and_bpi(spark):
    bump = plane(spark, lambda i, j: 10 if (i, j) == (4, 4) else 0)
    got = {(r["i"], r["j"]): r for r in grid.square_moments(bump, 3).collect()}
    assert got[4, 4]["tpi"] == pytest.approx(10 - 10 / 9)
    assert got[4, 5]["tpi"] == pytest.approx(-10 / 9)
    assert got[0, 0]["tpi"] is None
    slope = {(r["i"], r["j"]): r for r in grid.square_moments(plane(spark, lambda i, j: 7 * i), 3).collect()}
    assert slope[4, 4]["roughness"] == pytest.approx(7 * math.sqrt(2 / 3))
    ring = {(r["i"], r["j"]): r["bpi"] for r in grid.bpi(bump, 1, 2).collect()}
    assert ring[4, 4] == pytest.approx(10)
    assert ring[4, 5] == pytest.approx(-10 / grid.ring_size(1, 2))
    assert ring[1, 4] is None
    hole = bump.filter("not (i = 4 and j = 5)")
    assert grid.slope_aspect(grid.gather(grid.metric(hole, 14, 0.01))).filter("i = 4 and j = 4").first()["slope"] is None


def test_curvature_of_a_dome(spark):
    dome = grid.metric(plane(spark, lambda i, j: -((i - 4) ** 2) - (j - 4) ** 2), 0.045, 0.01)
    got = {(r["i"], r["j"]): r for r in grid.curvature(grid.gather(dome)).collect()}
    assert got[4, 4]["profile_curvature"] == 0
    assert got[4, 6]["profile_curvature"] > 0 and got[6, 4]["plan_curvature"] > 0


def test_normalise_and_screen(spark):
    rows = spark.createDataFrame(
        [
            ("MASS", 12.0, " KG/m2 ", None, 0.25, None, None, "pending"),
            ("MASS", None, None, 5.0, 0.0, None, None, "pending"),
            ("MASS", None, None, 20.0, 0.25, None, None, "pending"),
            ("MASS", 0.0, "kg_m2", None, None, None, None, None),
            ("COUNT", None, None, None, None, 40.0, 50.0, "pass"),
            ("COUNT", None, None, None, None, 40.0, None, "pass"),
            ("COVER", 3.0, "kg_m2", None, None, None, None, "pending"),
            ("GRID", 7.0, None, None, None, None, None, "fail"),
        ],
        "evidence_class string, abundance_value_original double, abundance_unit_original string, nodule_mass_kg double,"
        " sampled_area_m2 double, nodule_density_m2 double, mean_nodule_mass_g double, qa_status string",
    )
    got = ingest.screen(ingest.normalise(rows)).select("abundance_kg_m2", "quality_grade", "qa_status").collect()
    assert [tuple(r) for r in got] == [
        (12.0, "A", "pending"), (None, None, "fail"), (80.0, "A", "flagged"), (0.0, "A", None), (2.0, "B", "pass"),
        (None, None, "pass"), (None, "B", "pending"), (7.0, "C", "fail"),
    ]
    with pytest.raises(Exception, match="unknown evidence class"):
        ingest.normalise(rows.withColumn("evidence_class", F.lit("OTHER"))).collect()


def test_validation_modes(spark):
    rows = spark.createDataFrame([("MASS", 10.0), ("COVER", 10.0), ("MASS", 101.0), ("MASS", 0.0)], "evidence_class string, abundance_kg_m2 double")
    good, bad = ingest.validate(rows)
    assert good.count() == 2
    assert {tuple(r["violations"]) for r in bad.collect()} == {("rule:no_abundance",), ("range:abundance_kg_m2",)}
    with pytest.raises(Exception):  # noqa: B017
        ingest.validate(rows, strict=True)[0].collect()


def test_unweighed_and_origins(spark):
    remarks = ["Plus 13 Nodules of less than 5g", "broken", None, "one; plus 2 nodule of  less than 5 g, plus 4 nodules of less than 5g", "plus some nodules of less than 5g", ""]
    rows = spark.createDataFrame([(r,) for r in remarks], "c string")
    assert [r[0] for r in rows.select(ingest.unweighed_in(F.col("c"))).collect()] == [13, 0, 0, 2, 0, 0]
    assert [r[0] for r in rows.select(ingest.author_allowed(F.col("c"), ["broken"])).collect()] == [False, True, False, False, False, False]
    names = spark.createDataFrame([("MEASURED",), ("SYNTHETIC",), ("DERIVED",)], "o string")
    assert names.agg(ingest.least_real(ingest.origin_rank(F.col("o")))).first()[0] == "SYNTHETIC"
    with pytest.raises(Exception, match="undeclared"):
        names.agg(ingest.least_real(ingest.origin_rank(F.lit("x")))).collect()


def test_small_components_equal_rounds(spark, monkeypatch):
    import random

    r = random.Random(1)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(190)] + [(1000 + k, 1001 + k) for k in range(60)], "a bigint, b bigint")
    at_once = sorted(map(tuple, graph.components(edges).collect()))
    monkeypatch.setattr(graph, "SMALL", -1)
    assert at_once == sorted(map(tuple, graph.components(edges).collect()))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_band_join_finds_all_pairs(spark):
    r = np.random.default_rng(0)
    xy = np.round(r.random((300, 2)), 3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id bigint, x double, y double")
    got = {(r["l_id"], r["r_id"]) for r in geo.band_join(df, df, {"x": 0.05, "y": 0.02}).collect()}
    want = {(i, j) for i in range(300) for j in range(300) if abs(xy[i, 0] - xy[j, 0]) <= 0.05 and abs(xy[i, 1] - xy[j, 1]) <= 0.02}
    assert got == want
    assert geo.all_pairs(df, tile=64).count() == 300 * 299 // 2


def test_polygon_covers_its_border(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.0, 0.0), (3.0, 1.0)], "x double, y double")
    assert [r[0] for r in pts.select(covered(F.col("x"), F.col("y"), ring)).collect()] == [True, True, True, False]


SCHEMA = (
    "seq bigint, source_record_id string, source_id string, evidence_class string, longitude double, latitude double, cruise string,"
    " abundance_kg_m2 double, quality_grade string, qa_status string, duplicate_group_id string, notes string"
)


def rec(seq, lon, grade, source="src_a", cruise="c", value=None, status="pending"):
    return (seq, f"r{seq}", source, "MASS", lon, 0.0, cruise, value, grade, status, None, None)


def fold(corpus, batch, tol=0.001):
    """The upsert, one candidate after the other."""
    keep = [dict(zip(SCHEMA_NAMES, r, strict=True)) for r in corpus]
    new, log = [], []
    for raw in batch:
        c = dict(zip(SCHEMA_NAMES, raw, strict=True))
        hit = next((s for s in keep if abs(s["longitude"] - c["longitude"]) <= tol and (s["cruise"] is None or c["cruise"] is None or s["cruise"] == c["cruise"])), None)
        if hit is None:
            new.append(c)
            log.append((c["seq"], None, "Admit"))
            continue
        if (hit["source_id"], hit["source_record_id"]) == (c["source_id"], c["source_record_id"]):
            log.append((c["seq"], hit["seq"], "AlreadyPresent"))
            continue
        rank = {"A": 3, "B": 2, "C": 1, None: 0}
        wins = rank[c["quality_grade"]] > rank[hit["quality_grade"]]
        s, d = (c, dict(hit)) if wins else (dict(hit), c)
        sev = {"fail": 2, "flagged": 1}
        merged = {k: s[k] if s[k] is not None else d[k] for k in s if k not in ("notes", "duplicate_group_id", "seq")}
        merged["qa_status"] = max(s["qa_status"], d["qa_status"], key=lambda x: sev.get(x, 0)) if sev.get(d["qa_status"], 0) > sev.get(s["qa_status"], 0) else s["qa_status"]
        merged["duplicate_group_id"] = s["duplicate_group_id"] or f"dupgrp_{s['source_record_id']}"
        hit.update(merged)
        log.append((c["seq"], hit["seq"], "Replace" if wins else "AbsorbInto"))
    return keep + new, log


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_upsert_is_the_ordered_fold(spark):
    corpus = [rec(0, 0.0, "B", value=1.0), rec(1, 0.01, "A", cruise=None, value=2.0), rec(2, 0.02, None)]
    batch = [
        rec(10, 0.0009, "A", "src_b", cruise=None),  # moves slot 0 to 0.0009
        rec(11, 0.0018, "C", "src_b", value=9.0),  # matches slot 0 only after that move
        rec(12, -0.0005, "C", "src_b"),  # matched slot 0 before the move, not after
        rec(13, 0.01, "C", "src_b", status="fail"),
        rec(14, 0.5, "A", "src_b"), rec(15, 0.5, "A", "src_b"),  # blind to each other: both enter
        rec(16, 0.02, "C", "src_b", value=3.0), rec(17, 0.02, "B", "src_b", value=4.0),
    ]
    want, want_log = fold(corpus, batch)
    got, log = merge.upsert(
        spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame(batch, SCHEMA), {"longitude": 0.001, "latitude": 0.001}, tolerant_on=["cruise"]
    )
    assert sorted(map(tuple, log.select("candidate", "slot", "disposition").collect())) == want_log
    names = [n for n in SCHEMA_NAMES if n != "notes"]
    assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(r[n] for n in names) for r in want}
    again, log = merge.upsert(got, got.filter("seq < 3"), {"longitude": 0.001, "latitude": 0.001})
    assert {r["disposition"] for r in log.collect()} == {"AlreadyPresent"}
    assert again.count() == got.count()


def test_merge_note(spark):
    got, _ = merge.upsert(
        spark.createDataFrame([rec(0, 0.0, "A", cruise=None)], SCHEMA), spark.createDataFrame([rec(5, 0.0, "B", "src_b", status="fail")], SCHEMA),
        {"longitude": 0.001, "latitude": 0.001}, tolerant_on=["cruise"],
    )
    r = got.first()
    assert r["notes"] == "duplicate of r5 (src_b); merged fields: cruise; qa_status escalated pending -> fail from r5"
    assert (r["qa_status"], r["cruise"], r["duplicate_group_id"]) == ("fail", "c", "dupgrp_r0")


def test_variogram_bins(spark):
    pairs = spark.createDataFrame([(1.0, 4.0), (1.5, 5.0), (2.0, 12.5), (9.0, 1.0)], "km double, half_sq double")
    got = [(r["pair_count"], r["semivariance"]) for r in models.variogram_bins(pairs, [0.0, 2.0, 4.0, 6.0]).orderBy("bin").collect()]
    assert got == [(2, 4.5), (1, 12.5), (0, None)]


def test_kriging_is_exact_at_its_points():
    r = np.random.default_rng(3)
    xy = np.stack([r.uniform(-125, -124, 60), r.uniform(10, 11, 60)], 1)
    y = np.sin(xy[:, 0] * 9) + np.cos(xy[:, 1] * 7)
    model = models.Kriging(xy, y, np.arange(0, 160, 10.0))
    p, sd = model.predict(xy)
    assert np.abs(p - y).max() < 1e-6 and sd.max() < 1e-3
    with pytest.raises(ValueError, match="constant"):
        models.Kriging(xy, np.ones(60), np.arange(0, 160, 10.0))
    with pytest.raises(ValueError, match="three are needed"):
        models.Kriging(xy[:2], y[:2], np.arange(0, 160, 10.0))


def test_variogram_fit_agrees_with_numpy(spark):
    lag, w = np.array([1.0, 3, 5, 7, 9, 11]), np.array([40.0, 60, 80, 70, 50, 45])
    g = 2 + 6 * (1 - np.exp(-3 * lag / 8))
    rows = [(k, float(2 * k), float(2 * k + 2), int(w[k]), float(g[k]), float(lag[k])) for k in range(6)]
    bins = spark.createDataFrame(rows, "bin int, lag_lo_km double, lag_hi_km double, pair_count bigint, semivariance double, mean_lag_km double")
    r = models.variogram_fit(bins).first()
    assert (r["nugget"], r["partial_sill"], r["range_km"]) == pytest.approx(models.fit_bins(lag, g, w), rel=1e-5)
    assert models.variogram_fit(bins.limit(2)).count() == 0


def test_forest_pairs_each_prediction_with_a_spread(spark):
    rows = spark.createDataFrame([(k, float(k % 50), float(k % 7), float((k % 50) * 2)) for k in range(400)], "id bigint, a double, b double, y double")
    out = models.forest_quantiles(rows.filter("id % 4 > 0"), rows.filter("id % 4 = 0"), ["a", "b"], trees=10).join(rows, "id")
    assert out.count() == 100 and out.filter("sd < 0 or sd is null").count() == 0
    assert out.filter("abs(prediction - y) <= 12").count() >= 90


def test_forest_report(spark):
    train = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 2.0, 6.0), (3.0, 2.0, 9.0)], "a double, b double, y double")
    got = models.forest_report(train, spark.createDataFrame([(0.0,), (1.5,)], "sd double"), ["a", "b"]).first()
    assert (got["rows"], got["distinct_rows"], got["predictions"], got["without_spread"]) == (3, 2, 2, 1)
    assert got["quantiles"] == [5.0, 5.0, 6.0, 9.0, 9.0]


def test_spanning_edges_equal_kruskal(spark):
    import random

    r = random.Random(3)
    rows = [(k, r.uniform(-120, -118), r.uniform(9, 11), k % 3) for k in range(90)]
    km = lambda a, b: float(models.great_circle(np.array([a[1:3]]), np.array([b[1:3]]))[0, 0])
    parent = list(range(90))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    want = set()
    for _, a, b in sorted((km(p, q), p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and p[3] == q[3]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b))
    df = spark.createDataFrame(rows, "id bigint, lon double, lat double, g int")
    for most in (4000, 20):
        assert {(x["a"], x["b"]) for x in models.mst_edges(df, "g", most=most).collect()} == want


def test_mst(spark):
    pts = spark.createDataFrame([(k, 0.1 * k, 0.0, "g") for k in range(6)], "id bigint, lon double, lat double, g string")
    assert sorted((r["a"], r["b"]) for r in models.mst_edges(pts, "g").collect()) == [(k, k + 1) for k in range(5)]


def test_fold_checks(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.01, 0.0, 1), (3, 5.0, 0.0, 1)], "id bigint, lon double, lat double, label int")
    validation.assert_folds(pts)
    with pytest.raises(ValueError, match="km from a test row"):
        validation.assert_separated(pts, "label", 10.0)
    validation.assert_separated(pts, "label", 0.5)
    with pytest.raises(ValueError, match="no fold"):
        validation.assert_folds(pts.withColumn("label", F.when(F.col("id") > 1, F.col("label"))))
    folds = validation.random_folds(pts.select("id"), 2, 1).groupBy("label").count().collect()
    assert sorted(r["count"] for r in folds) == [1, 2]


def test_manifest_chain(spark):
    rows = spark.createDataFrame([(1.0, 2.0, "MASS", "pass", "src_a")], "longitude double, latitude double, evidence_class string, qa_status string, source_id string")
    corpus = provenance.corpus_manifest(rows)
    run = provenance.sealed("run", {"k": 1}, {"corpus": corpus["content_sha256"]})
    provenance.verify(run, {"corpus": corpus})
    with pytest.raises(ValueError, match="differs"):
        provenance.verify(run | {"k": 2})
    assert provenance.content_hash(run | {"path": "/elsewhere"}) == run["content_sha256"]
    assert provenance.frame_hash(rows) == provenance.frame_hash(rows.unionByName(rows).distinct())


def test_tab_reader_and_guard(spark, tmp_path):
    f = tmp_path / "x.tab"
    f.write_text("/* DATA\nEvent(s):\tA_1 (x) * COMMENT: failed recovery\nA_2 (y) * COMMENT: fine * LOC: q\n*/\nEvent\tNodules [#]\nA_1\t3\nA_2\t\n")
    rows, comments = readers.read_tab(spark, str(f))
    assert [tuple(r) for r in rows.orderBy("_row").collect()] == [("A_1", "3", 0), ("A_2", None, 1)]
    assert {tuple(r) for r in comments.collect()} == {("A_1", "failed recovery"), ("A_2", "fine * LOC: q")}
    told = readers.with_comments(rows, comments, "Event").orderBy("_row").select("Event", "comment").collect()
    assert [tuple(r) for r in told] == [("A_1", "failed recovery"), ("A_2", "fine * LOC: q")]
    f.write_text("no header end\n")
    with pytest.raises(ValueError, match="no end"):
        readers.read_tab(spark, str(f))
    import hashlib

    good = {"data_origin": "MEASURED", "sha256": hashlib.sha256(b"x").hexdigest()}
    readers.admit(good, b"x")
    for entry, content in ((None, b"x"), (good | {"data_origin": "AUTHORED"}, b"x"), (good | {"sha256": "1"}, b"x"), (good, None), (good, b"y")):
        with pytest.raises(ValueError):
            readers.admit(entry, content)


def test_a_tab_file_is_read_by_splits(spark, tmp_path):
    """Numbers of lines are those of the whole file, however it is split; blank lines and returns count as they stand."""
    f = tmp_path / "long.tab"
    body = [f"A_{k}\t{k * 3}" if k % 50 else "" for k in range(4000)]
    f.write_bytes("\r\n".join(["/* DATA", "A_1 (x) * COMMENT: one", "*/", "Event\tN", *body]).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows, comments = readers.read_tab(spark, str(f))
        got = {r["_row"]: (r["Event"], r["N"]) for r in rows.collect()}
        assert spark.read.text(str(f)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert got == {k: (f"A_{k}", str(k * 3)) for k in range(4000) if k % 50}
    assert [tuple(r) for r in comments.collect()] == [("A_1", "one")]


def test_events_become_two_records(spark):
    pieces = spark.createDataFrame(
        [
            ("S1_2", 0, 30.0, None, None, "a", -4000.0, None), ("S1_2", 1, None, 4.0, "Broken", "b", -1.0, None), ("S1_2", 2, None, None, "Plus 13 Nodules of less than 5g", "b", -1.0, None),
            ("S1_2", 3, 10.0, None, "plus 2 nodules of less than 5 g", "b", -1.0, None), ("S1_10", 0, None, None, "note", "c", None, "Recovery FAILED"), ("S1_10", 1, 5.0, 1.0, None, "d", -9.0, None),
        ],
        "event string, nth int, g double, width double, remark string, ship string, elevation double, told string",
    )
    from fathomline.sources import adapters

    got = {r["source_record_id"]: r for r in adapters.event_records(
        pieces, "src_x", "event", ["nth"], "g", dimensions=["width"], remark="remark", shared={"vessel": "ship"}, elevation="elevation", event_comment="told", area_m2=0.25).collect()}
    assert sorted(got) == ["src_x_COUNT_000000", "src_x_COUNT_000001", "src_x_MASS_000000", "src_x_MASS_000001"]
    count, mass = got["src_x_COUNT_000001"], got["src_x_MASS_000001"]
    assert (count["event"], count["nodule_count"], count["nodule_density_m2"], count["quality_grade"]) == ("S1_2", 18, 72.0, None)
    assert (mass["nodule_mass_kg"], mass["mean_nodule_mass_g"], mass["quality_grade"], mass["vessel"], mass["water_depth_m"], mass["cruise"]) == (0.04, 20.0, "B", "a", 4000.0, "S1")
    assert "15 unweighed pieces (83%" in mass["notes"] and "15 unweighed" in mass["derivation_formula"]
    failed = got["src_x_MASS_000000"]
    assert (failed["qa_status"], failed["notes"], failed["water_depth_m"], failed["vessel"]) == ("flagged", "event comment: Recovery FAILED", None, "c")


def test_ingest_counts_come_from_the_writing_job(spark):
    rows = spark.createDataFrame([("MASS", 12.0, "kg_m2"), ("MASS", 50.0, "kg_m2"), ("MASS", 120.0, "kg_m2"), ("COVER", 1.0, None)], "evidence_class string, abundance_value_original double, abundance_unit_original string")
    rows = rows.selectExpr("*", "cast(null as double) as nodule_mass_kg", "cast(null as double) as sampled_area_m2", "cast(null as double) as nodule_density_m2", "cast(null as double) as mean_nodule_mass_g", "'pending' as qa_status")
    made, counts = ingest.ingested(rows)
    assert tuple(counts.first()) == (4, 3, 2, 1, 12.0, 120.0) and made.filter("size(violations) > 0").count() == 1
    none = ingest.ingested(rows.limit(0))[1].first()
    assert tuple(none)[:4] == (0, 0, 0, 0) and none["least"] is None


def test_recorded_distances_are_measured_anew(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 0.1, 0.0, 1), (3, 1.0, 0.0, 2)], "id bigint, lon double, lat double, label int")
    true = validation.fold_distance(pts, "label", 5.0).select("fold", "min_km")
    validation.assert_recorded(pts, "label", true, 5.0)
    with pytest.raises(ValueError, match="too near"):
        validation.assert_recorded(pts, "label", true, 20.0)
    with pytest.raises(ValueError, match="fold 2: not as recorded"):
        validation.assert_recorded(pts, "label", true.withColumn("min_km", F.col("min_km") + (F.col("fold") == 2).cast("int")), 5.0)
    with pytest.raises(ValueError, match="fold 1: not as recorded"):
        validation.assert_recorded(pts, "label", true.filter("fold <> 1"), 5.0)


def test_csv_reads_nan_as_null(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("a,b\n1.5,NaN\n,2\n")
    got = [tuple(r) for r in readers.read_csv(spark, str(f), "a double, b double").collect()]
    assert got == [(1.5, None), (None, 2.0)]


def test_fold_distance_has_no_bound(spark):
    # b and c are nearest across the date line, d is far from all
    rows = [(1, 0.0, 0.0, "a"), (2, 0.1, 0.0, "a"), (3, 179.0, 50.0, "b"), (4, -179.0, 50.0, "c"), (5, -10.0, -89.0, "d"), (6, 0.1, 0.1, "e"), (7, 30.0, None, "e"), (8, 5.0, 5.0, None)]
    pts = spark.createDataFrame(rows, "id bigint, lon double, lat double, label string")
    want = {f: min(
        (models.great_circle(np.array([[x, y]]), np.array([[u, v]]))[0, 0] for _, x, y, g in rows for _, u, v, h in rows if g == f and None not in (f, h) and f != h and y is not None and v is not None),
        default=None) for f in ("a", "b", "c", "d", "e", None)}
    got = {r["fold"]: r for r in validation.fold_distance(pts, "label", 30.0).collect()}
    assert {f: r["min_km"] for f, r in got.items()} == {f: pytest.approx(d, rel=1e-9) if d is not None else None for f, d in want.items()}
    assert got["a"]["test_rows"] == 2 and want["d"] > 9000 and want["b"] < 150
    alone = validation.fold_distance(pts.filter("label = 'a'"), "label", 30.0).collect()
    assert [tuple(r) for r in alone] == [("a", 2, None)]


def test_mst_of_large_groups(spark):
    r = np.random.default_rng(5)
    at = [(k, float(x), float(y), "g" if k < 45 else "h") for k, (x, y) in enumerate(r.normal(0, 0.2, (60, 2)) + np.where(np.arange(60)[:, None] % 3 == 0, 4.0, 0.0))]
    at += [(60, 0.0, 0.0, "i"), (61, 0.0, 0.0, "i"), (62, 0.0, 1.0, "i"), *((70 + k, 1.0 * k, 0.0, None) for k in range(12)), (90, 0.0, 0.0, "j")]
    pts = spark.createDataFrame(at, "id bigint, lon double, lat double, g string")
    rows = lambda df: sorted(((r["g"], r["a"], r["b"], round(r["km"], 6)) for r in df.collect()), key=str)
    want = rows(models.mst_edges(pts, "g"))
    assert rows(models.mst_edges(pts, "g", most=10)) == want and len(want) == 44 + 14 + 2 + 11


def field(spark, n=260):
    import numpy as np

    r = np.random.default_rng(4)
    lon, lat = r.uniform(-120, -119, n), r.uniform(10, 11, n)
    y = np.sin(6 * lon) + np.cos(5 * lat) + 0.05 * r.normal(size=n)
    rows = [(k, float(lon[k]), float(lat[k]), float(y[k]), k % 4) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, lon double, lat double, y double, label int"), rows


LAGS = [0.0, 5, 10, 15, 20, 30, 40, 60]


def test_kriging_equals_plain_systems(spark):
    """Each fold: bins, fit and system in plain numpy, one right side at a time."""
    import numpy as np

    df, rows = field(spark, 120)
    got = {r["id"]: r for r in models.kriging_cv(df, LAGS, 20).collect()}
    km = lambda a, b: float(models.great_circle(np.array([a[1:3]]), np.array([b[1:3]]))[0, 0])
    for fold in range(4):
        train = [r for r in rows if r[4] != fold]
        pairs = [(km(a, b), 0.5 * (a[3] - b[3]) ** 2) for i, a in enumerate(train) for b in train[i + 1 :]]
        bins = []
        for lo, hi in zip(LAGS, LAGS[1:], strict=False):
            own = [p for p in pairs if lo <= p[0] < hi]
            if len(own) >= 20:
                bins.append((np.mean([p[0] for p in own]), np.mean([p[1] for p in own]), len(own)))
        model = models.fit_bins(*np.array(bins, float).T)
        n = len(train)
        system = np.array([[float(models.gamma(np.array([km(a, b)]), *model)[0]) for b in train] + [1.0] for a in train] + [[1.0] * n + [0.0]])
        for test in [r for r in rows if r[4] == fold][:6]:
            right = np.array([float(models.gamma(np.array([km(a, test)]), *model)[0]) for a in train] + [1.0])
            w = np.linalg.solve(system, right)
            assert got[test[0]]["prediction"] == pytest.approx(w[:-1] @ [a[3] for a in train], abs=1e-6)
            assert got[test[0]]["sd"] == pytest.approx(math.sqrt(max(0, w @ right)), abs=1e-5)


def test_local_kriging_is_near_the_whole_system(spark):
    df, _ = field(spark)
    whole = {r["id"]: r for r in models.kriging_cv(df, LAGS, 20).collect()}
    for near, error in ((260, 1e-6), (64, 0.05)):
        local = {r["id"]: r for r in models.kriging_cv(df, LAGS, 20, most=10, near=near).collect()}
        assert local.keys() == whole.keys()
        assert max(abs(local[k]["prediction"] - whole[k]["prediction"]) for k in whole) < error
        assert max(abs(local[k]["sd"] - whole[k]["sd"]) for k in whole) < error
    cells = df.select(F.col("id").alias("cell"), (F.col("lon") + 0.01).alias("lon"), "lat")
    a = {r["cell"]: r for r in models.kriging_surface(df, cells, LAGS, 20).collect()}
    b = {r["cell"]: r for r in models.kriging_surface(df, cells, LAGS, 20, most=10).collect()}
    assert a.keys() == b.keys() and max(abs(a[k]["prediction"] - b[k]["prediction"]) for k in a) < 0.05
    flat = {r["refusal"] for r in models.kriging_cv(df.withColumn("y", F.lit(1.0)), LAGS, 20, most=10).collect()}
    assert flat == {"the target is constant"}
