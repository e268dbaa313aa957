"""Matrix assembly, the grade join, and the cross-validation runner."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import grid, matrix, runner


def test_matrix_guards(spark):
    cells = spark.createDataFrame([(i, j, float(i * j)) for i in range(5) for j in range(5)], "i int, j int, z double")
    layers = grid.slope_aspect(grid.gather(grid.metric(cells, 1.0, 0.2))).select("i", "j", "z", "slope")
    at = spark.createDataFrame([(2, 0.5, 0.5, 3.0), (1, 0.3, 0.3, 4.0)], "id bigint, lon double, lat double, y double")
    got = matrix.extract(at, layers, 0.0, 1.0, 0.2)
    table, manifest = matrix.assemble(got, ["z", "slope"], "y", 2)
    assert [r["id"] for r in table.collect()] == [1, 2] and manifest["rows"] == 2
    with pytest.raises(ValueError, match="the manifest has 3"):
        matrix.assemble(got, ["z"], "y", 3)
    with pytest.raises(ValueError, match="off the grid: 2"):
        matrix.extract(at.withColumn("lon", F.when(F.col("id") == 2, 9.0).otherwise(F.col("lon"))), layers, 0.0, 1.0, 0.2)
    with pytest.raises(ValueError, match="more than once"):
        matrix.extract(at.unionByName(at), layers, 0.0, 1.0, 0.2)
    edge = matrix.extract(at.withColumn("lon", F.lit(0.05)), layers, 0.0, 1.0, 0.2)
    with pytest.raises(ValueError, match="missing values"):
        matrix.assemble(edge, ["slope"], "y")


def test_grades_find_their_stations(spark):
    stations = spark.createDataFrame([(1, "s1", "c", "e", 0.0, 0.0), (2, "s2", "c", "e", 0.02, 0.0), (3, None, "d", "e", 0.0, 0.0)], "id bigint, station_id string, cruise string, event string, lon double, lat double")
    grades = spark.createDataFrame(
        [(10, "s2", "c", "e", 5.0, 5.0), (11, None, "c", "e", 0.015, 0.0), (12, "zz", "d", "e", 0.001, 0.0), (13, None, "x", "e", 0.0, 0.0)],
        "grade_id bigint, station_id string, cruise string, event string, lon double, lat double",
    )
    got = {r["grade_id"]: (r["station"], r["method"]) for r in matrix.grades_at_stations(grades, stations, 2.0).collect()}
    assert got == {10: (2, "station_id"), 11: (2, "nearness"), 12: (3, "nearness"), 13: (None, "unmatched")}
    open_ = {r["grade_id"]: r["method"] for r in matrix.grades_at_stations(grades, stations, None).collect()}
    assert open_ == {10: "station_id", 11: "undecided", 12: "undecided", 13: "undecided"}


def test_cross_validation(spark):
    r = np.random.default_rng(1)
    rows = []
    for block in range(2):
        for k in range(40):
            lon, lat = block * 2 + r.uniform(0, 0.3), r.uniform(0, 0.3)
            rows.append((len(rows), lon, lat, float(math.sin(lon * 20) + math.cos(lat * 15)), block, k % 4))
    df = spark.createDataFrame(rows, "id bigint, lon double, lat double, y double, block int, part int")
    reg = runner.Registry().add("kriging", runner.kriging([0.0, 5, 10, 15, 20, 30, 40])).add("forest", runner.forest(["lon", "lat"], 10))
    with pytest.raises(ValueError, match="already"):
        reg.add("forest", runner.baseline)
    out = runner.cross_validate(df, {"blocks": runner.Design("block", True, 50.0), "random": runner.Design("part")}, reg)
    assert out.predictions.count() == 80 * 2 * 3 and out.refusals.count() == 0
    pooled = {(x["design"], x["estimator"]): x["rmse"] for x in out.pooled.collect()}
    assert pooled["random", "kriging"] < pooled["random", "baseline"]
    assert {x["design"] for x in out.claims.select("design").collect()} == {"blocks"}
    assert out.scores.count() == (2 + 4) * 3 * 6 and out.uplift.count() == (2 + 4) * 2
    with pytest.raises(ValueError, match="km from a test row"):
        runner.cross_validate(df, {"random": runner.Design("part", True, 50.0)}, reg)
    flat = runner.cross_validate(df.withColumn("y", F.when(F.col("block") == 0, 1.0).otherwise(F.col("y"))), {"blocks": runner.Design("block", True)}, runner.Registry().add("kriging", runner.kriging([0.0, 5, 10, 15, 20, 30, 40])))
    assert [tuple(x)[:4] for x in flat.refusals.collect()] == [("blocks", 1, "kriging", "the target is constant")]
