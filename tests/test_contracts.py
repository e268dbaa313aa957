"""Contracts, adapters and guards: what they take and what they refuse."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from fathomline.operators import contracts, geo, provenance, validation
from fathomline.sources import adapters


def test_recipes_refuse_what_drifts():
    known = contracts.Recipes().add("double", "1.2", lambda cells, by: cells * by, by=2)
    assert known.get("double", "1.2", by=2)(21) == 42 and known.get("double", "1.2")(1) == 2
    for name, version, params in (("triple", "1.2", {}), ("double", "1.3", {}), ("double", "1.2", {"by": 3}), ("double", "1.2", {"of": 1})):
        with pytest.raises(ValueError, match=r"recipe"):
            known.get(name, version, **params)
    with pytest.raises(ValueError, match="twice"):
        known.add("double", "2", lambda cells: cells)


def test_targets_models_and_inputs():
    assert contracts.target_definition({"target_definition": None}, ("a",)) is None
    assert contracts.target_definition({"target_definition": "a"}, ("a",)) == "a"
    for bad in ({}, {"target_definition": "b"}):
        with pytest.raises(ValueError, match="target definition"):
            contracts.target_definition(bad, ("a",))
    layer = {"name": "slope", "resolution": 0.1, "dem_hash": "x"}
    assert contracts.single_dem([layer], {"resolution": 0.1, "dem_hash": "x"}) == (0.1, "x")
    with pytest.raises(ValueError, match="slope"):
        contracts.single_dem([layer], {"resolution": 0.1, "dem_hash": "y"})
    assert contracts.inputs("covariates", ["z"]) == ["z"] and contracts.inputs("coordinates", ["z"]) == ["lon", "lat"]
    with pytest.raises(ValueError, match="needs"):
        contracts.inputs("wishes", [])


def test_versions_of_contract_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("name: x\nversion: '1.4'\n")
    (tmp_path / "b.yaml").write_text("name: y\n")
    got = {r["file"]: r for r in contracts.contract_versions(spark, str(tmp_path)).collect()}
    assert got["a.yaml"]["version"] == "1.4" and got["b.yaml"]["version"] is None
    assert got["b.yaml"]["sha256"] == hashlib.sha256(b"name: y\n").hexdigest()


def test_run_manifest(spark):
    points = spark.createDataFrame([(k, -120.0 + k / 7, 10.0 + k / 9) for k in range(20)], "id bigint, lon double, lat double")
    matrix = points.withColumn("y", F.col("lon") * 2)
    corpus = provenance.sealed("corpus", {"rows": 20})
    run = contracts.run_manifest(matrix, points, {"corpus": corpus}, seed=3)
    contracts.verify_run(run, matrix, points, {"corpus": corpus})
    moved = points.withColumn("lon", F.when(F.col("id") == 5, F.col("lon") + 1e-6).otherwise(F.col("lon")))
    for args in ((matrix.withColumn("y", F.lit(1.0)), points), (matrix, moved)):
        with pytest.raises(ValueError, match="run: the"):
            contracts.verify_run(run, *args, {"corpus": corpus})
    with pytest.raises(Exception, match="swapped"):
        contracts.coordinate_fingerprint(points.select("id", F.col("lat").alias("lon"), F.col("lon").alias("lat"))).collect()
    assert contracts.handoff({"frame_sha256": provenance.frame_hash(points)}, points) is points
    with pytest.raises(ValueError, match="handed"):
        contracts.handoff({"frame_sha256": "0"}, points)


def test_adapters_refuse(spark):
    rows = spark.createDataFrame([(1, 2.0, None, "n"), (2, None, 3.0, "m")], "k bigint, a double, b double, note string")
    got = adapters.adapt(lambda: rows, "s", "k", {"MASS": "a", "COUNT": "b"}, shared={"remark": "note"}, static={"gear": "grab"}, per_class={"COUNT": {"n": "b"}})
    want = [("n", "grab", "MASS", None, "s_mass_000001"), ("m", "grab", "COUNT", 3.0, "s_count_000002")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError, match="observation"):
        adapters.regional_grid(rows, "g", "k", "a", "observed")
    with pytest.raises(ValueError, match="twice"):
        adapters.adapt(rows, "s", "k", {"MASS": "a"}, shared={"n": "a"}, per_class={"MASS": {"n": "b"}})
    with pytest.raises(ValueError, match="not fanned out"):
        adapters.adapt(rows, "s", "k", {"MASS": "a"}, per_class={"COUNT": {"n": "b"}})


def test_folds_gaps_and_stability(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id bigint, cluster bigint")
    assert sorted(map(tuple, validation.linkage_folds(clusters, 2).collect())) == [(1, 2, 1), (3, 1, 2)]
    with pytest.raises(Exception, match="fewer than 3"):
        validation.linkage_folds(clusters, 3).collect()
    edges = spark.createDataFrame([(1.0,), (1.8,), (2.5,), (9.0,)], "km double")
    assert tuple(validation.stability_interval(edges, 2.0).first()) == (1.8, 2.5)
    values = spark.createDataFrame([(float(v),) for v in (5, 1, 2, 9, 14, 2)], "v double")
    assert tuple(geo.ordered_summary(values, "v").first()) == (6, 1.0, 5.0, 14.0, 5.0, 9.0, 14.0)
    assert geo.ordered_summary(values.limit(0), "v").count() == 0


def test_manifest_files_and_corpus(spark, tmp_path):
    rows = [("MASS", "pass", "s1", -120.5, 10.5), ("MASS", "pass", "s2", -120.5, 10.5), ("COUNT", "fail", "s3", -100.0, 50.0)]
    corpus = spark.createDataFrame(rows, "evidence_class string, qa_status string, source_id string, longitude double, latitude double")
    licences = spark.createDataFrame([("s1", "CC-BY"), ("s2", "CC-BY")], "source_id string, licence string")
    made = provenance.corpus_manifest(corpus, licences=licences, ring=[(-121, 10), (-120, 10), (-120, 11), (-121, 11), (-121, 10)])
    assert made["places"] == 2 and made["by_licence"] == {"CC-BY": 2, "unknown": 1} and made["inside"] == 2
    provenance.write_manifest(spark, made, f"{tmp_path}/m")
    assert provenance.read_manifest(spark, f"{tmp_path}/m") == made
    provenance.write_manifest(spark, made | {"inside": 3}, f"{tmp_path}/n")
    with pytest.raises(ValueError, match="differs"):
        provenance.read_manifest(spark, f"{tmp_path}/n")


def test_a_stored_corpus_keeps_the_rules(spark, tmp_path):
    from fathomline.sources import readers

    schema = "evidence_class string, abundance_kg_m2 double, source_id string, source_record_id string"
    rows = spark.createDataFrame([("MASS", 10.0, "src_a", "r1"), ("COVER", None, "src_a", "r2")], schema)
    readers.write_corpus(rows, f"{tmp_path}/good", rows.columns)
    assert {r["source_record_id"] for r in readers.read_corpus(spark, f"{tmp_path}/good", schema).collect()} == {"r1", "r2"}
    readers.write_corpus(rows.unionByName(spark.createDataFrame([("MASS", 1000.0, "src_a", "r3")], schema)), f"{tmp_path}/bad", rows.columns)
    with pytest.raises(Exception, match="abundance_kg_m2"):
        readers.read_corpus(spark, f"{tmp_path}/bad", schema).collect()
