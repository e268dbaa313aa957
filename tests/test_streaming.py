"""Micro-batches merge once, however often they are offered."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.streaming.incremental import CorpusTable, ingest_stream

COLUMNS = (
    "seq bigint, source_record_id string, source_id string, evidence_class string, longitude double, latitude double,"
    " abundance_value_original double, abundance_unit_original string, nodule_mass_kg double, sampled_area_m2 double,"
    " nodule_density_m2 double, mean_nodule_mass_g double, abundance_kg_m2 double, abundance_basis string, derivation_formula string,"
    " observation_or_prediction string, quality_grade string, qa_status string, duplicate_group_id string, notes string"
)


def test_stream_into_corpus(spark, tmp_path):
    def row(k, lon, value):
        return (k, f"r{k}", "src_a", "MASS", lon, 0.0, value, "kg_m2", None, None, None, None, None, None, None, "observed", None, "pending", None, None)

    first = spark.createDataFrame([row(0, 0.0, 3.0), row(1, 1.0, 50.0), row(2, 2.0, 300.0)], COLUMNS)
    first.coalesce(1).write.parquet(f"{tmp_path}/in")
    table = CorpusTable(f"{tmp_path}/corpus", spark.createDataFrame([], COLUMNS))
    stream = lambda: spark.readStream.schema(first.schema).parquet(f"{tmp_path}/in")
    bands = {"longitude": 0.001, "latitude": 0.001}
    ingest_stream(stream(), table, f"{tmp_path}/cp", bands).awaitTermination()
    got = {r["source_record_id"]: r for r in table.before(99).collect()}
    assert set(got) == {"r0", "r1"} and got["r1"]["qa_status"] == "flagged"  # 300 is refused, 50 is flagged
    assert [(r["source_record_id"], r["version"], len(r["violations"]) > 0) for r in table.refused().collect()] == [("r2", 0, True)]
    first.withColumn("longitude", F.col("longitude") + 0.0005).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest_stream(stream(), table, f"{tmp_path}/cp", bands).awaitTermination()
    assert table.before(99).count() == 2
    assert sorted(r["version"] for r in table.refused().collect() if r["source_record_id"] == "r2") == [0, 1]
    assert table.refused(1).count() == 1 and table.refused(7).count() == 0


def test_versions_hold_what_changed_and_old_ones_go(spark, tmp_path):
    """Six batches, a whole state every other one: any state can be read until it is let go, and a batch may be tried again."""
    def row(k, lon, grade, value):
        return (k, f"r{k}-{round(lon * 1e4)}", "src_a", "MASS", lon, 0.0, value, "kg_m2", None, None, None, None, None, None, None, "observed", grade, "pending", None, None)

    table = CorpusTable(f"file://{tmp_path}/corpus", spark.createDataFrame([], COLUMNS), every=2)
    bands = {"longitude": 0.001, "latitude": 0.001}
    batches = [[row(0, 0.1 * v, "C", 1.0 + v), row(1, 0.0004, "A" if v == 3 else "C", 5.0 + v)] for v in range(6)]
    states = []
    for v, rows in enumerate(batches):
        for _ in range(2 if v in (1, 4) else 1):
            table.merge(spark.createDataFrame(rows, COLUMNS), v, bands, [])
        states.append({r["seq"]: r["source_record_id"] for r in table.before(v + 1).collect()})
    assert [len(x) for x in states] == [2, 3, 4, 5, 6, 7]
    assert list(states[-1].values()).count("r1-4") == 2 and "r0-4000" in states[-1].values()  # the better record took the first slot
    assert table._versions("whole") == [3, 5] and table._versions("changed") == [4, 5]
    assert {r["seq"]: r["source_record_id"] for r in table.before(5).collect()} == states[4]
    assert spark.read.parquet(table._path(4)).count() <= 3  # only what the batch touched
