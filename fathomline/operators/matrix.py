"""Covariates at stations, the training matrix, and the join of grades to stations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.geo import cell_of, near_join
from fathomline.operators.provenance import frame_hash, sealed

#: Names that a refusal lists.
LISTED = 10


def _refuse(rows: DataFrame, column: str, what: str) -> None:
    named = [str(r[0]) for r in rows.select(column).orderBy(column).limit(LISTED + 1).collect()]
    if named:
        raise ValueError(f"{what}: {', '.join(named[:LISTED])}{' ...' if len(named) > LISTED else ''}")


def extract(stations: DataFrame, layers: DataFrame, west: float, north: float, resolution: float) -> DataFrame:
    """Layers of the cell that contains each station (id, lon, lat, ...); refuses stations off the grid or named twice."""
    _refuse(stations.groupBy("id").count().filter("count > 1"), "id", "stations named more than once")
    row, column = cell_of(F.col("lon"), F.col("lat"), west, north, resolution)
    placed = stations.withColumns({"i": row, "j": column})
    _refuse(placed.join(layers.select("i", "j"), ["i", "j"], "left_anti"), "id", "stations off the grid")
    return placed.join(layers, ["i", "j"])


def assemble(extracted: DataFrame, covariates: list[str], target: str, expected: int | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """(id, lon, lat, y, covariates...) in order of id, and its manifest; any missing value refuses the matrix."""
    matrix = extracted.select("id", "lon", "lat", F.col(target).alias("y"), *covariates)
    columns = ["y", *covariates]
    got = matrix.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in columns)).first()
    holes = {c: got[c] for c in columns if got[c]}
    if holes:
        raise ValueError(f"missing values: {holes}")
    if expected is not None and got["n"] != expected:
        raise ValueError(f"{got['n']} rows; the manifest has {expected}")
    body = {"rows": got["n"], "covariates": covariates, "target": target, "table_sha256": frame_hash(matrix)}
    return matrix.orderBy("id"), sealed("training_matrix", body)


def grades_at_stations(grades: DataFrame, stations: DataFrame, tolerance_km: float | None) -> DataFrame:
    """(grade_id, station, method): by station id first, the rest by cruise, event and nearness.

    Without a tolerance the second way is not decided, and the rest stays without a station. The
    nearest station within the tolerance wins, the smaller id among equals.
    """
    named = grades.join(stations.select(F.col("id").alias("station"), F.col("station_id").alias("_s")), F.col("station_id") == F.col("_s"))
    named = named.groupBy("grade_id").agg(F.min("station").alias("station")).withColumn("method", F.lit("station_id"))
    rest = grades.join(named.select("grade_id"), "grade_id", "left_anti")
    if tolerance_km is None:
        return named.unionByName(rest.select("grade_id", F.lit(None).cast("bigint").alias("station"), F.lit("undecided").alias("method")))
    met = near_join(rest.select("grade_id", "cruise", "event", "lon", "lat"), stations.select("id", "cruise", "event", "lon", "lat"), tolerance_km, ["cruise", "event"])
    near = met.groupBy(F.col("l_grade_id").alias("grade_id")).agg(F.min_by("r_id", F.struct("km", "r_id")).alias("station"))
    found = rest.select("grade_id").join(near, "grade_id", "left")
    return named.unionByName(found.select("grade_id", "station", F.when(F.col("station").isNull(), F.lit("unmatched")).otherwise(F.lit("nearness")).alias("method")))
