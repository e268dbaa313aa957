"""Manifests: canonical JSON, content hashes, chains of artifacts, and counters of a run."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.geodesy import covered
from fathomline.operators.geo import single_linkage
from fathomline.operators.ingest import eligible, non_commercial
from fathomline.operators.merge import dispositions
from fathomline.operators.pairs import distance_order
from fathomline.runtime import materialise


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def content_hash(artifact: dict[str, Any], without: tuple[str, ...] = ("content_sha256", "created_at", "path")) -> str:
    """Hash of an artifact's content: independent of key order, of when and of where it was written."""
    return hashlib.sha256(canonical({k: v for k, v in artifact.items() if k not in without}).encode()).hexdigest()


def sealed(kind: str, body: dict[str, Any], upstream: dict[str, str] | None = None) -> dict[str, Any]:
    made = {"kind": kind, **body, "upstream": dict(sorted((upstream or {}).items()))}
    return made | {"content_sha256": content_hash(made)}


def verify(artifact: dict[str, Any], upstream: dict[str, dict[str, Any]] | None = None) -> None:
    """Raises if an artifact or what it builds on is not what was recorded."""
    if content_hash(artifact) != artifact["content_sha256"]:
        raise ValueError(f"{artifact['kind']}: the content differs from its hash")
    for name, parent in (upstream or {}).items():
        if artifact["upstream"].get(name) != parent["content_sha256"]:
            raise ValueError(f"{artifact['kind']}: {name} is not the one it was made from")


#: Digits of kilometres and degrees in a manifest; halves go to the even one.
DIGITS = 4


def places_report(points: DataFrame, linkage_km: float, basis: str) -> DataFrame:
    """One row on where rows (with lon, lat) lie: distinct places, linked clusters, and least, median (at n // 2), greatest and widest
    missing stretch of their pairs' distances. ``basis`` says which rows these are. Pairs are made anew by each pass, never written."""
    places = materialise(points.filter("lon is not null and lat is not null").select("lon", "lat").distinct().withColumn("id", F.monotonically_increasing_id()), "places")
    clusters = single_linkage(places, linkage_km).agg(F.count_distinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("locations"))
    pairs = distance_order(places)
    told = clusters.join(F.broadcast(pairs), F.lit(True), "left")  # single rows
    rounded = [F.bround(c, DIGITS).alias(f"{c}_km") for c in ("least", "median", "most", "gap", "gap_from", "gap_to")]
    return told.select(F.lit(basis).alias("basis"), "locations", F.lit(float(linkage_km)).alias("linkage_km"), "clusters", F.coalesce("n", F.lit(0)).cast("bigint").alias("pairs"), *rounded)


def corpus_manifest(
    corpus: DataFrame, log: DataFrame | None = None, licences: DataFrame | None = None, ring: list[tuple[float, float]] | None = None, linkage_km: float | None = None,
) -> dict[str, Any]:
    """Counts by class, status and source, distinct places, the bounding box, dispositions, rows by licence of their source
    (source_id, licence; an unknown source counts as such), and rows inside a study area, from grouped aggregates.

    A log with sources tells what became of each, and which are wholly absorbed; with a linkage, where all rows and those that may train lie.
    """
    def by(column: str) -> dict[str, int]:
        return {str(r[0]): r[1] for r in sorted(corpus.groupBy(column).count().collect(), key=lambda r: str(r[0]))}

    box = corpus.agg(F.min("longitude"), F.max("longitude"), F.min("latitude"), F.max("latitude")).first()
    body: dict[str, Any] = {"rows": corpus.count(), "by_class": by("evidence_class"), "by_status": by("qa_status"), "by_source": by("source_id"), "bounding_box": list(box)}
    if log is not None:
        body["dispositions"] = {r[0]: r[1] for r in sorted(log.groupBy("disposition").count().collect())}
        if {"source_id", "displaced_source"} <= set(log.columns):
            told = {r["source_id"]: {k: r[k] for k in ("admitted", "absorbed", "already_present")} for r in dispositions(log).collect()}  # a row a source
            body["sources"] = dict(sorted(told.items()))
            body["absorbed_entirely"] = sorted(k for k, v in told.items() if not v["admitted"] and v["absorbed"] > 0)
    body["places"] = corpus.agg(F.count_distinct("longitude", "latitude")).first()[0]
    if licences is not None:
        told = corpus.join(licences.select(F.col("source_id").alias("_s"), "licence"), F.col("source_id") == F.col("_s"), "left").groupBy("licence").count().collect()
        body["by_licence"] = {str(r[0] or "unknown"): r[1] for r in sorted(told, key=lambda r: str(r[0]))}
        barred = licences.filter(non_commercial(F.col("licence"))).select("source_id")
        body["any_non_commercial"] = bool(corpus.join(barred, "source_id", "left_semi").head(1))
    if ring is not None:
        body["inside"] = corpus.filter(covered(F.col("longitude"), F.col("latitude"), ring)).count()
    if linkage_km is not None:
        at = corpus.withColumns({"lon": F.col("longitude"), "lat": F.col("latitude")})
        body["spatial"] = [places_report(rows, linkage_km, name).first().asDict() for name, rows in (("all rows", at), ("eligible rows", eligible(at)))]
    return sealed("corpus", body)


def write_manifest(spark: SparkSession, manifest: dict[str, Any], path: str) -> None:
    """One line of canonical JSON, in whatever store Spark writes."""
    spark.createDataFrame([(canonical(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """A manifest whose content is what its hash says."""
    made = json.loads(spark.read.text(path).first()["value"])
    verify(made)
    return made


def frame_hash(df: DataFrame) -> str:
    """Order-free content hash of a table: count and sum of row hashes, never its rows."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(f"{sorted(df.dtypes)}|{r['n']}|{r['h']}".encode()).hexdigest()


def canonical_row_hash(columns: list[str]):
    """sha256 of a row's canonical text, as a column."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)), 256)
