"""Contracts: recipes by version, target definitions, versions of contract files, and guards that refuse what drifts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import provenance


class Recipes:
    """Layer recipes by name; asking for another version or other parameters than were declared is refused."""

    def __init__(self):
        self._known: dict[str, tuple[str, dict[str, Any], Callable[..., DataFrame]]] = {}

    def add(self, name: str, version: str, make: Callable[..., DataFrame], **params: Any) -> Recipes:
        if name in self._known:
            raise ValueError(f"recipe {name} is declared twice")
        self._known[name] = version, params, make
        return self

    def get(self, name: str, version: str, **params: Any) -> Callable[[DataFrame], DataFrame]:
        if name not in self._known:
            raise ValueError(f"unknown recipe {name}; known: {', '.join(sorted(self._known))}")
        declared, fixed, make = self._known[name]
        if version != declared:
            raise ValueError(f"recipe {name} is version {declared}, not {version}")
        drift = sorted(k for k in {*fixed, *params} if fixed.get(k) != params.get(k, fixed.get(k)) or k not in fixed)
        if drift:
            raise ValueError(f"recipe {name}: parameters differ from the contract: {', '.join(drift)}")
        return lambda cells: make(cells, **fixed)

    def manifest(self) -> dict[str, Any]:
        return {name: {"version": v, "params": p} for name, (v, p, _) in sorted(self._known.items())}


def target_definition(contract: dict[str, Any], allowed: tuple[str, ...]) -> str | None:
    """The contract's target definition. No key is an error, null is a choice that was left open."""
    if "target_definition" not in contract:
        raise ValueError("the contract has no target definition")
    chosen = contract["target_definition"]
    if chosen is not None and chosen not in allowed:
        raise ValueError(f"target definition {chosen!r} is not one of {', '.join(allowed)}")
    return chosen


def contract_versions(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, sha256) of contract files; a file without a version line has null."""
    files = spark.read.format("binaryFile").load(path)
    version = F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^(?:contract_)?version:[ \t]*[\"']?([^\"'\s]+)", 1)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.nullif(version, F.lit("")).alias("version"), F.sha2("content", 256).alias("sha256"))


def single_dem(layers: list[dict[str, Any]], grid: dict[str, Any]) -> tuple[float, str]:
    """The one (resolution, dem_hash) that all layers and the grid agree on."""
    if not layers:
        raise ValueError("no layers")
    kinds = {(x["resolution"], x["dem_hash"]) for x in [*layers, grid]}
    if len(kinds) > 1:
        odd = sorted(x.get("name", "grid") for x in [*layers, grid] if (x["resolution"], x["dem_hash"]) != (grid["resolution"], grid["dem_hash"]))
        raise ValueError(f"layers of another elevation model than the grid's: {', '.join(odd)}")
    return kinds.pop()


def handoff(manifest: dict[str, Any], cells: DataFrame) -> DataFrame:
    """An elevation table, if its content is what the manifest says."""
    got = provenance.frame_hash(cells)
    if manifest.get("frame_sha256") != got:
        raise ValueError("the elevation table is not the one that was handed over")
    return cells


def inputs(needs: str, covariates: list[str], coordinates: tuple[str, str] = ("lon", "lat")) -> list[str]:
    """Columns an estimator is given, by what it declares to need."""
    if needs not in ("covariates", "coordinates", "nothing"):
        raise ValueError(f"an estimator needs covariates, coordinates or nothing, not {needs!r}")
    return {"covariates": list(covariates), "coordinates": list(coordinates), "nothing": []}[needs]


def coordinate_fingerprint(points: DataFrame, bucket: int = 4096) -> DataFrame:
    """One row (points, fingerprint): sha256 of points in order of id, by buckets of ids, then of the buckets' hashes.

    A bucket's points are one group of bounded size (ids are taken to be dense). Longitudes beyond 180 or
    latitudes beyond 90 degrees, as in a swapped pair, are an error.
    """
    fits = F.assert_true((F.abs("lon") <= 180) & (F.abs("lat") <= 90), F.lit("longitude and latitude are out of range or swapped"))
    text = F.concat_ws(",", F.col("id").cast("string"), *(F.format_string("%.9f", c) for c in ("lon", "lat")))
    own = points.select("id", text.alias("t"), fits.alias("ok")).filter(F.col("ok").isNull())
    ordered = lambda key, value: F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]))
    parts = own.groupBy(F.floor(F.col("id") / bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(ordered("id", "t"), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.sha2(ordered("b", "h"), 256).alias("fingerprint"))


def run_manifest(matrix: DataFrame, points: DataFrame, upstream: dict[str, dict[str, Any]], **body: Any) -> dict[str, Any]:
    """A sealed record of a run: hashes of its matrix and coordinates, and of what it builds on."""
    marks = {"matrix_sha256": provenance.frame_hash(matrix), "coordinates": coordinate_fingerprint(points).first()["fingerprint"]}
    return provenance.sealed("run", {**body, **marks}, {k: v["content_sha256"] for k, v in upstream.items()})


def verify_run(manifest: dict[str, Any], matrix: DataFrame, points: DataFrame, upstream: dict[str, dict[str, Any]]) -> None:
    """Raises if a run's own content, its matrix, coordinates or inputs are not those recorded."""
    provenance.verify(manifest, upstream)
    if provenance.frame_hash(matrix) != manifest["matrix_sha256"]:
        raise ValueError("run: the matrix is not the one it was made from")
    if coordinate_fingerprint(points).first()["fingerprint"] != manifest["coordinates"]:
        raise ValueError("run: the coordinates are not those it was made from")


def publishable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be published, rows withheld): only what is openly licensed goes out; unknown is not open."""
    is_open = F.coalesce(F.col("is_open"), F.lit(False))
    return rows.filter(is_open), rows.filter(~is_open)
