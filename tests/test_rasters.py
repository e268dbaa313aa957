"""Tiles written and read back, and what the reader refuses."""

from __future__ import annotations

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators.surfaces import Grid
from fathomline.sources import rasters


def test_a_tile_is_a_plain_geotiff():
    values = np.arange(256, dtype=np.float32).reshape(16, 16) / 3
    values[3, 4] = np.nan
    raw = rasters.encode(values, -125.5, 20.25, 0.01)
    got, west, north, step = rasters.decode(raw)
    assert np.array_equal(got, values, equal_nan=True) and (west, north, step) == (-125.5, 20.25, 0.01)
    f = rasters.fields_of(raw)
    assert f[rasters.TILE_WIDTH] == (16,) and f[rasters.NO_DATA] == b"nan\0" and f[rasters.GEO_KEYS][-1] == 4326
    with pytest.raises(ValueError, match="EPSG:4326"):
        rasters.decode(raw.replace(struct.pack("<4H", 2048, 0, 1, 4326), struct.pack("<4H", 2048, 0, 1, 3857)))
    with pytest.raises(ValueError, match="TIFF"):
        rasters.decode(b"MM\0*" + raw[4:])


def test_rasters_come_back_by_tiles(spark, tmp_path):
    cells = spark.range(3000).selectExpr("cast(id div 50 - 7 as int) as i", "cast(id % 50 - 20 as int) as j", "case when id % 97 <> 0 then id * 0.125 end as z")
    folder = f"file://{tmp_path}/depth"
    rasters.write_raster(cells, "z", Grid(-125.0, 20.0, 0.01), folder, "depth", side=16)
    got = rasters.read_raster(spark, folder)
    told = json.loads((tmp_path / "depth" / rasters.LISTING).read_text())
    assert got.rdd.getNumPartitions() == len(told["tiles"]) == 5 * 4
    want = {(r["i"], r["j"]): r["z"] for r in cells.filter("z is not null").collect()}
    assert {(r["i"], r["j"]): r["value"] for r in got.collect()} == want and sum(t["cells"] for t in told["tiles"]) == len(want)
    assert not [p for p in (tmp_path / "depth").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    _, west, north, _ = rasters.decode((tmp_path / "depth" / "depth-1-0.tif").read_bytes())
    assert (west, north) == (-125.0, pytest.approx(20.0 - 0.16))
    touched = tmp_path / "depth" / "depth-1-0.tif"
    touched.write_bytes(touched.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="depth-1-0.tif is not the file"):
        rasters.read_raster(spark, folder).collect()


def test_an_empty_raster(spark, tmp_path):
    none = spark.range(0).selectExpr("cast(id as int) as i", "cast(id as int) as j", "cast(id as double) as z")
    rasters.write_raster(none, "z", Grid(0.0, 0.0, 1.0), f"file://{tmp_path}/none", "z")
    assert rasters.read_raster(spark, f"file://{tmp_path}/none").collect() == []


def test_a_failed_write_leaves_no_raster(spark, tmp_path):
    cells = spark.range(100).selectExpr("cast(id as int) as i", "cast(0 as int) as j", "1.0 as z").withColumn("z", F.when(F.col("i") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="broken"):
        rasters.write_raster(cells, "z", Grid(0.0, 0.0, 1.0), f"file://{tmp_path}/bad", "z", side=16)
    assert not (tmp_path / "bad" / rasters.LISTING).exists()
