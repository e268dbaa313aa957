"""Rasters as folders of float tiles: a Spark data source with a reader and a committing writer.

A raster is a mosaic: every tile of ``side`` x ``side`` cells is a file of its own, a plain GeoTIFF (one deflated tile of 32-bit floats,
EPSG:4326, nan for cells without a value), so any program reads it and no task needs another one's bytes. Tasks write under
temporary names; the commit renames them and writes ``provenance.json`` with the grid, the layer and every file's digest. Readers take a
partition a file from that list and check the digest, so a raster that was half written or touched since is refused by name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fathomline.operators.surfaces import Grid
from fathomline.runtime import ship

SIDE = 256
LISTING = "provenance.json"
#: Tags of the TIFF and GeoTIFF formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES = 256, 257, 258, 259, 262, 277
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
#: Codes of field types (ascii, short, long, double), of deflate, of floats and of EPSG:4326.
ASCII, SHORT, LONG, DOUBLE = 2, 3, 4, 12
DEFLATE, FLOAT, WGS84 = 8, 3, 4326
_KINDS = {ASCII: "s", SHORT: "H", LONG: "I", DOUBLE: "d"}


def encode(values: np.ndarray, west: float, north: float, step: float) -> bytes:
    """A square of 32-bit floats as a GeoTIFF of one tile."""
    side = len(values)
    body = zlib.compress(np.ascontiguousarray(values, "<f4").tobytes(), 6)
    keys = [1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, WGS84]
    fields = [
        (WIDTH, LONG, [side]), (LENGTH, LONG, [side]), (BITS, SHORT, [32]), (COMPRESSION, SHORT, [DEFLATE]), (PHOTOMETRIC, SHORT, [1]), (SAMPLES, SHORT, [1]),
        (TILE_WIDTH, LONG, [side]), (TILE_LENGTH, LONG, [side]), (TILE_OFFSETS, LONG, [8]), (TILE_BYTES, LONG, [len(body)]), (SAMPLE_FORMAT, SHORT, [FLOAT]),
        (PIXEL_SCALE, DOUBLE, [step, step, 0.0]), (TIE_POINT, DOUBLE, [0.0, 0.0, 0.0, west, north, 0.0]), (GEO_KEYS, SHORT, keys), (NO_DATA, ASCII, b"nan\0"),
    ]
    at = 8 + len(body) + len(body) % 2
    far = at + 2 + 12 * len(fields) + 4
    entries, tail = b"", b""
    for tag, kind, value in fields:
        raw = value if kind == ASCII else struct.pack(f"<{len(value)}{_KINDS[kind]}", *value)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(value), far + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, len(value)) + raw.ljust(4, b"\0")
    head = struct.pack("<2sHI", b"II", 42, at)
    return head + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + tail


def fields_of(raw: bytes) -> dict[int, tuple | bytes]:
    """Tags of a little-endian TIFF's first directory."""
    if raw[:4] != b"II*\0":
        raise ValueError("no little-endian TIFF")
    at = struct.unpack_from("<I", raw, 4)[0]
    out = {}
    for k in range(struct.unpack_from("<H", raw, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", raw, at + 2 + 12 * k)
        if kind not in _KINDS:
            continue
        width = n * struct.calcsize(_KINDS[kind])
        place = at + 10 + 12 * k if width <= 4 else struct.unpack_from("<I", raw, at + 10 + 12 * k)[0]
        out[tag] = raw[place : place + n] if kind == ASCII else struct.unpack_from(f"<{n}{_KINDS[kind]}", raw, place)
    return out


def decode(raw: bytes) -> tuple[np.ndarray, float, float, float]:
    """(values, west, north, step) of a tile; a raster on other coordinates, or not of deflated floats, is refused."""
    f = fields_of(raw)
    keys = f.get(GEO_KEYS, ())
    systems = [keys[k + 3] for k in range(4, len(keys), 4) if keys[k] == 2048]
    if systems != [WGS84]:
        raise ValueError(f"coordinates are not EPSG:{WGS84}")
    if f[BITS] != (32,) or f.get(SAMPLE_FORMAT) != (FLOAT,) or f[COMPRESSION] != (DEFLATE,) or len(f[TILE_OFFSETS]) != 1:
        raise ValueError("not one deflated tile of 32-bit floats")
    body = raw[f[TILE_OFFSETS][0] : f[TILE_OFFSETS][0] + f[TILE_BYTES][0]]
    values = np.frombuffer(zlib.decompress(body), "<f4").reshape(f[TILE_LENGTH][0], f[TILE_WIDTH][0])[: f[LENGTH][0], : f[WIDTH][0]]
    return values, f[TIE_POINT][3], f[TIE_POINT][4], f[PIXEL_SCALE][0]


@dataclass
class _Tile(InputPartition):
    row: int
    column: int
    name: str
    sha256: str


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return where, path.rstrip("/")


class FloatTiles(DataSource):
    """Format ``float_tiles``: rows (i, j, value). Options: path; to write also layer, west, north, step and side."""

    @classmethod
    def name(cls) -> str:
        return "float_tiles"

    def schema(self) -> str:
        return "i int, j int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]

    def partitions(self) -> list[_Tile]:
        where, path = _at(self.folder)
        with where.open_input_stream(f"{path}/{LISTING}") as f:
            told = json.loads(f.read())
        return [_Tile(t["row"], t["column"], t["name"], t["sha256"]) for t in told["tiles"]]

    def read(self, partition: _Tile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a mosaic without tiles
            return
        where, path = _at(self.folder)
        with where.open_input_stream(f"{path}/{partition.name}") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} is not the file that was written")
        values = decode(raw)[0]
        i, j = np.nonzero(~np.isnan(values))
        side = len(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array((i + partition.row * side).astype(np.int32)), pa.array((j + partition.column * side).astype(np.int32)), pa.array(values[i, j].astype(np.float64))], names=["i", "j", "value"]
        )


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.layer, self.overwrite = options["path"], options["layer"], overwrite
        self.grid, self.side = Grid(*(float(options[k]) for k in ("west", "north", "step"))), int(options["side"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Tiles of a task, one after the other: rows come ordered by tile."""
        from pyspark import TaskContext

        where, path = _at(self.folder)
        where.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        files, now, values = [], None, None

        def close() -> None:
            name = f"{self.layer}-{now[0]}-{now[1]}.tif"
            west, north = self.grid.west + now[1] * self.side * self.grid.step, self.grid.north - now[0] * self.side * self.grid.step
            raw = encode(values, west, north, self.grid.step)
            with where.open_output_stream(f"{path}/.{name}.{attempt}") as f:
                f.write(raw)
            files.append({"row": now[0], "column": now[1], "name": name, "from": f".{name}.{attempt}", "sha256": hashlib.sha256(raw).hexdigest(), "cells": int((~np.isnan(values)).sum())})

        for batch in iterator:
            i, j, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "value"))
            tiles = np.stack([i // self.side, j // self.side], axis=1).astype(int)
            cut = np.flatnonzero((tiles[1:] != tiles[:-1]).any(1)) + 1 if len(tiles) else []
            for part in np.split(np.arange(len(i)), cut) if len(i) else []:
                tile = tuple(tiles[part[0]].tolist())
                if tile != now:
                    if now is not None:
                        close()
                    now, values = tile, np.full((self.side, self.side), np.nan, np.float32)
                values[i[part] % self.side, j[part] % self.side] = v[part].astype(np.float32)
        if now is not None:
            close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, path = _at(self.folder)
        where.create_dir(path, recursive=True)
        tiles = sorted((t for m in messages if m is not None for t in m.files), key=lambda t: (t["row"], t["column"]))
        for t in tiles:
            where.move(f"{path}/{t['from']}", f"{path}/{t['name']}")
        told = {
            "layer": self.layer, "west": self.grid.west, "north": self.grid.north, "step": self.grid.step, "side": self.side,
            "tiles": [{k: v for k, v in t.items() if k != "from"} for t in tiles],
        }
        with where.open_output_stream(f"{path}/.{LISTING}") as f:
            f.write(json.dumps(told, sort_keys=True, indent=1).encode())
        where.move(f"{path}/.{LISTING}", f"{path}/{LISTING}")

    def abort(self, messages: list[_Written | None]) -> None:
        where, path = _at(self.folder)
        for t in (t for m in messages if m is not None for t in m.files):
            if where.get_file_info(f"{path}/{t['from']}").type != fs.FileType.NotFound:
                where.delete_file(f"{path}/{t['from']}")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FloatTiles)


def write_raster(cells: DataFrame, value: str, grid: Grid, folder: str, layer: str, side: int = SIDE) -> None:
    """Writes (i, j, value) as a mosaic; a tile's cells meet in one task, which holds one tile at a time. Cells without a value are not stored."""
    register(cells.sparkSession)
    some = cells.filter(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("value"))
    tile = [F.floor(F.col(c) / side) for c in ("i", "j")]
    laid = some.repartition(*tile).sortWithinPartitions(*tile)
    told = {"path": folder, "layer": layer, "west": grid.west, "north": grid.north, "step": grid.step, "side": side}
    laid.write.format("float_tiles").options(**{k: repr(v) if isinstance(v, float) else str(v) for k, v in told.items()}).mode("append").save()


def read_raster(spark: SparkSession, folder: str) -> DataFrame:
    """(i, j, value) of a mosaic, a partition a tile."""
    register(spark)
    return spark.read.format("float_tiles").option("path", folder).load()
