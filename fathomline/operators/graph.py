"""Connected components over an edge table, by alternating star contraction.

Each round hangs every neighbour of a vertex on the smallest vertex it sees, so the forest
flattens in O(log n) rounds whatever the diameter. A round is joins and partial aggregates
only: a hub's edges are pre-aggregated before they are shuffled, and the join on a hub is an
ordinary equi-join that adaptive execution may split. At most ``SMALL`` edges are settled in one task:
the count is known before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import materialise, ship

SMALL = 4096


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    moved = down.join(low, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest vertex of every component, for all edges at once."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Vertices of ``edges`` that are not their component's smallest, as (id, component).

    Ids must be orderable and not null; self loops and repeated edges are ignored. A vertex
    absent from the result is its own component. Every round is written to the shared folder.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "cc")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark["n"] == 0 or mark == seen:
            break
        if seen is None and mark["n"] <= SMALL and all(t == "bigint" for _, t in now.dtypes):
            ship(now.sparkSession)
            return materialise(now.coalesce(1).mapInArrow(_settle, "id bigint, component bigint"), "cc")
        seen = mark
        now = materialise(_small_star(_large_star(now)), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
