"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated to the principal axes of all rows' second moments, so
most of a product lies in its first dimensions. Only vectors of one label are compared. A label's
vectors are cut into cells along the first axis, each as wide as two vectors at the threshold can
lie apart, so links join one cell or two neighbours; cells are split by hash into tiles of bounded
size, and each pair of tiles is one group. Inside, products accumulate over blocks of dimensions;
after each block the rest is bounded by the product of both suffix norms, and a pair is given up as
soon as its cosine cannot reach the threshold. Pairs that survive are confirmed by the cosine of
the unrotated vectors in double precision.

Equal vectors of a label are collapsed first and counted. A group returns, for each of its
vectors, the number of links and one edge to each linked set's first member, never its pairs.

Edge cases. A null label, a null or zero vector, one that holds nulls or non-finite numbers: links with
nothing. Vectors of different lengths link with nothing either; each length has axes and a plan of its own.
Null id: no links, component null. Every row is a vector: rows that repeat an id are told apart, and each
has the links and component of its own vector. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.operators.graph import components
from fathomline.runtime import materialise, ship

TILE = 4096
#: Rows of a tile that are compared at once.
BLOCK = 1024
LEAD = 12
SLACK = 1e-9


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column("vec"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "v"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors as rows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=True).reshape(-1, dim)
    if not len(x):
        return x
    x /= np.abs(x).max(1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(axes, width: float, dim: int):
    """Adds each vector's cell along the first axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = axes.value[:, 0]
        for batch in batches:
            cell = np.floor(_matrix(batch.column("vec"), dim) @ first / width).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def linked(u: np.ndarray, v: np.ndarray, axes: np.ndarray, threshold: float, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of u, j of v) of unit rows with cosine at or above the threshold, each once."""
    a, b = u @ axes, v @ axes
    dim = a.shape[1]
    partial = a[:, :lead] @ b[:, :lead].T
    rest = np.sqrt(np.maximum(0, 1 - (a[:, :lead] ** 2).sum(1)))[:, None] * np.sqrt(np.maximum(0, 1 - (b[:, :lead] ** 2).sum(1)))
    i, j = np.nonzero(partial + rest >= threshold - SLACK)
    value = partial[i, j]
    at = lead
    while at < dim and len(i):
        to = min(dim, at + 16)
        sum_ = np.empty(len(i))
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            sum_[part] = np.einsum("nd,nd->n", a[i[part], at:to], b[j[part], at:to])
        value = value + sum_
        tail_a, tail_b = np.linalg.norm(a[:, to:], axis=1), np.linalg.norm(b[:, to:], axis=1)
        live = value + tail_a[i] * tail_b[j] >= threshold - SLACK
        i, j, value = i[live], j[live], value[live]
        at = to
    keep = np.ones(len(i), bool)
    for k in range(0, len(i), 1 << 16):
        part = slice(k, k + (1 << 16))
        keep[part] = np.einsum("nd,nd->n", u[i[part]], v[j[part]]) >= threshold
    return i[keep], j[keep]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest members of the sets of ``label`` once members ``a`` and ``b`` are joined."""
    a, b = label[a], label[b]
    apart = a != b
    if not apart.any():
        return label
    a, b = np.divmod(np.unique(a[apart] * len(label) + b[apart]), len(label))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(axes, threshold: float, dim: int):
    """Links and first members of a pair of tiles, block by block: pairs of one block are all that is held at a time."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")  # a set's first member is then its smallest index
        ids, times = table.column("cid").to_numpy(), table.column("times").to_numpy()
        side = table.column("side").to_numpy()
        x = _matrix(table.column("vec").combine_chunks(), dim)
        one = not side.any()
        left = np.flatnonzero(side == 0)
        right = left if one else np.flatnonzero(side == 1)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(left), BLOCK):
            for b in range(a if one else 0, len(right), BLOCK):
                p, q = left[a : a + BLOCK], right[b : b + BLOCK]
                i, j = linked(x[p], x[q], axes.value, threshold)
                i, j = p[i], q[j]
                if one and a == b:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, times[j])
                np.add.at(links, j, times[i])
                label = _joined(label, i, j)
        some = np.flatnonzero(links)
        return pa.table({"cid": pa.array(ids[some]), "links": pa.array(links[some]), "root": pa.array(ids[label[some]])})

    return run


def _met(classes: DataFrame, dim: int, threshold: float, tile: int) -> DataFrame:
    """(cid, links, root) of the classes of vectors of one length, by tile pair."""
    spark = classes.sparkSession
    classes = classes.filter(F.size("vec") == dim).select("label", "cid", "times", "vec")
    cells = classes.mapInArrow(_moments(dim), "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    moment = np.zeros(dim * dim)  # dim x dim whatever the number of rows
    moment[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    axes = spark.sparkContext.broadcast(np.linalg.eigh(moment.reshape(dim, dim))[1][:, ::-1].copy())
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    placed = materialise(classes.mapInArrow(_project(axes, width, dim), T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType())])), "embed-cells")
    sizes = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    after = sizes.select("label", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("after"))
    before = sizes.select("label", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("before"))
    around = sizes.join(after, ["label", "cell"], "left").join(before, ["label", "cell"], "left")
    home = placed.join(around, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(3)), "tiles").cast("int"))

    def to(cell, other, side) -> F.Column:
        """One group of a tile pair; side 0 is the lower tile."""
        low, high = F.when(side == 0, F.col("own")).otherwise(other), F.when(side == 0, other).otherwise(F.col("own"))
        return F.struct(cell.cast("int").alias("c"), low.alias("bi"), high.alias("bj"), side.alias("side"))

    zero, one = F.lit(0), F.lit(1)
    steps = lambda n: F.sequence(zero, F.coalesce(n, zero) - 1, F.lit(1))
    some = lambda n, f: F.when(F.coalesce(n, zero) > 0, F.transform(steps(F.greatest(F.coalesce(n, zero), one)), f)).otherwise(F.array())
    inner = F.transform(
        steps(F.col("tiles")), lambda o: to(F.col("cell") * 2, o, F.when(F.col("own") > o, one).otherwise(zero))
    )
    upper = some(F.col("after"), lambda o: to(F.col("cell") * 2 + 1, o, zero))
    lower = some(F.col("before"), lambda o: to(F.col("cell") * 2 - 1, o, one))
    dealt = home.withColumn("g", F.explode(F.concat(inner, upper, lower))).select("label", "cid", "times", "vec", "g.*")
    return dealt.groupBy("label", "c", "bi", "bj").applyInArrow(_compare(axes, threshold, dim), "cid bigint, links bigint, root bigint")


def near_duplicates(rows: DataFrame, *, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    spark = rows.sparkSession
    ship(spark)
    vec = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"), F.col("label").alias("label"))
    top = float(np.finfo(np.float64).max)
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= top))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    usable = F.coalesce(usable & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number; adding 0.0 makes them one key
    own = own.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    code = F.sha2(F.concat_ws(",", F.transform("vec", lambda x: F.hex(x.cast("string").cast("binary")))), 256)
    keyed = own.withColumn("code", F.when(usable, code))
    classes = keyed.filter(F.col("code").isNotNull()).groupBy("label", "code").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.any_value("vec").alias("vec")
    )
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    # a plan for every length of vectors; tables have one or few
    met = spark.createDataFrame([], "cid bigint, links bigint, root bigint")
    for r in classes.select(F.size("vec").alias("dim")).distinct().orderBy("dim").collect():
        met = met.unionAll(_met(classes, r["dim"], threshold, tile))
    met = materialise(met, "embed-links")
    label = components(met, "cid", "root").select(F.col("id").alias("cid"), "component")
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    linked_classes = materialise(
        classes.select("label", "code", "cid", "rep", "times").join(counts, "cid", "left").join(label, "cid", "left")
        .withColumn("component", F.coalesce("component", "cid")), "embed-components",
    )
    least = linked_classes.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = linked_classes.join(least, "component").select(
        "label", "code", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("bigint").alias("n_links"), "component_id"
    )
    found = keyed.filter(F.col("code").isNotNull()).select("vec_id", "label", "code").join(known, ["label", "code"])
    odd = keyed.filter(F.col("code").isNull())
    odd = odd.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.select("vec_id", "n_links", "component_id").unionAll(odd).withColumn("kept", F.col("vec_id") == F.col("component_id"))
