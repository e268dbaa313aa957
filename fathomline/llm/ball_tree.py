"""Exact k-means on whole-number vectors, by filtering over partition-local ball trees.

Every partition lays its vectors out in blocks of bounded size and builds a tree over each: a node is a ball with a whole-number
centre, a radius, a count and an integer sum. The trees are written once. A round sends the centroids down all trees: a
centroid stays with a ball only while the triangle inequality lets it be nearest to one of its points; a ball left with one
centroid is assigned whole, by its count and sum, and only leaves that several centroids may share compute distances, in
whole numbers. A task returns counts and sums by centroid, so a round shuffles centroids times dimensions a task.

Sums, divisions and comparisons are exact: distances stay below 2^53 while components stay below ``NARROW``; blocks with
larger ones, and centroids that have them, are compared in Python's integers without a tree.

Edge cases. Vectors that are null, of another length, or hold nulls or non-finite numbers are left out; so are those with a
component that a long cannot hold. Null id: clustered, never a starting centroid. Rows that repeat an id or a vector are
vectors of their own. Ties go to the smaller centroid, equal starting hashes to the smaller vector. Fewer vectors than centroids:
as many centroids as vectors. A distance or sum beyond a long is null. No vectors: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import materialise, ship

BLOCK = 4096
LEAF = 32
#: Components below this keep sums of squares exact in double precision.
NARROW = 1 << 22

_TREE = "ids array<bigint>, points binary, stop binary, start binary, child binary, radius binary, sums binary"


class Tree:
    """A ball tree over the rows of ``points`` (which it reorders), or one node without a ball where numbers are large."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.narrow = bool(len(points)) and int(points.max()) < NARROW and int(points.min()) > -NARROW
        self.start, self.stop, self.child, self.radius, self.sums = [], [], [], [], []
        if self.narrow:
            x = points.astype(np.float64)
            queue = [(0, len(x))]
            for a, b in queue:  # nodes in order of breadth: a node's children lie side by side
                own = x[self.order[a:b]]
                total = points[self.order[a:b]].sum(0)
                centre = (total // (b - a)).astype(np.float64)
                far = ((own - centre) ** 2).sum(1)
                self.start.append(a), self.stop.append(b), self.radius.append(np.sqrt(far.max())), self.sums.append(total)
                if b - a <= leaf or far.max() == 0:
                    self.child.append(-1)
                    continue
                one = own[far.argmax()]
                two = own[((own - one) ** 2).sum(1).argmax()]
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own @ (two - one), half)]
                self.child.append(len(queue))
                queue += [(a, a + half), (a + half, b)]
        self.points = points[self.order]

    def row(self, ids: pa.Array) -> list:
        """The tree as one row of ``_TREE``."""
        kind = np.int32 if self.narrow else np.int64
        raw = [self.points.astype(kind), *(np.array(v, np.int32) for v in (self.stop, self.start, self.child)), np.array(self.radius), np.array(self.sums, np.int64)]
        return [ids.take(pa.array(self.order)), *(v.tobytes() for v in raw)]


class Stored:
    """A tree read back from its row."""

    def __init__(self, row: dict, dim: int):
        self.start, self.stop, self.child = (np.frombuffer(row[c].as_py(), np.int32) for c in ("start", "stop", "child"))
        self.narrow = len(self.start) > 0
        self.points = np.frombuffer(row["points"].as_py(), np.int32 if self.narrow else np.int64).reshape(-1, dim).astype(np.int64)
        self.radius = np.frombuffer(row["radius"].as_py(), np.float64)
        self.sums = np.frombuffer(row["sums"].as_py(), np.int64).reshape(-1, dim)
        self.ids = row["ids"].values


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, exact for narrow whole numbers in double precision."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _wide(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) in Python's integers."""
    x = points.astype(object)
    best, near = np.zeros(len(x), np.int64), None
    for k, c in enumerate(centroids):
        d = ((x - np.array(c, object)) ** 2).sum(1)
        if near is None:
            near = d
        else:
            closer = (d < near).astype(bool)
            best[closer], near = k, np.where(closer, d, near)
    return best, near


def descend(tree: Stored, centroids: list[list[int]]):
    """(nodes that have one centroid, that centroid, points of the shared leaves, their centroid, their squared distance)."""
    if not tree.narrow or any(abs(v) >= NARROW for c in centroids for v in c):
        best, near = _wide(tree.points, centroids)
        none = np.zeros(0, np.int64)
        return none, none, np.arange(len(tree.points)), best, near
    c = np.array(centroids, np.float64)
    centre = (tree.sums // (tree.stop - tree.start)[:, None]).astype(np.float64)
    whole, owner, leaves, live = [], [], [], []
    nodes, mask = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    while len(nodes):
        square = np.where(mask, squares(centre[nodes], c), np.inf)
        d, r = np.sqrt(square), tree.radius[nodes]
        best = d.min(1)
        # a centroid farther from the centre than the nearest one by more than the ball's width is nearest to no point of it
        mask = d <= ((best + 2 * r) * (1 + 1e-9) + 1e-9)[:, None]
        done = (mask.sum(1) == 1) | (r == 0)
        whole.append(nodes[done]), owner.append(square[done].argmin(1))
        leaf = ~done & (tree.child[nodes] < 0)
        leaves.append(nodes[leaf]), live.append(mask[leaf])
        down = ~done & ~leaf
        first = tree.child[nodes[down]].astype(np.int64)
        nodes, mask = np.concatenate([first, first + 1]), np.concatenate([mask[down]] * 2)
    leaves, live = np.concatenate(leaves), np.concatenate(live)
    size = (tree.stop - tree.start)[leaves].astype(np.int64)
    at = np.repeat(tree.start[leaves] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    near = np.where(np.repeat(live, size, axis=0), squares(tree.points[at].astype(np.float64), c), np.inf)
    best = near.argmin(1) if len(near) else np.zeros(0, np.int64)
    return np.concatenate(whole), np.concatenate(owner), at, best, near[np.arange(len(best)), best].astype(np.int64)


def _plant(dim: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            row = Tree(points).row(table.column("vec_id").combine_chunks())
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if k == 0 else v], kinds[k]) for k, v in enumerate(row)], names=[c.split()[0] for c in _TREE.split(", ")])

        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                if n + part.num_rows > block and n:
                    yield made()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield made()

    return run


def _rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Stored]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Stored({c: batch.column(c)[k] for c in batch.schema.names}, dim)


def _round(shared, dim: int):
    """Counts and sums by centroid, as text: (cluster, at, total), where ``at`` -1 is the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        totals = [[0] * (dim + 1) for _ in centroids]
        for tree in _rows(batches, dim):
            node, own, at, best, _ = descend(tree, centroids)
            points = tree.points if tree.narrow else tree.points.astype(object)
            for k in np.union1d(own, best).tolist():
                mine, loose = node[own == k], at[best == k]
                sums = tree.sums[mine].sum(0).astype(object) + points[loose].sum(0)
                count = int((tree.stop - tree.start)[mine].sum()) + len(loose)
                totals[k] = [a + int(b) for a, b in zip(totals[k], [count, *sums], strict=True)]
        some = [k for k, t in enumerate(totals) if t[0]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(some, dim + 1).astype(np.int32)), pa.array(np.tile(np.arange(-1, dim, dtype=np.int32), len(some))),
                pa.array([str(v) for k in some for v in totals[k]], pa.string()),
            ], names=["cluster", "at", "total"],
        )

    return run


def _assign(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for tree in _rows(batches, dim):
            node, own, at, best, near = descend(tree, centroids)
            n = len(tree.points)
            cluster, distance = np.zeros(n, np.int32), np.zeros(n, object)
            cluster[at], distance[at] = best, near
            for k, c in zip(node.tolist(), own.tolist(), strict=True):
                a, b = tree.start[k], tree.stop[k]
                cluster[a:b], distance[a:b] = c, ((tree.points[a:b] - np.array(centroids[c])) ** 2).sum(1)
            fits = [int(v) if v < 1 << 63 else None for v in distance]
            yield pa.RecordBatch.from_arrays([tree.ids, pa.array(cluster), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def clusters(
    rows: DataFrame, *, centroids: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2", block: int = BLOCK
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable row of (vec_id, embedding)."""
    spark = rows.sparkSession
    ship(spark)
    vec = F.col("embedding").cast("array<double>")
    own = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("x"))
    fits = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float((1 << 63) // scale)))
    kept = own.filter(F.coalesce((F.size("x") == dim) & fits, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))
    trees = materialise(kept.mapInArrow(_plant(dim, block), _TREE), "ball-trees")
    start = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").select(start.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()
    now = [list(r["v"]) for r in first]  # at most ``centroids`` rows
    empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not now:
        return spark.createDataFrame([], empty)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(now)
        sums = trees.mapInArrow(_round(shared, dim), "cluster int, at int, total string").groupBy("cluster", "at").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
        )
        got: dict[int, dict[int, int]] = {}
        for r in sums.collect():  # centroids times dimensions
            got.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
        now = [[got[k][d] // got[k][-1] for d in range(dim)] if k in got else c for k, c in enumerate(now)]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(now)
    assigned = materialise(trees.mapInArrow(_assign(shared, dim), "vec_id bigint, cluster int, distance bigint"), "ball-assigned")
    digest = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(now)], "cluster int, centroid_sha256 string")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    by_cluster = assigned.groupBy("cluster").agg(total.alias("part"))
    whole = by_cluster.agg(F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("whole"))
    # one row a centroid
    told = by_cluster.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(digest), "cluster").select(
        "cluster", F.expr("try_cast(part as bigint)").alias("cluster_inertia"), F.expr("try_cast(whole as bigint)").alias("inertia"), "centroid_sha256"
    )
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, salt: str = "2") -> str:
    """DuckDB SQL of the same rows over the table ``embeddings``."""
    steps = [f"""with v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
c0 as materialized (select row_number() over (order by h, v) - 1 as c, v as m from (select sha256('{salt}:' || cast(vec_id as varchar)) as h, v from v where vec_id is not null order by h, v limit {centroids}))"""]  # fmt: skip
    for k in range(rounds + 1):
        near = f"list_sum(list_transform(range(1, {dim + 1}), lambda j: (v.v[j] - c.m[j]) * (v.v[j] - c.m[j])))"
        steps.append(f"a{k} as materialized (select r, min({{'d': cast({near} as bigint), 'c': c.c}}) as s from v cross join c{k} c group by r)")
        if k < rounds:
            steps.append(f"""c{k + 1} as materialized (select c.c, coalesce(n.m, c.m) as m from c{k} c left join (select c, list(x order by j) as m from (
  select s.c as c, j, cast(floor(sum(v[j]) / count(*)) as bigint) as x from a{k} join v using (r) cross join range(1, {dim + 1}) t(j) group by 1, 2) group by c) n on n.c = c.c)""")  # fmt: skip
    last = f"a{rounds} join v using (r) join c{rounds} c on c.c = s.c"
    return ",\n".join(steps) + f"""
select vec_id, cast(s.c as int) as cluster, s.d as distance, cast(sum(s.d) over (partition by s.c) as bigint) as cluster_inertia, cast(sum(s.d) over () as bigint) as inertia,
  sha256(array_to_string(c.m, ',')) as centroid_sha256 from {last}"""
