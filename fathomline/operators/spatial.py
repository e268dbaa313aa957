"""Spanning edges and nearest points by cells of the sphere.

Places are points of the unit sphere, whose chords order pairs as great circles do; cells are cubes, so neither poles
nor the date line are special. Cells come with the box of what they hold, which bounds all their distances.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geodesy import EARTH_KM, haversine_km, on_sphere
from fathomline.operators.graph import components
from fathomline.runtime import materialise, ship, shuffle_width

AXES = ("sx", "sy", "sz")
#: Pairs of places that one pair of cells meets at once.
PAIRS = 4096
#: Edges that one task sorts.
EDGES = 50_000
#: Places a cell may hold before the first scale of spanning edges.
CROWD = 64
#: Halvings of the sphere's diameter until a cell is not cut any more (about 6 m).
DEEPEST = 21


def _located(points: DataFrame, *keep: str) -> DataFrame:
    """Rows with a place, and its coordinates on the sphere."""
    some = points.filter("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    return some.select(*keep, "lon", "lat", *(c.alias(a) for a, c in zip(AXES, on_sphere(F.col("lon"), F.col("lat")), strict=True)))


def _cells(side: float) -> list[Column]:
    return [F.floor((F.col(a) + 1) / side).alias(f"c{a}") for a in AXES]


def _box() -> list[Column]:
    return [f(a).alias(f"{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))]


def _gap(p: str, q: str) -> Column:
    """Square of the least distance of two boxes, columns ``p``x0, ``p``x1, ..."""
    one = lambda a: F.greatest(F.lit(0.0), F.col(f"{q}{a}0") - F.col(f"{p}{a}1"), F.col(f"{p}{a}0") - F.col(f"{q}{a}1"))
    return reduce(lambda s, t: s + t, (one(a) * one(a) for a in AXES))


def _span(p: str, q: str) -> Column:
    """Square of the greatest distance of two boxes."""
    one = lambda a: F.greatest(F.col(f"{q}{a}1") - F.col(f"{p}{a}0"), F.col(f"{p}{a}1") - F.col(f"{q}{a}0"))
    return reduce(lambda s, t: s + t, (one(a) * one(a) for a in AXES))


def _named(df: DataFrame, prefix: str, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*(F.col(c).alias(c if c in skip else f"{prefix}{c}") for c in df.columns))


# ---------------------------------------------------------------- spanning edges


def _nearest_cells(pairs: DataFrame, limit: float) -> DataFrame:
    """Pairs of cells that may hold the nearest places of their two labels, within ``limit``."""
    pairs = materialise(pairs.withColumns({"lo": _gap("a_", "b_"), "hi": _span("a_", "b_")}).filter(F.col("lo") <= limit * limit), "span-cells")
    best = pairs.groupBy("a_label", "b_label").agg(F.min("hi").alias("best"))
    kept = pairs.join(best, ["a_label", "b_label"]).filter(F.col("lo") <= F.col("best") * (1 + 1e-9) + 1e-30)
    return materialise(kept.drop("lo", "hi", "best"), "span-cells")


def _between(now: DataFrame, side: float, limit: float) -> DataFrame:
    """(a_label, b_label, km, a, b): the nearest two places of any two labels whose distance is a chord of ``limit`` at most.

    Cells of one side that hold several labels, or lie near others, meet by their boxes; pairs that hold many places are cut
    into smaller cells, and only those that may hold the nearest two go on.
    """
    cell = [f"c{a}" for a in AXES]
    held = now.groupBy("within", *_cells(side), "label").agg(F.count(F.lit(1)).alias("n"), *_box())
    held = materialise(held, "span-held")
    left = _named(held, "a_", ("within",))
    for a in AXES:
        reach = F.sequence(F.floor((F.col(f"a_{a}0") + 1 - limit) / side), F.floor((F.col(f"a_{a}1") + 1 + limit) / side))
        left = left.withColumn(f"k{a}", F.explode(reach))
    right = _named(held, "b_", ("within",))
    near = reduce(lambda x, y: x & y, (F.col(f"k{a}") == F.col(f"b_c{a}") for a in AXES))
    met = left.join(right.withColumnRenamed("within", "_w"), (F.col("within") == F.col("_w")) & near).filter("a_label < b_label")
    pairs = _nearest_cells(met.drop("_w", *(f"k{a}" for a in AXES)), limit)
    found = []
    while True:
        heavy = (F.col("a_n") * F.col("b_n") > PAIRS) & F.lit(side > 1e-14)
        ready = pairs.filter(~heavy).select("a_label", "b_label", *(f"{s}_{c}" for s in "ab" for c in cell))
        own = now.select("within", "label", "id", "lon", "lat", *_cells(side))
        one, two = _named(own, "a_"), _named(own, "b_")
        places = ready.join(one, ["a_label", *(f"a_{c}" for c in cell)]).join(two, ["b_label", *(f"b_{c}" for c in cell)])
        km = haversine_km(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
        best = F.min(F.struct(km.alias("km"), F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))).alias("m")
        found.append(places.groupBy("a_label", "b_label").agg(best))
        more = pairs.filter(heavy).select("a_label", "b_label", *(f"{s}_{c}" for s in "ab" for c in cell))
        if not more.head(1):
            break
        side /= 4
        parent = [F.floor(F.col(c) / 4).alias(f"p{c}") for c in cell]
        parts = now.groupBy("label", *_cells(side)).agg(F.count(F.lit(1)).alias("n"), *_box()).select("*", *parent)
        up = lambda s: [F.col(f"up_{s}_{c}") == F.col(f"{s}_p{c}") for c in cell]
        more = more.select(F.col("a_label").alias("up_a"), F.col("b_label").alias("up_b"), *(F.col(f"{s}_{c}").alias(f"up_{s}_{c}") for s in "ab" for c in cell))
        made = more
        for s in "ab":
            made = made.join(_named(parts, f"{s}_"), reduce(lambda x, y: x & y, [F.col(f"up_{s}") == F.col(f"{s}_label"), *up(s)]))
        pairs = _nearest_cells(made.drop(*(c for c in made.columns if c.startswith("up_") or c[1:4] == "_pc")), limit)
    nearest = reduce(DataFrame.unionAll, found).groupBy("a_label", "b_label").agg(F.min("m").alias("m"))
    return nearest.select("a_label", "b_label", "m.km", "m.a", "m.b")


def _forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest of labels by (km, a, b): rounds of each label's nearest edge, the last few edges in one task."""
    edges, chosen = materialise(edges, "span-edges"), []
    at = edges.select("a_label", "b_label", "km", "a", "b", F.col("a_label").alias("u"), F.col("b_label").alias("v"))
    columns = ["a_label", "b_label", "km", "a", "b"]
    while at.count() > EDGES:
        order = F.struct("km", "a", "b", "a_label", "b_label", "u", "v")
        ends = at.select(F.col("u").alias("end"), order.alias("m")).unionAll(at.select(F.col("v").alias("end"), order.alias("m")))
        picked = materialise(ends.groupBy("end").agg(F.min("m").alias("m")).select("m.*").distinct(), "span-picked")
        chosen.append(picked.select(*columns))
        joined = components(picked, "u", "v")
        for c in "uv":
            at = at.join(joined.select(F.col("id").alias(c), F.col("component").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        at = at.filter("u <> v").withColumns({"p": F.least("u", "v"), "q": F.greatest("u", "v")})
        least = at.groupBy("p", "q").agg(F.min(F.struct("km", "a", "b", "a_label", "b_label")).alias("m"))
        at = materialise(least.select("m.a_label", "m.b_label", "m.km", "m.a", "m.b", F.col("p").alias("u"), F.col("q").alias("v")), "span-edges")

    def settle(frames):
        """Kruskal's choice among all edges that are left."""
        all_ = [f for f in frames if len(f)]
        if not all_:
            return
        frame = pd.concat(all_).sort_values(["km", "a", "b"], kind="stable")
        parent: dict[int, int] = {}

        def root(n: int) -> int:
            while parent.setdefault(n, n) != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        take = []
        for u, v in zip(frame["u"], frame["v"], strict=True):
            p, q = root(u), root(v)
            parent[max(p, q)] = min(p, q)
            take.append(p != q)
        yield frame.loc[take, columns]

    last = at.coalesce(1).mapInPandas(settle, "a_label bigint, b_label bigint, km double, a bigint, b bigint")
    return materialise(reduce(DataFrame.unionAll, [*chosen, last]), "span-forest")


#: Places of a cell whose surely spanning edges one task finds, and tasks that cells are dealt to.
WITHIN, DEALT = 2048, 96


def _spanning_within(frame: pd.DataFrame) -> pd.DataFrame:
    """(label, root, a, b, km): of one cell's places, edges that no place outside can replace, and the label that each place gets by them.

    Edges of the cell's own spanning tree are taken shortest first. Where one is shorter than one of its two components is far from the cell's
    walls, it is that component's shortest edge to any place at all. An edge that was left out keeps both its components from ever being so.
    """
    frame = frame.sort_values("id")
    at, ids, label = frame[list(AXES)].to_numpy(), frame["id"].to_numpy(), frame["label"].to_numpy()
    side = 2.0 ** (1 - int(frame["depth"].iloc[0]))
    low = frame[[f"c{a}" for a in AXES]].to_numpy() * side - 1
    wall = np.minimum(at - low, low + side - at).min(axis=1) * (1 - 1e-9) - 1e-12
    n, near, to, left = len(ids), np.full(len(ids), np.inf), np.zeros(len(ids), int), np.ones(len(ids), bool)
    tree, now = [], 0
    if n <= 4 * WITHIN:  # more only share one cell of the last depth
        left[0] = False
        for _ in range(n - 1):
            d = ((at - at[now]) ** 2).sum(axis=1)
            tie = np.flatnonzero((d == near) & left)
            for k in tie:  # by (a, b); places are in the order of ids
                if sorted((now, k)) < sorted((int(to[k]), k)):
                    to[k] = now
            closer = left & (d < near)
            near[closer], to[closer] = d[closer], now
            open_ = np.where(left, near, np.inf)
            now = int(open_.argmin())
            same = np.flatnonzero(open_ == open_[now])
            if len(same) > 1:
                now = int(min(same, key=lambda k: sorted((int(to[k]), int(k)))))
            left[now] = False
            tree.append((near[now], *sorted((int(to[now]), now))))
    root, taken = list(range(n)), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for square, p, q in sorted(tree):
        u, v = sorted((top(p), top(q)))
        if math.sqrt(square) < max(wall[u], wall[v]):
            root[v], wall[u] = u, min(wall[u], wall[v])
            taken.append((p, q))
    placed = pd.DataFrame({"label": label, "root": label[[top(k) for k in range(n)]], "a": None, "b": None, "km": None})
    p, q = np.array(taken, int).reshape(-1, 2).T
    lon, lat = np.radians(frame["lon"].to_numpy()), np.radians(frame["lat"].to_numpy())
    part = np.sin((lat[q] - lat[p]) / 2) ** 2 + np.cos(lat[p]) * np.cos(lat[q]) * np.sin((lon[q] - lon[p]) / 2) ** 2
    made = pd.DataFrame({"label": label[p], "root": None, "a": ids[p], "b": ids[q], "km": 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, part)))})
    return pd.concat([f.astype(object) for f in (placed, made)], ignore_index=True)


def spanning_by_scales(points: DataFrame, group: str) -> DataFrame:
    """(group, a, b, km): minimum spanning edges of groups of any size, ties by (km, a, b).

    Edges that cells of at most ``WITHIN`` places make out on their own come first. Scales grow fourfold. Before a scale, places of different labels are farther apart than the scale before, so a cell
    holds few labels; between two labels only the nearest two places matter. Places that share one label with all around them meet nothing.
    Rows without a place are left out; those that share a place hang on its smallest id.
    """
    ship(points.sparkSession)
    rows = _located(points.select("id", "lon", "lat", group, F.to_json(F.struct(F.col(group))).alias("within")), "id", group, "within")
    first = Window.partitionBy("within", "lon", "lat")
    rows = materialise(rows.withColumn("home", F.min("id").over(first)), "span-rows")
    zero = rows.filter("id <> home").select(group, F.col("home").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("km"))
    places = rows.filter("id = home").dropDuplicates(["within", "id"])
    places = materialise(places.select("within", group, "id", "lon", "lat", *AXES).withColumn("label", F.monotonically_increasing_id()), "span-places")
    now = places.drop(group)
    size = now.agg(F.count(F.lit(1)).alias("n"), *_box()).first()
    if not size["n"]:
        return zero
    wide = sorted(size[f"{a}1"] - size[f"{a}0"] for a in AXES)
    key = ["within", "depth", *(f"c{a}" for a in AXES)]
    _, cut = _nodes(now, WITHIN, max(0, min(DEEPEST, math.floor(math.log2(2 / max(wide[2], 1e-9))))))
    dealt = cut.repartition(max(DEALT, shuffle_width(points.sparkSession)), *key)  # few bytes, long work
    local = dealt.groupBy(*key).applyInPandas(_spanning_within, "label bigint, root bigint, a bigint, b bigint, km double")
    local = materialise(local, "span-local")
    found = [local.filter("root is null").select(F.col("label").alias("a_label"), "a", "b", "km")]
    now = now.join(local.filter("root is not null").select(F.col("label").alias("_of"), "root"), F.col("label") == F.col("_of")).withColumn("label", F.col("root")).drop("_of", "root")
    limit = min(1.0, max(1e-9, math.sqrt(wide[2] * wide[1] / size["n"])))
    while limit > 1e-12 and now.groupBy("within", *_cells(2 * limit)).count().filter(F.col("count") > CROWD).head(1):
        limit /= 4
    while True:
        several = now.groupBy("within").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
        now = materialise(now.join(several.select("within"), "within", "left_semi"), "span-now")
        if not now.head(1):
            break
        # the sphere's diameter is a chord of 2: from there on everything meets
        km = 2 * EARTH_KM * math.asin(min(1.0, limit / 2)) if limit < 2 else math.inf
        edges = _between(now, 2 * limit, min(2.0, limit) * (1 + 1e-9)).filter(F.col("km") <= km)
        chosen = _forest(edges)
        if chosen.head(1):
            found.append(chosen.select("a_label", "a", "b", "km"))
            joined = components(chosen, "a_label", "b_label").select(F.col("id").alias("_of"), "component")
            now = now.join(joined, F.col("label") == F.col("_of"), "left").withColumn("label", F.coalesce("component", "label")).drop("_of", "component")
        limit *= 4
    # a label is the number of one of its places for good, so an edge's group is that of its label
    named = reduce(DataFrame.unionAll, found).join(places.select(F.col("label").alias("a_label"), group), "a_label")
    return zero.unionAll(named.select(group, "a", "b", "km"))


# ---------------------------------------------------------------- nearest points


def _nodes(points: DataFrame, most: int, start: int) -> tuple[list[DataFrame], DataFrame]:
    """Cells of every depth from ``start`` (depth, cell, n, leaf, box), and points with the leaf that holds them.

    A cell of more than ``most`` points is cut into its parts, each half as wide, down to ``DEEPEST``.
    """
    cell = [f"c{a}" for a in AXES]
    levels, placed, rest, depth = [], [], points, start
    while True:
        side = 2.0 ** (1 - depth)
        at = rest.select("*", *_cells(side))
        nodes = at.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *_box()).withColumn("leaf", (F.col("n") <= most) | F.lit(depth >= DEEPEST))
        nodes = materialise(nodes.withColumn("depth", F.lit(depth)), "near-nodes")
        levels.append(nodes)
        marked = at.join(nodes.select(*cell, "leaf", "depth"), cell)
        placed.append(marked.filter("leaf").drop("leaf"))
        if not nodes.filter("not leaf").head(1):
            break
        rest = materialise(marked.filter("not leaf").drop("leaf", "depth", *cell), "near-rest")
        depth += 1
    return levels, materialise(reduce(DataFrame.unionAll, placed), "near-placed")


def nearest_points(asked: DataFrame, points: DataFrame, near: int, label: str | None = None) -> DataFrame:
    """Asked rows (with id, lon, lat) and ``around``: their nearest points as (km, id, lon, lat, y), nearest first, ties by id.

    With a label, points of the row's own label do not count. Points lie in cells that are cut by their number, so a dense spot has
    small ones. Cells of asked rows go down together with the cells around them: of these, a cell stays whose box is not
    farther than boxes that hold ``near`` points together. Rows then meet the points of the few leaves that are left. Rows without
    a place, and all rows where no point counts, keep an empty array.
    """
    cell = [f"c{a}" for a in AXES]
    own = _located(asked.select("id", "lon", "lat", (F.col(label) if label else F.lit(0)).alias("label")), "id", "label")
    own = materialise(own, "near-asked")
    pool = _located(points.select("id", "lon", "lat", "y", (F.col(label) if label else F.lit(1)).alias("label")), "id", "y", "label")
    pool = materialise(pool, "near-points")
    kind = "array<struct<km:double,id:bigint,lon:double,lat:double,y:double>>"
    none = F.expr(f"cast(array() as {kind})")
    size = pool.agg(F.count(F.lit(1)).alias("n"), *_box()).first()
    if not size["n"]:
        return asked.withColumn("around", none)
    widest = max(size[f"{a}1"] - size[f"{a}0"] for a in AXES)
    start = max(0, min(DEEPEST, math.floor(math.log2(2 / max(widest, 1e-9)))))
    levels, placed = _nodes(pool, near, start)
    groups = lambda depth: own.groupBy("label", *_cells(2.0 ** (1 - depth))).agg(*_box())
    q_cell = [f"q_c{a}" for a in AXES]

    def kept(pairs: DataFrame) -> DataFrame:
        """Pairs whose point cell may hold one of the nearest points of its asked cell."""
        if label:
            pairs = pairs.withColumn("count", F.col("p_n") - F.coalesce("p_own", F.lit(0))).filter("count > 0")
        else:
            pairs = pairs.withColumn("count", F.col("p_n"))
        pairs = pairs.withColumns({"lo": _gap("q_", "p_"), "hi": _span("q_", "p_")})
        run = Window.partitionBy("q_label", *q_cell).orderBy("hi").rangeBetween(Window.unboundedPreceding, 0)
        enough = F.when(F.sum("count").over(run) >= near, F.col("hi"))
        pairs = pairs.withColumn("enough", enough).withColumn("reach", F.min("enough").over(Window.partitionBy("q_label", *q_cell)))
        pairs = pairs.filter(F.col("reach").isNull() | (F.col("lo") <= F.col("reach") * (1 + 1e-9) + 1e-30)).drop("count", "lo", "hi", "enough", "reach")
        pairs = pairs.withColumn("open", F.max((~F.col("p_leaf")).cast("int")).over(Window.partitionBy("q_label", *q_cell)))
        return materialise(pairs, "near-pairs")

    def own_counts(depth: int) -> DataFrame:
        """Points of a cell by label."""
        side = 2.0 ** (1 - depth)
        return pool.groupBy(*_cells(side), "label").agg(F.count(F.lit(1)).alias("own")).select(*(F.col(c).alias(f"p_{c}") for c in cell), F.col("label").alias("q_label"), F.col("own").alias("p_own"))

    depth, found = start, []
    nodes = _named(levels[0], "p_")
    pairs = _named(groups(depth), "q_").join(F.broadcast(nodes), F.lit(True))  # at this depth all points lie in eight cells at most
    if label:
        pairs = pairs.join(own_counts(depth), [*(f"p_{c}" for c in cell), "q_label"], "left")
    pairs = kept(pairs)
    while True:
        q = [F.col(c) for c in ("q_label", *q_cell)]
        found.append((depth, pairs.filter("open = 0").select(*q, *(f"p_{c}" for c in cell), "p_depth")))
        going = pairs.filter("open = 1")
        if not going.head(1):
            break
        depth += 1
        up = _named(groups(depth), "q_").select("*", *(F.floor(F.col(c) / 2).alias(f"up_{c}") for c in q_cell))
        down = going.select(F.col("q_label").alias("up_label"), *(F.col(c).alias(f"of_{c}") for c in q_cell), *(c for c in going.columns if c.startswith("p_")))
        met = down.join(up, reduce(lambda x, y: x & y, [F.col("up_label") == F.col("q_label"), *(F.col(f"up_{c}") == F.col(f"of_{c}") for c in q_cell)]))
        met = met.drop("up_label", *(f"up_{c}" for c in q_cell), *(f"of_{c}" for c in q_cell))
        shut, split = met.filter("p_leaf"), met.filter("not p_leaf").select("q_label", *q_cell, *(c for c in met.columns if c.startswith("q_") and c[2:4] in AXES), *(F.col(f"p_{c}").alias(f"in_{c}") for c in cell))
        parts = _named(levels[depth - start], "p_").select("*", *(F.floor(F.col(f"p_{c}") / 2).alias(f"over_{c}") for c in cell))
        made = split.join(parts, reduce(lambda x, y: x & y, (F.col(f"over_{c}") == F.col(f"in_{c}") for c in cell))).drop(*(f"over_{c}" for c in cell), *(f"in_{c}" for c in cell))
        if label:
            made = made.join(own_counts(depth), [*(f"p_{c}" for c in cell), "q_label"], "left")
        pairs = kept(shut.unionByName(made))

    some = []
    for at, ready in found:
        side = 2.0 ** (1 - at)
        rows = own.select(F.col("id").alias("q_id"), F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), F.col("label").alias("q_label"), *(c.alias(f"q_c{a}") for a, c in zip(AXES, _cells(side), strict=True)))
        some.append(rows.join(ready, ["q_label", *q_cell]).select("q_id", "q_lon", "q_lat", "q_label", *(f"p_{c}" for c in cell), "p_depth"))
    leaf = _named(placed.select("id", "lon", "lat", "y", "label", "depth", *cell), "p_")
    met = reduce(DataFrame.unionAll, some).join(leaf, [*(f"p_{c}" for c in cell), "p_depth"]).filter("q_label <> p_label")
    met = met.select("q_id", haversine_km(F.col("q_lon"), F.col("q_lat"), F.col("p_lon"), F.col("p_lat")).alias("km"), "p_id", "p_lon", "p_lat", "p_y")
    first = met.withColumn("k", F.row_number().over(Window.partitionBy("q_id").orderBy("km", "p_id"))).filter(F.col("k") <= near)
    point = F.struct("km", F.col("p_id").alias("id"), F.col("p_lon").alias("lon"), F.col("p_lat").alias("lat"), F.col("p_y").alias("y"))
    around = first.groupBy("q_id").agg(F.array_sort(F.collect_list(point)).alias("around"))
    return asked.join(around, asked["id"] == around["q_id"], "left").drop("q_id").withColumn("around", F.coalesce("around", none))


# ---------------------------------------------------------------- nearest places of labels

#: Pairs of places that two cells may hold before they are cut further, unless all that are left hold few.
MEET, LAST = 64, 1 << 22


def nearest_of_labels(points: DataFrame, label: str) -> DataFrame:
    """(label, km, a, b): for every label the least (km, a, b) of a row (id, lon, lat) of its own and one of another label, however far.

    Cells of a label go down together with all cells, halved at each step. Of these, a pair stays whose boxes are not farther apart
    than the farthest ends of some pair of the same label that holds a row of another one, so few are left where labels lie apart.
    Labels without any other are left out; rows without a label or a place are ignored.
    """
    cell = [f"c{a}" for a in AXES]
    own = materialise(_located(points.select("id", "lon", "lat", F.col(label).alias("label")).filter("label is not null"), "id", "label"), "label-rows")
    size = own.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *_box()).first()
    if size["lo"] == size["hi"]:
        return own.select("label", F.lit(0.0).alias("km"), F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    widest = max(size[f"{a}1"] - size[f"{a}0"] for a in AXES)
    depth = max(0, min(DEEPEST, math.floor(math.log2(2 / max(widest, 1e-9)))))
    pairs, best, ready = None, None, []
    while True:
        side = 2.0 ** (1 - depth)
        held = materialise(own.groupBy("label", *_cells(side)).agg(F.count(F.lit(1)).alias("n"), *_box()), "label-cells")
        every = held.groupBy(*cell).agg(F.sum("n").alias("n"), *(f(f"{a}{k}").alias(f"{a}{k}") for a in AXES for k, f in ((0, F.min), (1, F.max))))
        one, two = _named(held, "q_"), _named(every, "p_")
        if pairs is None:
            met = one.join(F.broadcast(two), F.lit(True))  # at this depth all places lie in eight cells at most
        else:
            up = pairs.select(F.col("q_label").alias("up_label"), *(F.col(f"{s}_{c}").alias(f"up_{s}_{c}") for s in "qp" for c in cell))
            over = lambda s: [F.floor(F.col(f"{s}_{c}") / 2) == F.col(f"up_{s}_{c}") for c in cell]
            met = up.join(one, reduce(lambda x, y: x & y, [F.col("up_label") == F.col("q_label"), *over("q")]))
            met = met.join(two, reduce(lambda x, y: x & y, over("p"))).drop(*(c for c in up.columns))
        mine = held.select(F.col("label").alias("q_label"), *(F.col(c).alias(f"p_{c}") for c in cell), F.col("n").alias("own"))
        met = met.join(mine, ["q_label", *(f"p_{c}" for c in cell)], "left").filter(F.col("p_n") > F.coalesce("own", F.lit(0)))
        met = materialise(met.withColumns({"lo": _gap("q_", "p_"), "hi": _span("q_", "p_")}), "label-pairs")
        told = met.groupBy("q_label").agg(F.min("hi").alias("best"))
        best = told if best is None else best.unionAll(told).groupBy("q_label").agg(F.min("best").alias("best"))
        best = materialise(best, "label-best")
        near = materialise(met.join(best, "q_label").filter(F.col("lo") <= F.col("best") * (1 + 1e-9) + 1e-30).drop("best"), "label-near")
        done = (F.col("q_n") * F.col("p_n") <= MEET) | F.lit(depth >= DEEPEST)
        pairs = near.filter(~done)
        if (pairs.agg(F.sum(F.col("q_n").cast("double") * F.col("p_n")).alias("n")).first()["n"] or 0.0) <= LAST:
            ready.append((side, near))
            break
        ready.append((side, near.filter(done)))
        depth += 1
    found = []
    for side, some in ready:
        rows = own.select("id", "lon", "lat", "label", *_cells(side))
        some = some.join(best, "q_label").filter(F.col("lo") <= F.col("best") * (1 + 1e-9) + 1e-30)
        some = some.select("q_label", *(f"{s}_{c}" for s in "qp" for c in cell))
        met = some.join(_named(rows, "q_"), ["q_label", *(f"q_{c}" for c in cell)]).join(_named(rows, "p_"), [f"p_{c}" for c in cell]).filter("q_label <> p_label")
        km = haversine_km(F.col("q_lon"), F.col("q_lat"), F.col("p_lon"), F.col("p_lat"))
        found.append(met.groupBy("q_label").agg(F.min(F.struct(km.alias("km"), F.least("q_id", "p_id").alias("a"), F.greatest("q_id", "p_id").alias("b"))).alias("m")))
    least = reduce(DataFrame.unionAll, found).groupBy("q_label").agg(F.min("m").alias("m"))
    return least.select(F.col("q_label").alias("label"), "m.km", "m.a", "m.b")
