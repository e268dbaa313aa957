"""Band joins, tiled pair tables, linkage, extents and cell lookup."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geodesy import chord, haversine_km, on_sphere
from fathomline.operators.graph import components
from fathomline.runtime import shuffle_width


#: Rows of a cell that one key of a band join holds.
CROWD = 1024


def band_join(left: DataFrame, right: DataFrame, bands: dict[str, float], equal: list[str] = ()) -> DataFrame:
    """Pairs with |left.c - right.c| <= tolerance in every band and equal keys, as columns l_* and r_*.

    Both sides are laid on a grid twice the tolerance wide; the left side is repeated into the
    neighbouring cells, so the join is an equi-join whatever the number of rows. A cell of more than ``CROWD`` rows of the right
    side is dealt into parts of that size, each of which meets the cell's left rows; as few rows make many pairs, the
    join keeps the session's number of tasks.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    cells, exact = [], []
    for k, (name, tolerance) in enumerate(bands.items()):
        width = 2 * tolerance
        near = F.sequence(F.floor((F.col(f"l_{name}") - tolerance) / width - F.lit(1e-6)), F.floor((F.col(f"l_{name}") + tolerance) / width + F.lit(1e-6)))
        a = a.withColumn(f"_cell{k}", F.explode(near))
        b = b.withColumn(f"_home{k}", F.floor(F.col(f"r_{name}") / width))
        cells.append((f"_cell{k}", f"_home{k}"))
        exact.append(F.abs(F.col(f"l_{name}") - F.col(f"r_{name}")) <= tolerance)
    for k, c in enumerate(equal):
        a, b = a.withColumn(f"_same{k}", F.col(f"l_{c}")), b.withColumn(f"_as{k}", F.col(f"r_{c}"))
        cells.append((f"_same{k}", f"_as{k}"))
    homes = [h for _, h in cells]
    held = b.groupBy(*homes).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts"))
    sized = lambda df, at: df.join(held.select(*(F.col(h).alias(f"{h}_") for h in homes), "_parts"), _all(F.col(c) == F.col(f"{h}_") for c, h in zip(at, homes, strict=True)))
    one = sized(a, [c for c, _ in cells]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    two = sized(b, homes).withColumn("_of", F.pmod(F.xxhash64(*(f"r_{c}" for c in right.columns)), F.col("_parts")).cast("int"))
    tasks = shuffle_width(left.sparkSession)
    one = one.drop("_parts", *(f"{h}_" for h in homes)).repartition(tasks, *(c for c, _ in cells), "_part")
    two = two.drop("_parts", *(f"{h}_" for h in homes)).repartition(tasks, *homes, "_of")
    joined = one.join(two, _all([*(F.col(c) == F.col(h) for c, h in cells), F.col("_part") == F.col("_of")])).filter(_all(exact))
    return joined.drop("_part", "_of", *(c for pair in cells for c in pair))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def tolerant(a: Column, b: Column) -> Column:
    """Equality that a null on either side does not break."""
    return a.isNull() | b.isNull() | (a == b)


def all_pairs(points: DataFrame, key: str = "id", tile: int = 512, rows: int | None = None) -> DataFrame:
    """Every unordered pair once (a_* before b_* by key), joined tile by tile on an equality.

    For statistics that need all pairs: each row is sent to one group per tile, not to every row.
    """
    rows = points.count() if rows is None else rows
    tiles = max(1, math.ceil(rows / tile))
    home = points.withColumn("_t", F.pmod(F.xxhash64(key), F.lit(tiles)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    home = home.withColumn("_p", F.least("_t", "_o") * F.lit(tiles) + F.greatest("_t", "_o"))
    a = home.select(*(F.col(c).alias(f"a_{c}") for c in points.columns), "_p", F.col("_t").alias("_ta"), F.col("_o").alias("_oa"))
    b = home.select(*(F.col(c).alias(f"b_{c}") for c in points.columns), F.col("_p").alias("_q"), F.col("_t").alias("_tb"), F.col("_o").alias("_ob"))
    # a pair of different tiles meets in one group, with each side once
    met = (F.col("_p") == F.col("_q")) & (F.col("_ta") == F.col("_ob")) & (F.col("_oa") == F.col("_tb"))
    return a.join(b, met).filter(F.col(f"a_{key}") < F.col(f"b_{key}")).drop("_p", "_q", "_ta", "_tb", "_oa", "_ob")


def near_join(left: DataFrame, right: DataFrame, km: float, equal: list[str] = ()) -> DataFrame:
    """Pairs of rows (with lon, lat) within a great-circle distance and with equal keys, as columns l_*, r_* and km.

    Places are taken as points of the sphere and met through a band join along the axes of space, so the date line and the
    poles are like any other place. Rows without a place meet nothing.
    """
    reach = chord(km) * (1 + 1e-9) + 1e-12

    def placed(df: DataFrame) -> DataFrame:
        some = df.filter("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
        return some.withColumns({f"axis_{a}": c for a, c in zip("xyz", on_sphere(F.col("lon"), F.col("lat")), strict=True)})

    met = band_join(placed(left), placed(right), {f"axis_{a}": reach for a in "xyz"}, list(equal))
    straight = reduce(lambda s, t: s + t, (F.pow(F.col(f"l_axis_{a}") - F.col(f"r_axis_{a}"), 2) for a in "xyz"))
    # a generator of one row: what filters and bins distances reads the column, where a projection would be inlined into each of them
    km_of = F.explode(F.array(haversine_km(F.col("l_lon"), F.col("l_lat"), F.col("r_lon"), F.col("r_lat"))))
    met = met.filter(straight <= reach * reach).select("*", km_of.alias("km"))
    return met.drop(*(f"{s}_axis_{a}" for s in "lr" for a in "xyz")).filter(F.col("km") <= km)


def close_pairs(points: DataFrame, km: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b), a before b, within a great-circle distance; columns to keep come along as a_* and b_*."""
    own = points.select("id", "lon", "lat", *(F.col(c).alias(f"keep_{c}") for c in keep))
    kept = (F.col(f"{s}_keep_{c}").alias(f"{t}_{c}") for s, t in (("l", "a"), ("r", "b")) for c in keep)
    return near_join(own, own, km).filter("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), "km", *kept)


def single_linkage(points: DataFrame, km: float) -> DataFrame:
    """(id, cluster): the smallest id linked to each point by steps of at most ``km``."""
    label = components(close_pairs(points, km))
    return points.select("id").join(label, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def cell_of(lon: Column, lat: Column, west: float, north: float, resolution: float) -> tuple[Column, Column]:
    """(row, column) of the cell that contains a point; shared edges go east and south."""
    return F.floor((F.lit(north) - lat) / resolution).cast("int"), F.floor((lon - F.lit(west)) / resolution).cast("int")


#: Bins of one pass over a stream of values, bins that one pass cuts further, and values that are looked at one by one.
BINS, CUT, FEW = 1 << 14, 1 << 13, 4096


def _binned(values: DataFrame, spans: list[tuple[float, float]], bins: int) -> list[tuple[float, float, int]]:
    """(least, greatest, count) of the values of every used bin, in order; each of some disjoint spans is cut into ``bins``.

    The number of a bin grows with the value, so a bin holds all values between its least and its greatest one.
    """
    spark = values.sparkSession
    cut = spark.createDataFrame([(k, lo, hi, bins / (hi - lo)) for k, (lo, hi) in enumerate(spans)], "span int, lo double, hi double, scale double")
    if len(spans) == 1:
        at = values.filter(F.col("v").between(*spans[0])).select("v", F.lit(0).alias("span"), F.lit(spans[0][0]).alias("lo"), F.lit(bins / (spans[0][1] - spans[0][0])).alias("scale"))
    else:
        # spans meet values through the coarse cells they touch, a bounded table
        low, high = spans[0][0], spans[-1][1]
        coarse = lambda c: F.least(F.lit(BINS - 1), F.floor((c - low) * (BINS / (high - low))))
        cut = cut.withColumn("cell", F.explode(F.sequence(coarse(F.col("lo")), coarse(F.col("hi")))))
        laid = values.filter(F.col("v").between(low, high)).withColumn("cell", coarse(F.col("v")))
        at = laid.join(F.broadcast(cut), "cell").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    number = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * F.col("scale")))
    got = at.select("v", "span", number.alias("bin")).groupBy("span", "bin").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    return sorted((r["least"], r["most"], r["n"]) for r in got.collect())  # spans times bins at most


def _widest(parts: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """(gap, from, to): the widest gap between neighbouring parts, the first such."""
    return max(((b[0] - a[1], a[1], b[0]) for a, b in zip(parts, parts[1:], strict=False)), key=lambda g: (g[0], -g[1]), default=(0.0, math.nan, math.nan))


def ordered_summary(values: DataFrame, column: str) -> DataFrame:
    """One row (n, least, median, most, gap, gap_from, gap_to) of a column without nulls: the median is the value at n // 2
    of the sorted values, the gap the widest between neighbours (the first such).

    Values are never sorted, shuffled or written: every pass makes them anew and folds them into bins with their least and greatest value.
    The median's bin is cut until few values are left. A gap inside a bin is no wider than the bin's values lie apart, so only
    bins that spread as wide as the widest gap between bins are cut further.
    """
    spark = values.sparkSession
    schema = "n bigint, least double, median double, most double, gap double, gap_from double, gap_to double"
    values = values.select(F.col(column).cast("double").alias("v"))
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n, lo, hi = whole["n"], whole["lo"], whole["hi"]
    if not n:
        return spark.createDataFrame([], schema)
    if lo == hi:
        gap = (0.0, lo, lo) if n > 1 else (None, None, None)
        return spark.createDataFrame([(n, lo, lo, hi, *gap)], schema)
    parts = _binned(values, [(lo, hi)], BINS)
    rank, own = n // 2, parts
    while True:
        for least, most, count in own:
            if rank < count:
                break
            rank -= count
        if least == most:
            median = least
            break
        if count <= FEW:
            median = sorted(r["v"] for r in values.filter(F.col("v").between(least, most)).collect())[rank]
            break
        own = _binned(values, [(least, most)], BINS)
    while True:
        gap = _widest(parts)
        wide = [k for k, p in enumerate(parts) if p[2] > 1 and p[0] < p[1] and p[1] - p[0] >= gap[0]]
        wide = [k for k in wide if not (parts[k][2] == 2 and (parts[k][1] - parts[k][0], -parts[k][0]) <= (gap[0], -gap[1]))]
        if not wide:
            break
        wide = sorted(sorted(wide, key=lambda k: parts[k][0] - parts[k][1])[:CUT])
        finer = _binned(values, [parts[k][:2] for k in wide], max(2, BINS * 8 // len(wide)))
        gone = set(wide)
        parts = sorted([p for k, p in enumerate(parts) if k not in gone] + finer)
    return spark.createDataFrame([(n, lo, median, hi, *gap)], schema)


def cluster_spread(rows: DataFrame) -> DataFrame:
    """(cluster, members, internal_km) of (id, cluster, lon, lat): the greatest distance of two members, 0 for one alone.

    Members meet tile by tile within their cluster; a pair's distance is folded at once, so pairs never leave a task.
    """
    tiles = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    tiles = tiles.withColumn("tiles", F.ceil(F.col("members") / 512).cast("int"))
    own = rows.join(tiles, "cluster").withColumn("_t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    left = own.withColumn("_o", F.explode(F.sequence(F.col("_t"), F.col("tiles") - 1)))
    right = own.select("cluster", F.col("id").alias("_id"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("_t").alias("_o"))
    km = F.max(haversine_km(F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")))
    far = left.join(right, ["cluster", "_o"]).groupBy("cluster").agg(km.alias("internal_km"))
    return tiles.join(far, "cluster").select("cluster", "members", "internal_km")
