"""Statistics of all pairs of places, or of those within a distance, folded block by block.

Places are cut into blocks of bounded size by cells of the sphere. Two blocks meet in one task, unless their boxes lie farther
apart than asked; the task folds their pairs in numpy into sums, bins or counts, so pairs are neither written nor shuffled. How often a
place is sent is the number of blocks that its own one meets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.functions.geodesy import EARTH_KM, chord
from fathomline.operators.spatial import AXES, DEEPEST, _box, _gap, _located, _named, _nodes
from fathomline.runtime import materialise, ship, shuffle_width

#: Places of a block at most, pairs that numpy takes at once, tasks that pairs of blocks are dealt to.
BLOCK, CHUNK, TASKS = 4096, 1 << 18, 96


class Blocks:
    """Rows (id, lon, lat and more columns) that have a place, by block, and the pairs of blocks that may hold pairs within ``km``."""

    def __init__(self, points: DataFrame, keep: tuple[str, ...] = (), km: float | None = None, most: int | None = None):
        self.spark, most = points.sparkSession, most or BLOCK
        ship(self.spark)
        rows = materialise(_located(points, "id", *keep), "pair-rows")
        size = rows.agg(F.count(F.lit(1)).alias("n"), *_box()).first()
        #: the greatest chord of two places, and the chord within which pairs count
        self.top = math.sqrt(sum((size[f"{a}1"] - size[f"{a}0"]) ** 2 for a in AXES)) if size["n"] else 0.0
        self.reach = None if km is None else chord(km) * (1 + 1e-9) + 1e-12
        columns = ["id", "lon", "lat", *keep]
        if size["n"] <= most:
            self.rows, self.width = rows.select(F.lit(0).cast("bigint").alias("pair"), F.lit(0).alias("side"), *columns), 1
            return
        widest = max(size[f"{a}1"] - size[f"{a}0"] for a in AXES)
        levels, placed = _nodes(rows, most, max(0, min(DEEPEST, math.floor(math.log2(2 / max(widest, 1e-9))))))
        cell = ["depth", *(f"c{a}" for a in AXES)]
        leaves = [level.filter("leaf").withColumn("parts", F.ceil(F.col("n") / most).cast("int")) for level in levels]
        leaves = materialise(_union(leaves), "pair-leaves")
        blocks = leaves.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", F.monotonically_increasing_id())
        blocks = materialise(blocks, "pair-blocks")
        # a leaf at the last depth may hold more than a block does
        at = placed.join(leaves.select(*cell, "parts"), cell).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        at = materialise(at.join(blocks.select(*cell, "part", "block"), [*cell, "part"]).select("block", *columns), "pair-rows")
        met = _named(blocks, "a_").join(_named(blocks, "b_"), F.col("a_block") <= F.col("b_block"))
        if self.reach is not None:
            met = met.filter(_gap("a_", "b_") <= self.reach * self.reach)
        met = materialise(met.select("a_block", "b_block", F.monotonically_increasing_id().alias("pair")), "pair-pairs")
        one = at.join(met.select("pair", F.lit(0).alias("side"), F.col("a_block").alias("block")), "block")
        two = at.join(met.filter("a_block < b_block").select("pair", F.lit(1).alias("side"), F.col("b_block").alias("block")), "block")
        self.rows, self.width = one.unionAll(two).drop("block"), min(met.count(), max(TASKS, shuffle_width(self.spark)))

    def fold(self, run: Callable[[Iterable[Met]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        """What ``run`` makes of the pairs of blocks of a task."""
        reach = self.reach

        def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from run(Met(frame, reach) for frame in _by_pair(frames))

        # a number of tasks of its own: few bytes make many pairs
        dealt = self.rows.repartition(self.width, "pair").sortWithinPartitions("pair")
        return dealt.mapInPandas(folded, schema)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _by_pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one pair of blocks at a time, of frames sorted by it."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame["pair"].to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and held[0]["pair"].iloc[0] != key[lo]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


def kilometres(straight: np.ndarray) -> np.ndarray:
    """Great-circle distances of halves of chords."""
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, straight))


class Met:
    """The pairs of two blocks, or of one with itself; rows of equal ids make no pair."""

    def __init__(self, frame: pd.DataFrame, reach: float | None):
        self.own = bool((frame["side"] == 0).all())
        self.a = frame[frame["side"] == 0].reset_index(drop=True)
        self.b = self.a if self.own else frame[frame["side"] == 1].reset_index(drop=True)
        self.limit = None if reach is None else (reach / 2) ** 2
        a, b = self.a["id"].to_numpy(), self.b["id"].to_numpy()
        self.repeated = len(np.unique(a)) < len(a) if self.own else bool(np.intersect1d(a, b).size)

    @staticmethod
    def _halves(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        lon, lat = np.radians(rows["lon"].to_numpy(float)), np.radians(rows["lat"].to_numpy(float))
        return np.sin(lat / 2), np.cos(lat / 2), np.sin(lon / 2), np.cos(lon / 2), np.cos(lat)

    def chunks(self, ends: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """(halves of chords, rows of a, rows of b) of some pairs at a time; ends only where asked."""
        p, q = self._halves(self.a), self._halves(self.b)
        wide = len(self.b)
        step = max(1, CHUNK // max(1, wide))
        for at in range(0, len(self.a), step):
            s, c, u, v, flat = (x[at : at + step, None] for x in p)
            first = at if self.own else 0  # within a block, rows meet those behind them
            r = [x[None, first:] for x in q]
            north, east = r[0] * c - r[1] * s, r[2] * v - r[3] * u
            square = north * north + flat * r[4] * (east * east)
            use = None
            if self.own:
                use = np.arange(first, wide)[None, :] > np.arange(at, at + len(s))[:, None]
            if self.repeated:
                apart = self.a["id"].to_numpy()[at : at + step, None] != self.b["id"].to_numpy()[None, first:]
                use = apart if use is None else use & apart
            if self.limit is not None:
                near = square <= self.limit
                use = near if use is None else use & near
            if use is None and not ends:
                yield np.sqrt(square).ravel(), None, None
                continue
            if use is None:
                i, j = np.divmod(np.arange(square.size), square.shape[1])
                yield np.sqrt(square).ravel(), i + at, j + first
                continue
            took = np.flatnonzero(use)
            straight = np.sqrt(square.ravel()[took])
            if ends:
                i, j = np.divmod(took, square.shape[1])
                yield straight, i + at, j + first
            else:
                yield straight, None, None


def count_pairs(points: DataFrame) -> int:
    """Pairs of rows with different ids."""
    shared = points.groupBy("id").count().agg(F.sum("count").alias("n"), F.sum(F.expr("cast(count as decimal(38,0)) * (count - 1)")).alias("same")).first()
    n = int(shared["n"] or 0)
    return (n * (n - 1) - int(shared["same"] or 0)) // 2


def distances(points: DataFrame, near_km: float) -> DataFrame:
    """One row (pairs, min_km, max_km, mean_km, near) of all pairs of (id, lon, lat); ``near``: those within ``near_km``."""

    def run(met: Iterable[Met]) -> Iterator[pd.DataFrame]:
        n, least, most, total, near = 0, math.inf, -math.inf, 0.0, 0
        for pair in met:
            for straight, _, _ in pair.chunks():
                if len(straight):
                    km = kilometres(straight)
                    n, total, near = n + len(km), total + float(km.sum()), near + int((km <= near_km).sum())
                    least, most = min(least, float(km.min())), max(most, float(km.max()))
        if n:
            yield pd.DataFrame({"n": [n], "least": [least], "most": [most], "total": [total], "near": [near]})

    got = Blocks(points.select("id", "lon", "lat")).fold(run, "n bigint, least double, most double, total double, near bigint")
    told = got.agg(F.min("least").alias("min_km"), F.max("most").alias("max_km"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean_km"), F.coalesce(F.sum("near"), F.lit(0)).alias("near"))
    return told.select(F.lit(count_pairs(points)).cast("bigint").alias("pairs"), "*")


#: Places of a part of a block, whose pairs with another part are counted at once where all of them lie in one lag bin.
PART = 64
#: Pairs of places whose distances are held at once, so that a core keeps them near.
HELD = 1 << 16


class Parts:
    """A block's rows in parts of near places that share one label (a code), with their boxes and the moments of their values."""

    def __init__(self, rows: pd.DataFrame, label: np.ndarray):
        lon, lat = np.radians(rows["lon"].to_numpy(float)), np.radians(rows["lat"].to_numpy(float))
        at = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
        by = np.argsort(label, kind="stable")
        left = np.split(by, np.flatnonzero(np.diff(label[by])) + 1)[::-1] if len(by) else []
        parts = []
        while left:
            some = left.pop()
            if len(some) > PART:
                axis = at[:, some]
                axis = axis[np.ptp(axis, axis=1).argmax()]
                some, half = some[np.argsort(axis, kind="stable")], len(some) // 2
                left += [some[half:], some[:half]]
            else:
                parts.append(some)
        order = np.concatenate(parts)
        self.start = np.cumsum([0, *map(len, parts)])
        self.at, self.id, self.y = at[:, order], rows["id"].to_numpy()[order], rows["y"].to_numpy(float)[order]
        self.label, first = label[order], self.start[:-1]
        self.n, self.of = np.diff(self.start).astype(float), self.label[first]
        self.lo, self.hi = np.minimum.reduceat(self.at, first, axis=1), np.maximum.reduceat(self.at, first, axis=1)
        self.endless = np.logical_or.reduceat(np.isinf(self.y), first)

    def moments(self, middle: float) -> tuple[np.ndarray, ...]:
        """Rows with a value, the sum of their values less ``middle``, and that of the squares, by part."""
        known = np.isfinite(self.y)
        v = np.where(known, self.y - middle, 0.0)
        return tuple(np.add.reduceat(x, self.start[:-1]) for x in (known.astype(float), v, v * v))


def _arcs(square: np.ndarray) -> np.ndarray:
    """Great-circle distances of squares of chords; near ones by the series of the arc, whose next term is below 1e-16 of it."""
    x = square * 0.25
    if not x.size or x.max() > 6e-4:  # a chord of about 0.05, 310 km
        return kilometres(np.sqrt(x))
    arc = x * (105 / 3456)
    for term in (15 / 336, 3 / 40, 1 / 6):
        arc += term
        arc *= x
    arc += 1
    arc *= np.sqrt(x, out=x)
    arc *= 2 * EARTH_KM
    return arc


def _lags(met: Met, one: Parts, two: Parts, bounds: list[float]) -> Iterator[tuple[np.ndarray | None, ...]]:
    """(bin, label of a, label of b, pairs, km, pairs with both values, half squares) of two blocks' pairs, bin 0 lies before the first bound.

    Two parts whose boxes leave their pairs one bin only are one row of sums, from moments and the sum of distances; pairs of other
    parts are a row each (without a number of pairs). Parts that lie beyond the last bound are not looked at.
    """
    known = np.flatnonzero(np.isfinite(one.y))
    middle = one.y[known[0]] if len(known) else 0.0
    p, q = one.moments(middle), two.moments(middle)
    edges, last = np.array(bounds), len(bounds)
    step = max(1, HELD // max(1, len(two.y)))
    cuts, parts = [0], len(one.n)
    while cuts[-1] < parts:  # parts of about a chunk of pairs
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(one.start, one.start[cuts[-1]] + step, "right")) - 1))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        r0, r1 = one.start[lo], one.start[hi]
        near, far = np.zeros((hi - lo, len(two.n))), np.zeros((hi - lo, len(two.n)))
        for axis in range(3):
            a0, a1 = one.lo[axis, lo:hi, None], one.hi[axis, lo:hi, None]
            near += np.maximum(0, np.maximum(two.lo[axis] - a1, a0 - two.hi[axis])) ** 2
            far += np.maximum(two.hi[axis] - a0, a1 - two.lo[axis]) ** 2
        least, most = kilometres(np.sqrt(near) / 2), kilometres(np.sqrt(far) / 2)
        k = np.searchsorted(edges, least * (1 - 1e-9) - 1e-9, "right")
        each = (k != np.searchsorted(edges, most * (1 + 1e-9) + 1e-9, "right")) | one.endless[lo:hi, None] | two.endless | met.repeated
        use = each | ((k > 0) & (k < last))
        if met.own:  # parts meet those behind them, and themselves pair by pair
            gap = np.arange(len(two.n)) - np.arange(lo, hi)[:, None]
            use, each = use & (gap >= 0) | (gap == 0), each & (gap >= 0) | (gap == 0)
        some = np.flatnonzero(use.any(axis=0))
        if not len(some):
            continue
        use, each, k = use[:, some], each[:, some], k[:, some]
        size = np.diff(two.start)[some]
        first = np.cumsum(size) - size
        column = np.repeat(two.start[some] - first, size) + np.arange(size.sum())
        square, away = np.zeros((r1 - r0, len(column))), np.empty((r1 - r0, len(column)))
        for axis in range(3):
            np.subtract(one.at[axis, r0:r1, None], two.at[axis, column], out=away)
            away *= away
            square += away
        km = _arcs(square)
        i, j = np.nonzero(use & ~each)
        if len(i):
            total = np.add.reduceat(np.add.reduceat(km, one.start[lo:hi] - r0, axis=0), first, axis=1)
            a, b = i + lo, some[j]
            half = np.maximum(0.0, 0.5 * (p[0][a] * q[2][b] + q[0][b] * p[2][a]) - p[1][a] * q[1][b])
            yield k[i, j], one.of[a], two.of[b], one.n[a] * two.n[b], total[i, j], p[0][a] * q[0][b], half
        if each.any():
            took = np.flatnonzero(np.repeat(np.repeat(each, np.diff(one.start[lo : hi + 1]), axis=0), size, axis=1))
            i, j = np.divmod(took, len(column))
            i, j, d = i + r0, column[j], km.ravel()[took]
            if met.own or met.repeated:
                keep = np.ones(len(i), bool)
                if met.own:
                    keep &= j > i
                if met.repeated:
                    keep &= one.id[i] != two.id[j]
                i, j, d = i[keep], j[keep], d[keep]
            half = one.y[i] - two.y[j]
            half *= 0.5 * half
            told = ~np.isnan(half)
            yield np.searchsorted(edges, d, "right"), one.label[i], two.label[j], None, d, told.astype(float), np.where(told, half, 0.0)


def lag_sums(points: DataFrame, edges: list[float], label: str | None = None) -> DataFrame:
    """(label, whole, k, n, km, m, half) of pairs of (id, lon, lat, y) by half-open lag bin: pairs, their distances, pairs with both values, and half
    their squared differences. Rows that are ``whole`` add up to all pairs, others to the pairs that touch a label."""
    bounds, kinds = [float(e) for e in edges], len(edges) + 1
    schema = f"label {dict(points.dtypes)[label] if label else 'int'}, whole boolean, k int, n bigint, km double, m bigint, half double"

    def summed(code: np.ndarray, labels: int, n: np.ndarray | None, km: np.ndarray, m: np.ndarray, half: np.ndarray) -> np.ndarray:
        return np.array([np.bincount(code, w, labels * kinds) for w in (n, km, m, half)])

    def told(sums: np.ndarray, labels, whole: bool) -> pd.DataFrame:
        used = np.flatnonzero(sums[0])
        used = used[(used % kinds > 0) & (used % kinds < kinds - 1)]
        n, km, m, half = sums[:, used]
        return pd.DataFrame({"label": [labels[k // kinds] for k in used], "whole": whole, "k": used % kinds - 1, "n": n.astype(int), "km": km, "m": m.astype(int), "half": half})

    def run(met: Iterable[Met]) -> Iterator[pd.DataFrame]:
        whole = np.zeros((4, kinds))
        for pair in met:
            codes, names = np.zeros(len(pair.a) + (0 if pair.own else len(pair.b)), np.int64), []
            if label:
                codes, names = pd.factorize(pair.a["label"] if pair.own else pd.concat([pair.a["label"], pair.b["label"]], ignore_index=True))
                codes = np.where(codes < 0, len(names), codes)  # rows without a label count in the whole only
            one = Parts(pair.a, codes[: len(pair.a)])
            two = one if pair.own else Parts(pair.b, codes[len(pair.a) :])
            wide, sums = len(names) + 1, np.zeros((4, (len(names) + 1) * kinds))
            for k, la, lb, n, km, m, half in _lags(pair, one, two, bounds):
                whole += summed(k, 1, n, km, m, half)
                if label:
                    sums += summed(la * kinds + k, wide, n, km, m, half)
                    other = np.flatnonzero(la != lb)
                    sums += summed(lb[other] * kinds + k[other], wide, n if n is None else n[other], km[other], m[other], half[other])
            if label:
                yield told(sums[:, : len(names) * kinds], list(names), False)
        yield told(whole, [None], True)

    rows = points.select("id", "lon", "lat", "y", *([F.col(label).alias("label")] if label else []))
    return Blocks(rows, ("y", "label") if label else ("y",), edges[-1]).fold(run, schema)


def binned(blocks: Blocks, spans: list[tuple[float, float]], bins: int, listed: tuple[float, float] | None = None) -> tuple[list, np.ndarray]:
    """(least, greatest, count) of halves of chords in every used bin, in order, each of some disjoint spans cut into ``bins``; and, sorted, those that lie within ``listed``."""
    low, high = (np.array([s[k] for s in spans], float) for k in (0, 1))
    scale = bins / (high - low) if spans else low

    def run(met: Iterable[Met]) -> Iterator[pd.DataFrame]:
        size = len(spans) * bins
        least, most, n = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.int64)
        for pair in met:
            for straight, _, _ in pair.chunks():
                v = np.sort(straight)
                if listed:
                    some = v[np.searchsorted(v, listed[0], "left") : np.searchsorted(v, listed[1], "right")]
                    if len(some):
                        value, times = np.unique(some, return_counts=True)
                        yield pd.DataFrame({"bin": -1, "least": value, "most": value, "n": times})
                if not size:
                    continue
                if len(spans) > 1:
                    span = np.searchsorted(low, v, "right") - 1
                    inside = (span >= 0) & (v <= high[span])
                    v, span = v[inside], span[inside]
                else:
                    v = v[(v >= low[0]) & (v <= high[0])]
                    span = np.zeros(len(v), np.int64)
                if not len(v):
                    continue
                at = span * bins + np.minimum(bins - 1, ((v - low[span]) * scale[span]).astype(np.int64))
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                last = np.concatenate([first[1:], [len(v)]])
                at = at[first]
                least[at], most[at], n[at] = np.minimum(least[at], v[first]), np.maximum(most[at], v[last - 1]), n[at] + last - first
        used = np.flatnonzero(n)
        yield pd.DataFrame({"bin": used, "least": least[used], "most": most[used], "n": n[used]})

    got = blocks.fold(run, "bin bigint, least double, most double, n bigint")
    value = F.when(F.col("bin") < 0, F.col("least"))  # listed values are told one by one
    got = got.groupBy("bin", value.alias("value")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).toPandas()
    one = got[got["bin"] < 0].sort_values("least")
    rest = got[got["bin"] >= 0].sort_values("least")
    return list(rest[["least", "most", "n"]].itertuples(index=False, name=None)), np.repeat(one["least"].to_numpy(), one["n"].to_numpy(int))


#: Bins of the first pass over all pairs, bins of a later one, and values near the median that are told one by one.
FIRST, LATER, LISTED = 1 << 17, 1 << 18, 1 << 20


def distance_order(points: DataFrame, first: int | None = None, few: int | None = None) -> DataFrame:
    """One row (n, least, median, most, gap, gap_from, gap_to) of the distances of all pairs, as ``geo.ordered_summary`` has it: the value at
    n // 2 of the sorted ones, and the widest gap between neighbours (the first such).

    A gap inside a bin is no wider than the bin's values lie apart, so only bins that spread as wide as the widest gap between bins
    are cut again, in one pass with the median's bin.
    """
    first, few = first or FIRST, few or LISTED
    blocks = Blocks(points.select("id", "lon", "lat"))
    schema = "n bigint, least double, median double, most double, gap double, gap_from double, gap_to double"
    parts, _ = binned(blocks, [(0.0, blocks.top / 2 * (1 + 1e-9) + 1e-15)], first)
    n = sum(p[2] for p in parts)
    if not n:
        return blocks.spark.createDataFrame([], schema)
    rank, own, median = n // 2, parts, None
    while True:
        if median is None:
            for at in own:
                if rank < at[2]:
                    break
                rank -= at[2]
            if at[0] == at[1]:
                median = at[0]
        # two values of a bin are parts of their own
        parts = [q for p in parts for q in ([(p[0], p[0], 1), (p[1], p[1], 1)] if p[2] == 2 and p[0] < p[1] else [p])]
        ends, count = np.array([p[:2] for p in parts]), np.array([p[2] for p in parts])
        far = kilometres(ends)
        gaps, spread = far[1:, 0] - far[:-1, 1], far[:, 1] - far[:, 0]
        widest = int(gaps.argmax()) if len(gaps) else None
        gap = (0.0, math.inf) if widest is None else (gaps[widest], far[widest, 1])
        wide = (count > 2) & (ends[:, 0] < ends[:, 1]) & ((spread > gap[0]) | ((spread == gap[0]) & (far[:, 0] < gap[1])))
        cut = [int(k) for k in np.flatnonzero(wide)]
        if not cut and median is not None:
            break
        cut = sorted(sorted(cut, key=lambda k: -spread[k])[: LATER // 2])
        listed = (at[0], at[1]) if median is None and at[2] <= few else None
        if median is None and listed is None:
            own, _ = binned(blocks, [(at[0], at[1])], first)
            continue
        finer, told = binned(blocks, [tuple(map(float, ends[k])) for k in cut], max(2, LATER // max(1, len(cut))), listed)
        if listed:
            median = float(told[rank])
        gone = set(cut)
        parts = sorted([p for k, p in enumerate(parts) if k not in gone] + finer)
    least, median, most = (float(v) for v in kilometres(np.array([parts[0][0], median, parts[-1][1]])))
    told = (float(gap[0]), float(gap[1]), float(far[widest + 1, 0])) if widest is not None else (0.0, least, least) if n > 1 else (None, None, None)
    return blocks.spark.createDataFrame([(int(n), least, median, most, *told)], schema)
