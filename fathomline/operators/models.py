"""Variograms, kriging, minimum spanning edges and quantile forests."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.geodesy import EARTH_KM
from fathomline.operators.merge import running_order
from fathomline.operators.pairs import lag_sums
from fathomline.operators.spatial import nearest_points, spanning_by_scales
from fathomline.runtime import materialise, ship, shuffle_width

#: Fitting limits.
MIN_PAIRS = 30
MAX_LAG_KM = 13.0
CANDIDATES = 200
#: Points that one kriging system holds; beyond, each place is kriged from its nearest points.
MOST_POINTS = 4000
NEAREST = 64
#: Buckets of targets in which quantiles of leaves are looked for.
BUCKETS = 256


def lag_bin(km: str, edges: list[float]) -> Column:
    """Which half-open bin a lag within the edges lies in; the lag is named often enough that its plan is not inlined."""
    return reduce(lambda s, t: s + t, ((F.col(km) >= float(e)).cast("int") for e in edges)) - 1


def _every_bin(got: DataFrame, edges: list[float]) -> DataFrame:
    """Bins of (k, pair_count, semivariance, mean_lag_km); empty bins stay, with nulls."""
    bins = got.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lag_lo_km double, lag_hi_km double")
    return bins.join(got, bins["bin"] == got["k"], "left").select(
        "bin", "lag_lo_km", "lag_hi_km", F.coalesce("pair_count", F.lit(0)).cast("bigint").alias("pair_count"), "semivariance", "mean_lag_km"
    )


def variogram_bins(pairs: DataFrame, edges: list[float], km: str = "km", half: str = "half_sq") -> DataFrame:
    """Per half-open lag bin: pair_count, semivariance and mean_lag_km; empty bins stay, with nulls."""
    within = pairs.filter(F.col(km).between(float(edges[0]), float(edges[-1])) & (F.col(km) != float(edges[-1])))
    return _every_bin(within.select(lag_bin(km, edges).alias("k"), km, half).groupBy("k").agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg(half).alias("semivariance"), F.avg(km).alias("mean_lag_km")
    ), edges)


def point_variogram(points: DataFrame, edges: list[float]) -> DataFrame:
    """The bins of ``variogram_bins`` from points (id, lon, lat, y): pairs are folded block by block and never are rows."""
    got = lag_sums(points, edges).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "km", "m", "half")))
    return _every_bin(got.select("k", F.col("n").alias("pair_count"), F.try_divide("half", "m").alias("semivariance"), F.try_divide("km", "n").alias("mean_lag_km")), edges)


def bin_report(bins: DataFrame, max_lag: float = MAX_LAG_KM, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """Adds to each lag bin whether a fit uses it, or why not."""
    status = F.when(F.col("pair_count") == 0, F.lit("no pairs")).when(F.col("lag_hi_km") > max_lag, F.lit("beyond the largest lag"))
    return bins.withColumn("status", status.when(F.col("pair_count") < min_pairs, F.lit("too few pairs")).otherwise(F.lit("fitted")))


def variogram_fit(bins: DataFrame, family: str = "exponential", max_lag: float = MAX_LAG_KM, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """One row: nugget, partial_sill, range_km, sse. Weighted least squares over a grid of ranges.

    Bins are written once, so pairs are not made again for every use of them.

    The bins are a handful of rows; each candidate range is one group of sums, solved in closed
    form with both parts kept from going below zero.
    """
    bins = materialise(bins, "variogram-bins")
    used = bins.filter((F.col("pair_count") >= min_pairs) & (F.col("lag_hi_km") <= max_lag)).select(
        F.col("mean_lag_km").alias("h"), F.col("semivariance").alias("g"), F.col("pair_count").cast("double").alias("w")
    )
    top = used.agg(F.max("h").alias("top"), F.count(F.lit(1)).alias("m")).filter("m >= 3")
    grid = top.select(F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))).alias("c"), "top").select(
        "c", (F.lit(0.05) * F.col("top") * F.pow(F.lit(40.0), F.col("c").cast("double") / F.lit(float(CANDIDATES - 1)))).alias("a")
    )
    if family == "exponential":
        s = 1 - F.exp(-3 * F.col("h") / F.col("a"))
    else:
        ratio = F.least(F.lit(1.0), F.col("h") / F.col("a"))
        s = 1.5 * ratio - 0.5 * F.pow(ratio, 3)
    laid = F.broadcast(grid).join(F.broadcast(used), F.lit(True)).withColumn("s", s)  # some bins times the candidates
    fit = laid.groupBy("c", "a").agg(
        F.sum("w").alias("W"), F.sum(F.col("w") * F.col("s")).alias("S"), F.sum(F.col("w") * F.col("g")).alias("G"),
        F.sum(F.col("w") * F.col("s") * F.col("s")).alias("SS"), F.sum(F.col("w") * F.col("s") * F.col("g")).alias("SG"),
        F.sum(F.col("w") * F.col("g") * F.col("g")).alias("GG"),
    )
    ps = F.try_divide(F.col("W") * F.col("SG") - F.col("S") * F.col("G"), F.col("W") * F.col("SS") - F.col("S") * F.col("S"))
    fit = fit.withColumn("ps0", F.coalesce(ps, F.lit(0.0))).withColumn("n0", (F.col("G") - F.col("ps0") * F.col("S")) / F.col("W"))
    fit = fit.withColumn("ps1", F.when(F.col("n0") < 0, F.greatest(F.lit(0.0), F.coalesce(F.try_divide("SG", "SS"), F.lit(0.0)))).otherwise(F.col("ps0")))
    fit = fit.withColumn("n1", F.greatest(F.col("n0"), F.lit(0.0)))
    fit = fit.withColumns({"nugget": F.when(F.col("ps1") < 0, F.col("G") / F.col("W")).otherwise(F.col("n1")), "ps": F.greatest(F.col("ps1"), F.lit(0.0))})
    n, p = F.col("nugget"), F.col("ps")
    sse = F.col("GG") - 2 * n * F.col("G") - 2 * p * F.col("SG") + n * n * F.col("W") + 2 * n * p * F.col("S") + p * p * F.col("SS")
    best = fit.withColumn("sse", sse).agg(F.min_by(F.struct("nugget", "ps", "a", "sse"), F.struct("sse", "c")).alias("b"))
    return best.filter("b is not null").select(
        F.col("b.nugget").alias("nugget"), F.col("b.ps").alias("partial_sill"),
        F.when(F.col("b.ps") > 0, F.col("b.a")).otherwise(F.lit(0.0)).alias("range_km"), F.col("b.sse").alias("sse"),
    )


def fit_report(bins: DataFrame, fit: DataFrame, points: DataFrame, max_lag: float = MAX_LAG_KM, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """One row on a variogram fit: its parameters, bins used and left out by reason, residual degrees of freedom, whether the range
    stands at the largest candidate or within the first used lag, lags without pairs, and pairs beyond the bins (by closed form)."""
    told = bin_report(bins, max_lag, min_pairs)
    used = F.col("status") == "fitted"
    lag = F.when(F.col("status") == "no pairs", F.struct("lag_lo_km", "lag_hi_km"))
    whole = told.agg(
        F.count_if(used).alias("fitted_bins"), F.count_if(F.col("status") == "no pairs").alias("empty_bins"),
        F.count_if(F.col("status") == "beyond the largest lag").alias("far_bins"), F.count_if(F.col("status") == "too few pairs").alias("thin_bins"),
        (2 * F.max(F.when(used, F.col("mean_lag_km")))).alias("ceiling"), F.min(F.when(used, F.col("lag_hi_km"))).alias("floor"),
        F.sum("pair_count").alias("binned"), F.array_sort(F.collect_list(lag)).alias("gaps"),
    )
    n = points.agg(F.count(F.lit(1)).alias("points"))
    met = fit.join(F.broadcast(whole), F.lit(True)).join(F.broadcast(n), F.lit(True))  # single rows
    structured = F.col("partial_sill") > 0
    return met.select(
        "nugget", "partial_sill", (F.col("nugget") + F.col("partial_sill")).alias("sill"), "range_km", "fitted_bins", "empty_bins", "far_bins", "thin_bins",
        (F.col("fitted_bins") - 3).alias("residual_dof"), (structured & (F.col("range_km") >= F.col("ceiling") * (1 - 1e-12))).alias("range_at_ceiling"),
        (structured & (F.col("range_km") <= F.col("floor"))).alias("range_below_first_lag"),
        F.array_join(F.transform("gaps", lambda g: F.concat_ws("-", g["lag_lo_km"].cast("int").cast("string"), g["lag_hi_km"].cast("int").cast("string"))), ",").alias("unsupported_lags"),
        F.expr("points * (points - 1) div 2 - binned").alias("pairs_outside"),
    )


def gamma(h: np.ndarray, nugget: float, sill: float, reach: float, family: str = "exponential") -> np.ndarray:
    """Semivariance at lags ``h``; 0 at lag 0."""
    if reach <= 0:
        s = np.where(h > 0, 1.0, 0.0)
    elif family == "exponential":
        s = 1 - np.exp(-3 * h / reach)
    else:
        r = np.minimum(1, h / reach)
        s = 1.5 * r - 0.5 * r**3
    return np.where(h > 0, nugget + sill * s, 0.0)


def great_circle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in km between rows (lon, lat) of ``a`` and ``b``."""
    a, b = np.radians(a), np.radians(b)
    x = np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
    x += np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, x)))


def fit_bins(lag: np.ndarray, g: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Nugget, partial sill and range of the exponential model, as ``variogram_fit`` has them."""
    best = (math.inf, 0.0, 0.0, 0.0)
    for a in np.geomspace(0.05 * lag.max(), 2 * lag.max(), CANDIDATES):
        s = 1 - np.exp(-3 * lag / a)
        det = w.sum() * (w * s * s).sum() - (w * s).sum() ** 2
        ps = (w.sum() * (w * s * g).sum() - (w * s).sum() * (w * g).sum()) / det if det else 0.0
        n = ((w * g).sum() - ps * (w * s).sum()) / w.sum()
        if n < 0:
            n, ps = 0.0, max(0.0, (w * s * g).sum() / (w * s * s).sum())
        if ps < 0:
            n, ps = (w * g).sum() / w.sum(), 0.0
        sse = (w * (g - n - ps * s) ** 2).sum()
        if sse < best[0] - 1e-12:
            best = (sse, n, ps, a)
    return best[1], best[2], best[3] if best[2] > 0 else 0.0


class Kriging:
    """Ordinary kriging of one training set. A failed fit raises and leaves nothing behind."""

    def __init__(self, xy: np.ndarray, y: np.ndarray, edges: np.ndarray, min_pairs: int = MIN_PAIRS):
        if len(y) < 3:
            raise ValueError(f"{len(y)} points; three are needed")
        if np.ptp(y) == 0:
            raise ValueError("the target is constant")
        h = great_circle(xy, xy)
        i, j = np.triu_indices(len(y), 1)
        lag, half = h[i, j], 0.5 * (y[i] - y[j]) ** 2
        k = np.digitize(lag, edges) - 1
        bins = [(lag[k == b].mean(), half[k == b].mean(), float((k == b).sum())) for b in range(len(edges) - 1) if (k == b).sum() >= min_pairs]
        if len(bins) < 3:
            raise ValueError(f"{len(bins)} lag bin(s) with {min_pairs} pairs; three are needed")
        self.model = fit_bins(*np.array(bins).T)
        system = np.ones((len(y) + 1, len(y) + 1))
        system[:-1, :-1] = gamma(h, *self.model)
        system[-1, -1] = 0
        try:
            self.inverse = np.linalg.inv(system)
        except np.linalg.LinAlgError as e:
            raise ValueError("the kriging system is singular") from e
        self.xy, self.y = xy, y

    def predict(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = np.ones((len(self.y) + 1, len(xy)))
        right[:-1] = gamma(great_circle(self.xy, xy), *self.model)
        weight = self.inverse @ right
        var = (weight * right).sum(0)
        if (var < -1e-6 * max(1e-12, self.model[0] + self.model[1])).any():
            raise ValueError("a kriging variance is negative")
        return weight[:-1].T @ self.y, np.sqrt(np.maximum(0, var))


def _krige_near(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ordinary kriging of each row from its own points (``around``) by its own model (``model``: nugget, sill, range)."""
    out = np.full((len(frame), 2), np.nan)
    for k, (lon, lat, around, model) in enumerate(zip(frame["lon"], frame["lat"], frame["around"], frame["model"], strict=True)):
        if model is None or len(around) < 3:
            continue
        xy = np.array([(p["lon"], p["lat"]) for p in around])
        system = np.ones((len(xy) + 1, len(xy) + 1))
        system[:-1, :-1] = gamma(great_circle(xy, xy), *model)
        system[-1, -1] = 0
        right = np.append(gamma(great_circle(xy, np.array([[lon, lat]]))[:, 0], *model), 1)
        weight = np.linalg.lstsq(system, right, rcond=None)[0]
        out[k] = weight[:-1] @ np.array([p["y"] for p in around]), math.sqrt(max(0.0, float(weight @ right)))
    return out[:, 0], out[:, 1]


def fold_models(rows: DataFrame, edges: list[float], min_pairs: int) -> DataFrame:
    """(label, model, refusal): the model (nugget, sill, range) of the rows outside each label, or why there is none;
    the row without a label tells of all rows.

    Pairs are summed by lag bin, and by lag bin and each label they touch, block by block: a fold's training pairs are all
    less those that touch it. Every fold is fitted from its bins on its own, so folds may be as many as rows.
    """
    sums = materialise(lag_sums(rows, edges, "label"), "lag-sums")
    add = [F.sum(c).alias(c) for c in ("n", "km", "half")]
    touched = sums.filter("not whole").groupBy("label", "k").agg(*add)
    folds = rows.groupBy("label").agg(F.count("y").alias("rows"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    # the least and greatest value outside a label are those of the first two labels by either
    ends = folds.agg(F.sum("rows").alias("all"))
    low = [tuple(r) for r in folds.select("lo", "label").orderBy("lo", "label").limit(2).collect()]
    high = [tuple(r) for r in folds.select("hi", "label").orderBy(F.desc("hi"), "label").limit(2).collect()]
    total = int(ends.first()["all"] or 0)
    whole = {r["k"]: (r["n"], r["km"], r["half"]) for r in sums.filter("whole").groupBy("k").agg(*add).collect()}  # a row a bin

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        label = None if pd.isna(key[0]) else key[0]
        n = total - int(frame["rows"].iloc[0])
        lag = np.array([whole.get(k, (0, 0.0, 0.0)) for k in range(len(edges) - 1)], float)
        for k, *less in frame.loc[frame["k"].notna(), ["k", "n", "km", "half"]].itertuples(index=False):
            lag[int(k)] -= less
        bins = [(km / c, half / c, c) for c, km, half in lag if c >= min_pairs]
        rest = [next((v for v, own in side if own != label), None) for side in (low, high)]
        model, why = None, None
        if n < 3:
            why = f"{n} points; three are needed"
        elif rest[0] == rest[1]:
            why = "the target is constant"
        elif len(bins) < 3:
            why = f"{len(bins)} lag bin(s) with {min_pairs} pairs; three are needed"
        else:
            model = list(map(float, fit_bins(*np.array(bins).T)))
        return pd.DataFrame({"label": [label], "model": [model], "refusal": [why]})

    kind = dict(rows.dtypes)["label"]
    every = folds.select(F.lit(None).cast(kind).alias("label"), F.lit(0).cast("bigint").alias("rows")).limit(1)
    laid = folds.select("label", "rows").unionAll(every).join(touched, "label", "left")
    return laid.groupBy("label").applyInPandas(fit, f"label {kind}, model array<double>, refusal string")


def kriging_cv(rows: DataFrame, edges: list[float], min_pairs: int = MIN_PAIRS, *, most: int = MOST_POINTS, near: int = NEAREST) -> DataFrame:
    """(fold, id, y, prediction, sd, refusal) of (id, lon, lat, y, label): each fold kriged from the others.

    Up to ``most`` rows, training rows are laid out by fold through an equi-join on a table of folds, so each fold is one
    group of bounded size. Beyond, each row is kriged from the ``near`` rows of other folds that are nearest to it, with
    its fold's own model. A fold that cannot be fitted gives its rows a named refusal.
    """
    ship(rows.sparkSession)
    grid = np.array(edges)
    schema = "fold int, id bigint, y double, prediction double, sd double, refusal string"
    if rows.count() > most:
        around = nearest_points(rows.select("id", "lon", "lat", "y", "label"), rows, near, "label")
        laid = around.join(fold_models(rows, edges, min_pairs), "label")

        def local(frames):
            for frame in frames:
                p, sd = _krige_near(frame)
                yield pd.DataFrame({"fold": frame["label"], "id": frame["id"], "y": frame["y"], "prediction": p, "sd": sd, "refusal": frame["refusal"]})

        return laid.mapInPandas(local, schema)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        test = frame[frame["label"] == frame["fold"]]
        train = frame[frame["label"] != frame["fold"]]
        out = pd.DataFrame({"fold": test["fold"], "id": test["id"], "y": test["y"], "prediction": np.nan, "sd": np.nan, "refusal": None})
        try:
            model = Kriging(train[["lon", "lat"]].to_numpy(), train["y"].to_numpy(), grid, min_pairs)
            out["prediction"], out["sd"] = model.predict(test[["lon", "lat"]].to_numpy())
        except ValueError as e:
            out["refusal"] = str(e)
        return out

    folds = sorted(r["label"] for r in rows.select("label").distinct().collect())
    dealt = rows.select("id", "lon", "lat", "y", "label", F.explode(F.array(*(F.lit(f) for f in folds))).alias("fold"))
    return dealt.groupBy("fold").applyInPandas(one, schema)


def kriging_surface(
    train: DataFrame, cells: DataFrame, edges: list[float], min_pairs: int = MIN_PAIRS, *, most: int = MOST_POINTS, near: int = NEAREST
) -> DataFrame:
    """Adds prediction and sd to cells (with lon, lat).

    Up to ``most`` points, one task fits the system and all use it. Beyond, each cell is kriged from its ``near`` nearest
    points, with the model of all of them.
    """
    spark = cells.sparkSession
    ship(spark)
    grid = np.array(edges)
    kinds = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
    points = train.select("id", "lon", "lat", "y")
    if points.count() > most:
        made = fold_models(points.withColumn("label", F.lit(0)), edges, min_pairs).filter("label is null").first()
        if made["model"] is None:
            raise ValueError(made["refusal"])
        numbered = materialise(cells.withColumn("_cell", F.monotonically_increasing_id()), "krige-cells")
        # cells at one place have one prediction
        at = materialise(numbered.groupBy("lon", "lat").agg(F.min("_cell").alias("id")), "krige-places")
        around = nearest_points(at, points, near)
        laid = around.withColumn("model", F.array(*(F.lit(float(v)) for v in made["model"])))

        def local(frames):
            for frame in frames:
                p, sd = _krige_near(frame)
                yield pd.DataFrame({"_cell": frame["id"], "prediction": p, "sd": sd})

        made = laid.repartition(shuffle_width(spark), "id").mapInPandas(local, "_cell bigint, prediction double, sd double")
        named = at.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.col("id").alias("_cell")).join(made, "_cell").drop("_cell")
        same = F.col("lon").eqNullSafe(F.col("_lon")) & F.col("lat").eqNullSafe(F.col("_lat"))
        return numbered.join(named, same).drop("_cell", "_lon", "_lat")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        made = Kriging(frame[["lon", "lat"]].to_numpy(), frame["y"].to_numpy(), grid, min_pairs)
        return pd.DataFrame({"model": [pickle.dumps(made)]})

    row = points.groupBy(F.lit(1).alias("all")).applyInPandas(fit, "model binary").first()
    if row is None:
        raise ValueError("0 points; three are needed")
    shared = spark.sparkContext.broadcast(bytes(row["model"]))

    def run(frames):
        fitted = pickle.loads(shared.value)
        for frame in frames:
            p, sd = fitted.predict(frame[["lon", "lat"]].to_numpy()) if len(frame) else (np.zeros(0), np.zeros(0))
            yield frame.assign(prediction=p, sd=sd)

    return cells.mapInPandas(run, f"{kinds}, prediction double, sd double")


def mst_edges(points: DataFrame, group: str, most: int = MOST_POINTS) -> DataFrame:
    """(group, a, b, km): minimum spanning edges within each group of (id, lon, lat).

    A group of at most ``most`` points is solved in one task, a larger one scale by scale over cells.
    """
    ship(points.sparkSession)
    large = materialise(points.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "mst-large")
    same = F.col(group).eqNullSafe(F.col("_g"))
    more = spanning_by_scales(points.join(large, same, "left_semi"), group) if large.head(1) else None
    points = points.join(large, same, "left_anti")

    def prim(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        xy, ids = frame[["lon", "lat"]].to_numpy(), frame["id"].to_numpy()
        near, to = np.full(len(ids), np.inf), np.zeros(len(ids), int)
        out, at, left = [], 0, np.ones(len(ids), bool)
        left[0] = False
        while left.any():
            d = great_circle(xy[at : at + 1], xy)[0]
            closer = left & (d < near)
            near[closer], to[closer] = d[closer], at
            at = int(np.where(left, near, np.inf).argmin())
            left[at] = False
            out.append((frame[group].iloc[0], min(ids[at], ids[to[at]]), max(ids[at], ids[to[at]]), near[at]))
        return pd.DataFrame(out, columns=[group, "a", "b", "km"])

    kind = dict(points.dtypes)[group]
    small = points.groupBy(group).applyInPandas(prim, f"{group} {kind}, a bigint, b bigint, km double")
    return small if more is None else small.unionByName(more)


def pooled_quantiles(held: DataFrame, asked: DataFrame, trees: int) -> DataFrame:
    """(id, prediction, q16, q84, sd) from leaves of training rows (tree, leaf, y) and of asked rows (id, tree, leaf).

    A training row weighs 1 / leaf size in each tree. Asked rows that share all their leaves share one distribution, which is made
    once. Its quantiles are looked for in two steps: targets lie in buckets, whose weights by leaf are few, and only the bucket that
    holds a quantile is read off target by target.
    """
    held = materialise(held.groupBy("tree", "leaf", "y").agg(F.count(F.lit(1)).alias("n")), "leaf-values")
    size = held.groupBy("tree", "leaf").agg(F.sum("n").alias("size"), F.sum(F.col("y") * F.col("n")).alias("total"))
    named = asked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tree", "leaf"))).alias("leaves"))  # a leaf a tree
    named = materialise(named, "leaf-asked")
    sets = materialise(named.select("leaves").distinct().withColumn("set", F.monotonically_increasing_id()), "leaf-sets")
    parts = sets.select("set", F.explode("leaves").alias("at")).select("set", "at.tree", "at.leaf")
    mean = parts.join(size, ["tree", "leaf"]).groupBy("set").agg(F.sum(F.col("total") / F.col("size") / trees).alias("prediction"))

    steps = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = held.agg(F.percentile_approx(F.col("y").cast("double"), steps, 10_000).alias("cuts")).first()["cuts"] or []
    weigh = held.join(size, ["tree", "leaf"]).select("tree", "leaf", "y", F.col("y").cast("double").alias("_v"), (F.col("n") / F.col("size") / trees).alias("w"))
    known = Bucketizer(splits=[-math.inf, *sorted(set(cuts)), math.inf], inputCol="_v", outputCol="bucket").transform(weigh.filter("_v is not null"))
    weigh = known.unionByName(weigh.filter("_v is null").withColumn("bucket", F.lit(-1.0))).drop("_v")  # what has no target comes first
    weigh = materialise(weigh, "leaf-weights")
    coarse = parts.join(weigh.groupBy("tree", "leaf", "bucket").agg(F.sum("w").alias("w")), ["tree", "leaf"]).groupBy("set", "bucket").agg(F.sum("w").alias("w"))
    coarse = coarse.withColumn("c", F.sum("w").over(Window.partitionBy("set").orderBy("bucket"))).filter("bucket >= 0")
    found = []
    for q in (0.16, 0.84):
        first = F.min(F.when(F.col("c") >= q - 1e-12, F.struct("bucket", (F.col("c") - F.col("w")).alias("before")))).alias("b")
        found.append(coarse.groupBy("set").agg(first).filter("b is not null").select("set", F.lit(q).alias("q"), "b.bucket", "b.before"))
    asked_for = reduce(DataFrame.unionAll, found)
    fine = asked_for.join(parts, "set").join(weigh, ["tree", "leaf", "bucket"]).groupBy("set", "q", "before", "y").agg(F.sum("w").alias("w"))
    fine = fine.withColumn("c", F.col("before") + F.sum("w").over(Window.partitionBy("set", "q").orderBy("y")))
    # sums of a bucket and of its targets may differ in the last digit
    value = F.coalesce(F.min(F.when(F.col("c") >= F.col("q") - 1e-12, F.col("y"))), F.max("y"))
    read = fine.groupBy("set", "q").agg(value.alias("v")).groupBy("set").agg(F.max(F.when(F.col("q") < 0.5, F.col("v"))).alias("q16"), F.max(F.when(F.col("q") > 0.5, F.col("v"))).alias("q84"))
    told = mean.join(read, "set", "left").join(sets, "set")
    out = named.join(told, "leaves").select("id", "prediction", "q16", "q84")
    return out.withColumn("sd", (F.col("q84") - F.col("q16")) / 2)


def forest_report(train: DataFrame, predicted: DataFrame, features: list[str]) -> DataFrame:
    """One row on a forest: training rows, distinct feature rows, quantiles of the target, and predictions without a spread."""
    q = F.percentile_approx("y", [0.0, 0.16, 0.5, 0.84, 1.0], 10_000)
    fit = train.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*features)).alias("distinct_rows"), q.alias("quantiles"))
    flat = predicted.agg(F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("sd") == 0).alias("without_spread"))
    return fit.join(F.broadcast(flat), F.lit(True))  # two single rows


def forest_quantiles(train: DataFrame, test: DataFrame, features: list[str], *, trees: int = 30, depth: int = 8, seed: int = 0) -> DataFrame:
    """(id, prediction, q16, q84, sd) of a quantile forest, pooled by the leaves that rows share."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    join_up = VectorAssembler(inputCols=features, outputCol="_x")
    laid = join_up.transform(train)
    forest = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, leafCol="_leaf", minInstancesPerNode=3)
    model = forest.fit(laid)

    def leaves(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))

    asked = leaves(model.transform(join_up.transform(test)), "id")
    return pooled_quantiles(leaves(model.transform(laid), "y"), asked, trees)


def permuted(rows: DataFrame, features: list[str], seeds: list[int]) -> DataFrame:
    """(seed, feature, id, y, features): every row once for each seed and feature, with that feature's value taken from another row.

    A seed's order of rows by hash against their order by id is a permutation: row k takes the value of the k-th by hash. Both orders
    come from range ranks, so no task sorts all rows, and all seeds and features are one join.
    """
    own = running_order(rows.select("id", "y", *features), ["id"])
    donors = []
    for seed in seeds:
        drawn = rows.select("id", *(F.col(f).alias(f"_{f}") for f in features)).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
        donors.append(running_order(drawn, ["_h", "id"]).select("seq", F.lit(seed).alias("seed"), *(f"_{f}" for f in features)))
    met = own.join(reduce(DataFrame.unionAll, donors), "seq")
    taken = [F.struct(F.lit(f).alias("feature"), *(F.col(f"_{g}" if g == f else g).alias(g) for g in features)) for f in features]
    return met.select("seed", "id", "y", F.explode(F.array(*taken)).alias("t")).select("seed", "id", "y", "t.*")


def permutation_importance(rows: DataFrame, features: list[str], predict: Callable[[DataFrame], DataFrame], seeds: list[int]) -> DataFrame:
    """(feature, seed, rmse, loss): how much worse ``predict`` (which adds prediction) does with one feature permuted than with none."""
    error = (F.col("prediction") - F.col("y")) * (F.col("prediction") - F.col("y"))
    base = predict(rows.select("id", "y", *features)).agg(F.sqrt(F.avg(error)).alias("base"))
    got = predict(permuted(rows, features, seeds)).groupBy("feature", "seed").agg(F.sqrt(F.avg(error)).alias("rmse"))
    return got.join(F.broadcast(base), F.lit(True)).select("feature", "seed", "rmse", (F.col("rmse") - F.col("base")).alias("loss"))  # one row


def importance_spread(importance: DataFrame) -> DataFrame:
    """(feature, place, mean_loss, least, most): features by their mean loss over seeds, and how far seeds differ."""
    told = importance.groupBy("feature").agg(F.avg("loss").alias("mean_loss"), F.min("loss").alias("least"), F.max("loss").alias("most"))
    place = F.row_number().over(Window.orderBy(F.desc("mean_loss"), "feature"))  # a row a feature
    return told.select("feature", place.alias("place"), "mean_loss", "least", "most")


def forest_importance(train: DataFrame, test: DataFrame, features: list[str], seeds: list[int], *, trees: int = 30, depth: int = 8) -> DataFrame:
    """(feature, seed, rmse, loss, impurity) of a forest: permutation loss on ``test``, and the share of the fit's impurity, for forests of several seeds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    join_up = VectorAssembler(inputCols=features, outputCol="_x")
    laid, out = join_up.transform(train), []
    for seed in seeds:
        fitted = RandomForestRegressor(featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3).fit(laid)
        shares = train.sparkSession.createDataFrame(list(zip(features, map(float, fitted.featureImportances.toArray()), strict=True)), "feature string, impurity double")
        got = permutation_importance(test, features, lambda df, m=fitted: m.transform(join_up.transform(df)), [seed])
        out.append(got.join(F.broadcast(shares), "feature"))
    return reduce(DataFrame.unionByName, out)
