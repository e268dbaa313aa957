"""Folds, baseline fits, scoring metrics and comparisons, all as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.merge import running_order
from fathomline.operators.spatial import nearest_of_labels


def random_folds(points: DataFrame, k: int, seed: int) -> DataFrame:
    """Seeded folds of near-equal size: round robin in the order of md5(seed, id), through range ranks."""
    drawn = points.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    return running_order(drawn, ["_h"]).withColumn("label", (F.col("seq") % k).cast("int")).drop("_h", "seq")


def fold_separation(points: DataFrame, label: str, reach: float) -> DataFrame:
    """Smallest distance between a fold's test rows and its training rows, where below ``reach`` km.

    Folds without a training row within reach have a null distance: they are separated by at least ``reach``.
    """
    return fold_distance(points, label).withColumn("min_km", F.when(F.col("min_km") <= reach, F.col("min_km")))


def fold_distance(points: DataFrame, label: str, reach: float | None = None) -> DataFrame:
    """Smallest distance between a fold's test rows and its training rows, however far; null only without a training row.

    ``reach`` is no bound, and no longer where the search begins: cells of folds are cut until few pairs of them are left.
    """
    near = nearest_of_labels(points, label).select(F.col("label").alias("fold"), F.col("km").alias("min_km"))
    return points.groupBy(F.col(label).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows")).join(near, "fold", "left")


def mean_baseline(rows: DataFrame, label: str = "label", y: str = "y") -> DataFrame:
    """Leave-fold-out mean and sample deviation: totals less the fold's sums, so one aggregate fits all folds."""
    centre = rows.agg(F.avg(y).alias("m")).first()["m"] or 0.0
    v = F.col(y) - F.lit(centre)
    part = rows.groupBy(F.col(label).alias("fold")).agg(F.count(y).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    # the few rows of the fold table are summed up in a second aggregate
    total = part.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    out = part.join(F.broadcast(total), F.lit(True))
    n, s, q = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tq") - F.col("q")
    return out.select(
        "fold", n.alias("train_rows"), (F.when(n > 0, s / n) + F.lit(centre)).alias("prediction"),
        F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).alias("sd"),
    )


METRICS = ("rmse", "mae", "mean_error", "coverage_1sigma", "standardized_rmse", "r2_pooled")


def scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """Metrics of (y, prediction, sd) by group, each null where it is undefined.

    standardized_rmse: an sd of about 0 with no error counts as 0, with an error it makes the value
    null and is counted. r2_pooled: null below two rows or without spread.
    """
    e = F.col("prediction") - F.col("y")
    tiny = 1e-9 * F.greatest(F.abs(F.col("y")), F.abs(F.col("prediction")))
    zero, exact = F.col("sd") <= tiny, F.abs(e) <= tiny
    z = F.when(zero, F.lit(0.0)).otherwise(F.try_divide(e, F.col("sd")))
    keyed = rows.withColumns({"_e": e, "_in": (F.abs(e) <= F.greatest(F.col("sd"), tiny)).cast("double"), "_z": z, "_bad": (zero & ~exact).cast("int"), "_zero": zero.cast("int")})
    out = keyed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.abs("_e")).alias("mae"),
        F.avg("_e").alias("mean_error"),
        F.avg("_in").alias("coverage_1sigma"),
        F.sum("_zero").cast("bigint").alias("n_sd_zero"),
        F.sum("_bad").cast("bigint").alias("n_sd_zero_wrong"),
        F.sqrt(F.avg(F.when(F.col("_bad") == 0, F.col("_z") * F.col("_z")))).alias("standardized_finite"),
        F.var_pop("y").alias("_var"), F.max("y").alias("_hi"), F.min("y").alias("_lo"), F.sum(F.col("_e") * F.col("_e")).alias("_sse"),
    )
    spread = (F.col("n") >= 2) & (F.col("_hi") > F.col("_lo"))
    return out.withColumns(
        {
            "standardized_rmse": F.when(F.col("n_sd_zero_wrong") == 0, F.col("standardized_finite")),
            "r2_pooled": F.when(spread, 1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))),
        }
    ).drop("_var", "_hi", "_lo", "_sse")


def long_scores(wide: DataFrame, by: list[str]) -> DataFrame:
    """One row per group and metric: (metric, value, status, n); a null value never has status ok."""
    made = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))
    return wide.select(*by, "n", F.explode(made).alias("m")).select(
        *by, "m.metric", "m.value", F.when(F.col("m.value").isNull(), F.lit("undefined")).otherwise(F.lit("ok")).alias("status"), "n"
    )


def uplift(table: DataFrame, by: list[str], baseline: str, estimator: str = "estimator") -> DataFrame:
    """Each estimator's rmse against the baseline's of the same group: difference and ratio."""
    base = table.filter(F.col(estimator) == baseline).select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("rmse").alias("baseline_rmse"), F.col("n").alias("_bn"))
    on = [F.col(c) == F.col(f"_b_{c}") for c in by]
    met = table.filter(F.col(estimator) != baseline).join(base, on)
    same = F.col("n") == F.col("_bn")
    return met.select(
        *by, estimator, "rmse", "baseline_rmse",
        F.when(same, F.col("baseline_rmse") - F.col("rmse")).alias("rmse_uplift"),
        F.when(same, F.try_divide(F.col("rmse"), F.when(F.col("baseline_rmse") != 0, F.col("baseline_rmse")))).alias("rmse_ratio"),
    )


def assert_folds(rows: DataFrame, label: str = "label") -> None:
    """Every row has one fold and there are two folds at least; names what is wrong otherwise."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("m"), F.count_distinct(label).alias("k"), F.count_distinct("id").alias("d")).first()
    if got["m"] != got["n"]:
        raise ValueError(f"{got['n'] - got['m']} rows have no fold")
    if got["d"] != got["n"]:
        raise ValueError(f"{got['n'] - got['d']} rows are tested more than once")
    if got["k"] < 2:
        raise ValueError(f"{got['k']} fold(s); two are needed")


def assert_separated(points: DataFrame, label: str, required_km: float) -> None:
    """Refuses a design with a training row nearer than required to a test row."""
    near = fold_separation(points, label, required_km).filter(F.col("min_km") < required_km).orderBy("min_km").first()
    if near is not None:
        raise ValueError(f"fold {near['fold']}: a training row is {near['min_km']:.3f} km from a test row; {required_km} km are required")


def leakage(points: DataFrame, label: str, recorded: DataFrame, required_km: float, tolerance_km: float = 1e-6) -> DataFrame:
    """(fold, recorded_km, measured_km, verdict): distances that a design recorded (fold, min_km) against what is measured anew.

    ``too near``: a training row is nearer than required; ``not as recorded``: the two differ, or one of them is missing; else ``ok``.
    """
    measured = fold_distance(points, label, max(required_km, 1.0)).select("fold", F.col("min_km").alias("measured_km"))
    told = recorded.select(F.col("fold").alias("_fold"), F.col("min_km").alias("recorded_km"))
    met = measured.join(told, F.col("fold").eqNullSafe(F.col("_fold")), "full_outer")
    same = F.coalesce(F.abs(F.col("recorded_km") - F.col("measured_km")) <= tolerance_km, F.lit(False))
    verdict = F.when(F.col("measured_km") < required_km, F.lit("too near")).when(~same, F.lit("not as recorded")).otherwise(F.lit("ok"))
    return met.select(F.coalesce("fold", "_fold").alias("fold"), "recorded_km", "measured_km", verdict.alias("verdict"))


def assert_recorded(points: DataFrame, label: str, recorded: DataFrame, required_km: float) -> None:
    """Refuses a design whose folds are nearer than required, or not as far apart as it recorded."""
    bad = leakage(points, label, recorded, required_km).filter("verdict <> 'ok'").orderBy("fold").first()
    if bad is not None:
        raise ValueError(f"fold {bad['fold']}: {bad['verdict']} (recorded {bad['recorded_km']}, measured {bad['measured_km']}, required {required_km} km)")


def linkage_folds(clusters: DataFrame, min_blocks: int) -> DataFrame:
    """(label, test_rows, train_rows) of folds that hold out one linked component each; fewer than ``min_blocks`` are refused."""
    part = clusters.groupBy(F.col("cluster").alias("label")).agg(F.count(F.lit(1)).alias("test_rows"))
    total = part.agg(F.sum("test_rows").alias("n"), F.count(F.lit(1)).alias("blocks"))
    enough = F.assert_true(F.col("blocks") >= min_blocks, F.lit(f"fewer than {min_blocks} blocks"))
    whole = total.select("n", enough.alias("ok"))  # one row
    return part.join(F.broadcast(whole), F.col("ok").isNull()).select("label", "test_rows", (F.col("n") - F.col("test_rows")).alias("train_rows"))


def stability_interval(edges: DataFrame, linkage_km: float) -> DataFrame:
    """One row (largest spanning edge up to the linkage, smallest beyond it): between them the components stay as they are."""
    return edges.agg(
        F.max(F.when(F.col("km") <= linkage_km, F.col("km"))).alias("holds_from"), F.min(F.when(F.col("km") > linkage_km, F.col("km"))).alias("holds_to")
    )
