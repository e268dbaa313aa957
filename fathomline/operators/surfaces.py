"""Comparisons and selections on a common grid of cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Rows go south from ``north``, columns east from ``west``; cells are ``step`` degrees wide."""

    west: float
    north: float
    step: float


def resample(cells: DataFrame, value: str, source: Grid, target: Grid) -> DataFrame:
    """(i, j, value, covered) of the target's cells that the source's meet: means weighted by overlap, and the share of the cell that has values.

    Grids may differ in width and origin. A source cell is sent to the target cells it overlaps, a number that the ratio of
    widths bounds; overlaps are products of two lengths, and sums are partial before they are shuffled.
    """

    def ends(index: Column, first: float) -> tuple[Column, Column]:
        low = (index * source.step + first) / target.step
        return low, low + source.step / target.step

    y0, y1 = ends(F.col("i"), target.north - source.north)
    x0, x1 = ends(F.col("j"), source.west - target.west)
    meets = lambda low, high: F.explode(F.sequence(F.floor(low + 1e-9), F.ceil(high - 1e-9) - 1))
    laid = cells.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.col(value).cast("double").alias("v"), y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")
    )
    laid = laid.withColumn("r", meets(F.col("y0"), F.col("y1"))).withColumn("c", meets(F.col("x0"), F.col("x1")))
    share = lambda low, high, at: F.least(F.col(high), F.col(at) + 1) - F.greatest(F.col(low), F.col(at))
    weighed = laid.withColumn("w", share("y0", "y1", "r") * share("x0", "x1", "c")).filter("w > 0")
    out = weighed.groupBy(F.col("r").cast("int").alias("i"), F.col("c").cast("int").alias("j")).agg(F.sum("w").alias("covered"), F.sum(F.col("w") * F.col("v")).alias("s"))
    return out.select("i", "j", (F.col("s") / F.col("covered")).alias(value), "covered")


def classify(value: Column, breaks: list[float], names: list[str]) -> Column:
    """The band of a value: ``names`` in order, each from one break (inclusive) to the next; null without a value."""
    if len(names) != len(breaks) + 1 or sorted(breaks) != list(breaks):
        raise ValueError("bands need one name more than breaks, and breaks in order")
    band = F.lit(names[0])
    for least, name in zip(breaks, names[1:], strict=True):
        band = F.when(value >= least, F.lit(name)).otherwise(band)
    return F.when(value.isNotNull(), band)


def agreement(one: DataFrame, other: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """One row: cells in common, correlation, mean difference and rmse of two surfaces."""
    d = F.col(a) - F.col(b)
    return one.select(*on, a).join(other.select(*on, b), on).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).alias("cells"), F.corr(a, b).alias("spatial_correlation"), F.avg(d).alias("mean_difference"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def minable(cells: DataFrame, metric: Column, cutoff: float, max_slope: float, excluded: Column | None = None) -> DataFrame:
    """Cells at or above the cutoff, no steeper than allowed and not excluded; a null slope is not minable."""
    out = cells.filter((metric >= cutoff) & (F.col("slope") <= max_slope))
    return out if excluded is None else out.filter(~F.coalesce(excluded, F.lit(False)))


def difference(strategic: DataFrame, market: DataFrame, on: list[str]) -> DataFrame:
    """Cells of the first scenario that the second does not take."""
    return strategic.join(market.select(*on), on, "left_anti")


def area_km2(cells: DataFrame) -> Column:
    return F.sum(F.col("dx") * F.col("dy")) / 1e6
