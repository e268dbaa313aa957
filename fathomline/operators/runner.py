"""Cross-validation over designs and estimators: one long table of predictions, scored by aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import models, validation
from fathomline.runtime import materialise

#: rows (id, lon, lat, y, label, covariates) -> (fold, id, y, prediction, sd, refusal)
Estimator = Callable[[DataFrame], DataFrame]
_OUT = ("fold", "id", "y", "prediction", "sd", "refusal")


def baseline(rows: DataFrame) -> DataFrame:
    """The mean and deviation of the other folds; fewer than two training rows are refused."""
    fit = validation.mean_baseline(rows)
    few = F.when(F.col("train_rows") < 2, F.lit("fewer than two training rows"))
    met = rows.select("id", "y", F.col("label").cast("int").alias("label")).join(fit.withColumn("fold", F.col("fold").cast("int")), F.col("label") == F.col("fold"))
    return met.select("fold", "id", "y", F.when(few.isNull(), F.col("prediction")).alias("prediction"), F.when(few.isNull(), F.col("sd")).alias("sd"), few.alias("refusal"))


def kriging(edges: list[float], min_pairs: int = models.MIN_PAIRS) -> Estimator:
    return lambda rows: models.kriging_cv(rows, edges, min_pairs)


def forest(features: list[str], trees: int = 30) -> Estimator:
    """A quantile forest per fold: each fit is a distributed job of its own."""

    def run(rows: DataFrame) -> DataFrame:
        made = []
        for fold in sorted(r["label"] for r in rows.select("label").distinct().collect()):
            train, test = rows.filter(F.col("label") != fold), rows.filter(F.col("label") == fold)
            got = models.forest_quantiles(train, test.select("id", *features), features, trees=trees).select("id", "prediction", "sd")
            made.append(test.select("id", "y").join(got, "id", "left").select(F.lit(fold).cast("int").alias("fold"), "id", "y", "prediction", "sd", F.lit(None).cast("string").alias("refusal")))
        return reduce(DataFrame.unionByName, made)

    return run


@dataclass
class Registry:
    """Estimators in order; the baseline is mandatory and names are used once."""

    entries: dict[str, Estimator] = field(default_factory=lambda: {"baseline": baseline})

    def add(self, name: str, estimator: Estimator) -> Registry:
        if name in self.entries:
            raise ValueError(f"{name} is registered already")
        self.entries[name] = estimator
        return self


@dataclass(frozen=True)
class Design:
    """A column of fold labels; only a spatially blocked design may support a claim."""

    label: str
    spatially_blocked: bool = False
    required_km: float | None = None


@dataclass(frozen=True)
class Report:
    predictions: DataFrame
    scores: DataFrame
    pooled: DataFrame
    uplift: DataFrame
    refusals: DataFrame
    claims: DataFrame


def cross_validate(rows: DataFrame, designs: dict[str, Design], registry: Registry) -> Report:
    """Every estimator on every fold of every design. A refused fold is recorded, not scored."""
    made = []
    for name, design in designs.items():
        own = rows.withColumn("label", F.col(design.label).cast("int"))
        validation.assert_folds(own)
        if design.required_km is not None:
            validation.assert_separated(own, "label", design.required_km)
        for key, estimator in registry.entries.items():
            made.append(estimator(own).select(*_OUT).withColumns({"design": F.lit(name), "estimator": F.lit(key), "blocked": F.lit(design.spatially_blocked)}))
    table = materialise(reduce(DataFrame.unionByName, made), "cv-predictions")
    broken = table.filter("refusal is null and (prediction is null or sd is null or isnan(prediction) or isnan(sd) or sd < 0)")
    if (bad := broken.first()) is not None:
        raise ValueError(f"{bad['estimator']} gave row {bad['id']} of {bad['design']} no pair of prediction and spread")
    good = table.filter("refusal is null")
    scores = validation.scores(good, ["design", "fold", "estimator"])
    pooled = validation.scores(good, ["design", "estimator"])
    return Report(
        table, validation.long_scores(scores, ["design", "fold", "estimator"]), pooled,
        validation.uplift(scores, ["design", "fold"], "baseline"),
        table.filter("refusal is not null").groupBy("design", "fold", "estimator", "refusal").count(),
        validation.scores(good.filter("blocked"), ["design", "estimator"]),
    )
