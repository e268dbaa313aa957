"""Fan-out, per-class normalisation, screening, eligibility and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fathomline.runtime import materialise

#: Screening bounds (inclusive).
BOUNDS = {
    "abundance_kg_m2": (0.0, 45.0), "mn_pct": (10.0, 45.0), "ni_pct": (0.3, 2.0), "cu_pct": (0.2, 2.0), "co_pct": (0.02, 0.5),
}
#: Hard ranges of validation (inclusive).
RANGES = {
    "longitude": (-180.0, 180.0), "latitude": (-90.0, 90.0), "water_depth_m": (0.0, 7000.0), "sampled_area_m2": (0.0, None),
    "nodule_mass_kg": (0.0, None), "abundance_kg_m2": (0.0, 100.0), "nodule_count": (0, None), "nodule_density_m2": (0.0, None),
    "mean_nodule_mass_g": (0.0, None), "visible_cover_percent": (0.0, 100.0), "mn_pct": (0.0, 60.0), "ni_pct": (0.0, 5.0),
    "cu_pct": (0.0, 5.0), "co_pct": (0.0, 2.0),
}
#: Members of the enumerations.
CLASSES = ("MASS", "COUNT", "COVER", "GRID", "GRADE")
GRADES = ("A", "B", "C")
STATUSES = ("pending", "pass", "fail", "flagged")
READY_UNITS = ("kg_m2", "kg/m2")

#: Derivation formulas.
_ALREADY = "abundance_kg_m2 = abundance_value_original (already kg/m2)"
_DIVIDED = "abundance_kg_m2 = nodule_mass_kg / sampled_area_m2"
_COUNTED = "abundance_kg_m2 = nodule_density_m2 * mean_nodule_mass_g / 1000 (count->mass is an assumption; see quality_grade)"


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def fan_out(rows: DataFrame, source: str, ordinal: str, classes: dict[str, str], keep: list[str]) -> DataFrame:
    """One record per evidence class whose presence column is not null.

    Ids read source, class and the six-digit ordinal. A single projection and explode: no shuffle.
    """
    made = F.array(*(F.struct(F.lit(c).alias("evidence_class"), F.col(p).cast("double").alias("measured")) for c, p in classes.items()))
    return (
        rows.select(ordinal, *keep, F.explode(F.filter(made, lambda r: r["measured"].isNotNull())).alias("r"))
        .select(ordinal, *keep, "r.*")
        .withColumn("source_record_id", F.format_string(f"{source}_%s_%06d", F.lower("evidence_class"), ordinal))
    )


def normalise(records: DataFrame) -> DataFrame:
    """Abundance, basis, grade, origin and derivation by evidence class, in one projection.

    A grade or basis that is missing is defaulted; an explicit null counts as missing (no source
    maps one). Areas that are not positive make a MASS row fail.
    """
    unit = F.lower(F.trim(F.col("abundance_unit_original")))
    mass, area = F.col("nodule_mass_kg"), F.col("sampled_area_m2")
    value = F.col("abundance_value_original")
    grade, basis, formula = _column(records, "quality_grade"), _column(records, "abundance_basis"), _column(records, "derivation_formula")
    is_ = {c: F.col("evidence_class") == c for c in CLASSES}
    ready = is_["MASS"] & F.coalesce(unit.isin(*READY_UNITS), F.lit(False)) & value.isNotNull()
    divides = is_["MASS"] & ~ready & mass.isNotNull() & F.coalesce(area > 0, F.lit(False))
    counts = is_["COUNT"] & F.col("nodule_density_m2").isNotNull() & F.col("mean_nodule_mass_g").isNotNull()
    abundance = (
        F.when(ready | is_["GRID"], value)
        .when(divides, F.try_divide(mass, area))
        .when(counts, F.col("nodule_density_m2") * F.col("mean_nodule_mass_g") / 1000)
    )
    given = (
        F.when(ready | divides, F.lit("A")).when(counts | is_["COVER"] | is_["GRADE"], F.lit("B")).when(is_["GRID"], F.lit("C"))
    )
    step = F.when(ready, F.lit(_ALREADY)).when(divides, F.lit(_DIVIDED)).when(counts, F.lit(_COUNTED))
    unknown = ~F.coalesce(F.col("evidence_class").isin(*CLASSES), F.lit(False))
    checked = F.when(unknown, F.raise_error(F.concat(F.lit("unknown evidence class: "), F.coalesce("evidence_class", F.lit("null")))))
    return records.withColumns(
        {
            "abundance_kg_m2": F.coalesce(checked.cast("double"), abundance),
            "quality_grade": F.coalesce(grade, given),
            "abundance_basis": F.coalesce(basis, F.when(ready, F.lit("unknown"))),
            "derivation_formula": F.when(step.isNotNull(), F.concat_ws("; ", formula, step)).otherwise(formula),
            "observation_or_prediction": F.when(is_["GRID"], F.lit("compiled")).otherwise(_column(records, "observation_or_prediction")),
            "qa_status": F.when(is_["MASS"] & (area <= 0), F.lit("fail")).otherwise(F.col("qa_status")),
        }
    )


def screen(records: DataFrame, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Flag values beyond the bounds; never drop, never soften a fail."""
    outside = F.lit(False)
    for name, (low, high) in (bounds or BOUNDS).items():
        if name in records.columns:
            outside = outside | F.coalesce((F.col(name) < low) | (F.col(name) > high), F.lit(False))
    open_ = F.col("qa_status").isNull() | F.col("qa_status").isin("pending", "pass")
    return records.withColumn("qa_status", F.when(outside & open_, F.lit("flagged")).otherwise(F.col("qa_status")))


def eligible(records: DataFrame) -> DataFrame:
    """Rows that may train: MASS with a value, open, neither failed nor flagged. Zero is a value."""
    return records.filter(
        (F.col("evidence_class") == "MASS") & F.col("abundance_kg_m2").isNotNull() & F.col("is_open") & ~F.col("qa_status").isin("fail", "flagged")
    )


def violations(records: DataFrame) -> Column:
    """Sorted names of the rules a row breaks: ranges, enumerations and rules across fields."""
    has = records.columns
    found = []
    for name, (low, high) in RANGES.items():
        if name in has:
            bad = (F.col(name) < low) if high is None else ~F.col(name).between(low, high)
            found.append(F.when(bad, F.lit(f"range:{name}")))
    for name, members in (("evidence_class", CLASSES), ("quality_grade", GRADES), ("qa_status", STATUSES)):
        if name in has:
            found.append(F.when(~F.col(name).isin(*members), F.lit(f"enum:{name}")))
    for name, pattern in (("source_record_id", r"^[A-Za-z0-9_\-]+$"), ("source_id", r"^src_[A-Za-z0-9_\-]+$")):
        if name in has:
            found.append(F.when(~F.col(name).rlike(pattern), F.lit(f"pattern:{name}")))
    if "abundance_kg_m2" in has:
        some = F.col("abundance_kg_m2").isNotNull()
        found.append(F.when(F.col("evidence_class").isin("COVER", "GRADE") & some, F.lit("rule:no_abundance")))
        if "mean_nodule_mass_g" in has:
            found.append(F.when((F.col("evidence_class") == "COUNT") & some & F.col("mean_nodule_mass_g").isNull(), F.lit("rule:count_needs_mean")))
    if "observation_or_prediction" in has:
        grid = (F.col("evidence_class") == "GRID") & (F.col("observation_or_prediction") == "observed")
        found.append(F.when(grid, F.lit("rule:grid_not_observed")))
    return F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))


def validate(records: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``). Strict: the first bad row fails the job."""
    marked = records.withColumn("violations", violations(records))
    if strict:
        ok = F.coalesce(F.assert_true(F.size("violations") == 0, F.concat_ws(",", "violations")).cast("boolean"), F.lit(True))
        return marked.filter(ok).drop("violations"), marked.limit(0)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def ingested(records: DataFrame, label: str = "ingested") -> tuple[DataFrame, DataFrame]:
    """(written rows with ``violations``, one row of counts): records normalised, screened and checked, and what became of them.

    Counts are observed by the job that writes the rows, so they tell of the rows that were written and cost no other scan.
    """
    counts = Observation(label)
    laid = screen(normalise(records))
    laid = laid.withColumn("violations", violations(laid))
    told = laid.observe(
        counts, F.count(F.lit(1)).alias("adapted"), F.count("abundance_kg_m2").alias("with_value"), F.count_if(F.col("qa_status") == "flagged").alias("flagged"),
        F.count_if(F.size("violations") > 0).alias("refused"), F.min("abundance_kg_m2").alias("least"), F.max("abundance_kg_m2").alias("most"),
    )
    made = materialise(told, label)
    row = counts.get
    kinds = {"least": "double", "most": "double"}
    return made, made.sparkSession.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in row))


#: Marks of a licence that bars commercial use.
NON_COMMERCIAL = ("-NC-", "NONCOMMERCIAL", "NON-COMMERCIAL")


def non_commercial(licence: Column) -> Column:
    return F.coalesce(F.exists(F.array(*(F.lit(m) for m in NON_COMMERCIAL)), lambda m: F.upper(licence).contains(m)), F.lit(False))


def author_allowed(author: Column, allowed: list[str]) -> Column:
    """Whether an author is of the list, by exact match; a missing one is not."""
    return F.coalesce(author.isin(*allowed), F.lit(False))


#: Data origins from most to least real.
ORIGINS = ("MEASURED", "DERIVED", "LITERATURE", "SYNTHETIC", "AUTHORED")


def origin_rank(origin: Column) -> Column:
    """Rank of an origin; an unknown or missing one is an error."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(ORIGINS):
        rank = F.when(origin == name, F.lit(i)).otherwise(rank)
    return F.coalesce(rank, F.raise_error(F.lit("undeclared data origin")).cast("int"))


def least_real(rank: Column) -> Column:
    """Aggregate of ranks back to the name of the least real origin."""
    return F.element_at(F.array(*(F.lit(o) for o in ORIGINS)), (F.max(rank) + 1).cast("int"))


def watermark(origin: Column, clean: tuple[str, ...] = ("MEASURED", "DERIVED")) -> Column:
    return F.when(origin.isin(*clean), F.lit("")).otherwise(F.concat(F.lit("NOT FOR SCIENTIFIC USE: "), F.coalesce(origin, F.lit("UNDECLARED"))))


def nested_to_events(pieces: DataFrame, event: str, mass: str, unweighed: Column, area_m2: float) -> DataFrame:
    """Pieces nested in an event to one row: counts, mass, mean and density.

    Only partial aggregates cross the shuffle. ``unweighed`` is each row's number of pieces that were
    counted in a remark without a weight; rows without a mass qualify for neither count.
    """
    weighed = F.count(F.col(mass))
    total = F.sum(F.col(mass))
    return pieces.groupBy(event).agg(
        weighed.alias("weighed_count"), F.coalesce(F.sum(unweighed), F.lit(0)).cast("bigint").alias("unweighed_count"),
        total.alias("mass_g"),
    ).select(
        event, "weighed_count", "unweighed_count", (F.col("weighed_count") + F.col("unweighed_count")).alias("nodule_count"), "mass_g",
        F.try_divide(F.col("mass_g"), F.col("weighed_count")).alias("mean_mass_g"),
        ((F.col("weighed_count") + F.col("unweighed_count")) / F.lit(area_m2)).alias("density_m2"),
    )


def unweighed_in(comment: Column) -> Column:
    """Pieces that a remark such as "Plus 13 Nodules of less than 5g" counts; the first such remark holds, 0 without one.

    The remark is read word by word: a number between "plus" and "nodules", then the limit of weight.
    """
    words = F.filter(F.split(F.lower(comment), r"\s+"), lambda w: w != "")
    after = lambda i, k: F.coalesce(F.try_element_at(words, (i + F.lit(k)).cast("int")), F.lit(""))
    limit = lambda i: F.concat(*(after(i, k) for k in range(3, 8)))
    here = lambda i: (
        after(i, 0).endswith("plus") & after(i, 1).try_cast("bigint").isNotNull() & after(i, 2).isin("nodule", "nodules") & limit(i).startswith("oflessthan5g")
    )
    counts = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), here), lambda i: after(i, 1).try_cast("bigint"))
    return F.coalesce(F.try_element_at(counts, F.lit(1)), F.lit(0).cast("bigint"))
