"""Adapters from a source's own rows to records: mapped fan-out, box cores, regional grids, tables of one source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.ingest import unweighed_in
from fathomline.operators.merge import running_order

#: The note of a box core whose cover was seen in photographs.
COVER_NOTE = "cover read from photographs"


def mapped_fan_out(
    rows: DataFrame, source: str, ordinal: str, classes: dict[str, str], *, shared: dict[str, str] | None = None,
    static: dict[str, object] | None = None, per_class: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """One record per evidence class whose presence column is not null, with the mapped columns.

    ``shared`` maps target columns to the row's for every class, ``static`` to a value, ``per_class`` to the row's for
    one class (null for others). One projection and one explode: no shuffle.
    """
    shared, static, per_class = shared or {}, static or {}, per_class or {}
    unknown = sorted(set(per_class) - set(classes))
    if unknown:
        raise ValueError(f"maps for classes that are not fanned out: {', '.join(unknown)}")
    names = sorted({t for m in per_class.values() for t in m})
    clash = sorted(set(names) & (set(shared) | set(static)) | set(shared) & set(static))
    if clash:
        raise ValueError(f"columns mapped twice: {', '.join(clash)}")
    value = lambda c, t: F.col(per_class[c][t]) if t in per_class.get(c, {}) else F.lit(None)
    kinds = {t: next(dict(rows.dtypes)[m[t]] for m in per_class.values() if t in m) for t in names}
    made = F.array(
        *(
            F.struct(F.lit(c).alias("evidence_class"), F.col(p).isNotNull().alias("_here"), *(value(c, t).cast(kinds[t]).alias(t) for t in names))
            for c, p in classes.items()
        )
    )
    keep = [*(F.col(s).alias(t) for t, s in shared.items()), *(F.lit(v).alias(t) for t, v in static.items())]
    out = rows.select(F.col(ordinal).alias("_ordinal"), *keep, F.explode(F.filter(made, lambda r: r["_here"])).alias("r"))
    record = F.format_string(f"{source}_%s_%06d", F.lower("evidence_class"), "_ordinal")
    return out.select(*shared, *static, "r.*", "_ordinal").withColumn("source_record_id", record).drop("_here", "_ordinal")


def cruise_of(event: Column) -> Column:
    """A cruise is what an event's label says before its first underscore."""
    return F.substring_index(event, "_", 1)


def box_cores(records: DataFrame, event: str = "event", elevation: str = "elevation_m", comment: str = "comment") -> DataFrame:
    """Records of box cores: depth is elevation turned, the cruise is read off the event, recoveries that failed are
    flagged with a note, grades follow the class, and cover says how it was read."""
    failed = F.coalesce(F.lower(comment).contains("failed"), F.lit(False))
    note = F.when(failed, F.concat(F.lit("event comment: "), F.col(comment)))
    cover = F.when(F.col("evidence_class") == "COVER", F.lit(COVER_NOTE))
    return records.withColumns(
        {
            "water_depth_m": -F.col(elevation),
            "cruise": cruise_of(F.col(event)),
            "qa_status": F.when(failed, F.lit("flagged")).otherwise(F.lit("pending")),
            "quality_grade": F.when(F.col("evidence_class").isin("MASS", "COUNT"), F.lit("A")),
            "notes": F.nullif(F.concat_ws("; ", note, cover), F.lit("")),
        }
    )


def event_records(
    pieces: DataFrame, source: str, event: str, order: list[str], mass_g: str, *, dimensions: list[str] = (), remark: str | None = None,
    shared: dict[str, str] | None = None, elevation: str | None = None, event_comment: str | None = None, area_m2: float | None = None, is_open: bool = True,
) -> DataFrame:
    """Pieces nested in events as two records an event: a MASS of what was weighed, and a COUNT of all that was seen.

    A piece counts when it has a mass or a dimension; remarks may tell of more that nobody weighed. The mean is that of weighed
    pieces. What an event shares comes from its first piece by ``order``; events are numbered in the order of their names. One
    partial aggregate an event, and range ranks for the numbers: no task holds all pieces of an event or all events.
    """
    shared = shared or {}
    told = lambda c, kind="string": F.col(c) if c else F.lit(None).cast(kind)
    seen = F.col(mass_g).isNotNull()
    for name in dimensions:
        seen = seen | F.col(name).isNotNull()
    extra = unweighed_in(F.col(remark)) if remark else F.lit(0).cast("bigint")
    first = F.min_by(F.struct(*(F.col(c).alias(t) for t, c in shared.items()), told(elevation, "double").alias("_elevation"), told(event_comment).alias("_comment")), F.struct(*order))
    per = pieces.groupBy(F.col(event).cast("string").alias("event")).agg(
        F.count(mass_g).alias("weighed"), F.coalesce(F.sum(F.col(mass_g).cast("double")), F.lit(0.0)).alias("grams"), F.count_if(seen).alias("seen"),
        F.sum(extra).cast("bigint").alias("unweighed"), first.alias("first"),
    )
    per = running_order(per, ["event"]).withColumn("nodule_count", F.col("seen") + F.col("unweighed"))
    failed = F.coalesce(F.lower("first._comment").contains("failed"), F.lit(False))
    some = F.col("unweighed") > 0
    share = F.bround(100.0 * F.col("unweighed") / F.col("nodule_count")).cast("int")
    notes = F.concat_ws(
        "; ", F.when(failed, F.concat(F.lit("event comment: "), F.col("first._comment"))),
        F.when(some, F.format_string("mean leaves out %s unweighed pieces (%s%% of the event): too high", "unweighed", share)),
    )
    formula = F.concat(
        F.lit("nodule_mass_kg = sum of weighed masses; mean_nodule_mass_g = 1000 * nodule_mass_kg / weighed pieces"),
        F.when(some, F.format_string("; %s unweighed pieces are not in the sum", "unweighed")).otherwise(F.lit("")),
    )
    mean = F.try_divide(F.col("grams"), F.col("weighed"))
    nothing = F.lit(None).cast("double")
    count = F.col("nodule_count")
    made = F.array(
        F.struct(F.lit("MASS").alias("evidence_class"), (F.col("grams") / 1000).alias("nodule_mass_kg"), F.lit(None).cast("bigint").alias("nodule_count"),
                 nothing.alias("nodule_density_m2"), F.lit("B").alias("quality_grade")),
        F.struct(F.lit("COUNT").alias("evidence_class"), nothing.alias("nodule_mass_kg"), count.alias("nodule_count"),
                 (count / F.lit(area_m2) if area_m2 else nothing).alias("nodule_density_m2"), F.lit(None).cast("string").alias("quality_grade")),
    )
    out = per.select(
        "event", "seq", cruise_of(F.col("event")).alias("cruise"), (-F.col("first._elevation")).alias("water_depth_m"), mean.alias("mean_nodule_mass_g"),
        F.when(failed, F.lit("flagged")).otherwise(F.lit("pending")).alias("qa_status"), F.nullif(notes, F.lit("")).alias("notes"), formula.alias("derivation_formula"),
        *(F.col(f"first.{t}").alias(t) for t in shared), F.lit("observed").alias("observation_or_prediction"), F.lit(is_open).alias("is_open"),
        F.lit(area_m2).cast("double").alias("sampled_area_m2"), F.explode(made).alias("r"),
    )
    record = F.format_string(f"{source}_%s_%06d", "evidence_class", "seq")
    return out.select("*", "r.*").drop("r").withColumns({"source_id": F.lit(source), "source_record_id": record}).drop("seq")


def regional_grid(rows: DataFrame, source: str, ordinal: str, value: str, observation: str = "compiled", **maps: dict) -> DataFrame:
    """Cells of a compiled grid as records; what a grid holds was not observed there, so that claim is refused."""
    if observation == "observed":
        raise ValueError("a regional grid is no observation")
    static = {"observation_or_prediction": observation, **maps.pop("static", {})}
    return mapped_fan_out(rows, source, ordinal, {"GRID": value}, static=static, **maps)


def adapt(rows: DataFrame | Callable[[], DataFrame], source: str, ordinal: str, classes: dict[str, str], **maps: dict) -> DataFrame:
    """Records of any table, or of what a loader returns."""
    return mapped_fan_out(rows() if callable(rows) else rows, source, ordinal, classes, **maps)
