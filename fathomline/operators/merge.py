"""Duplicate matching, disposition, gap-filling merge and upsert of a batch into a corpus."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.operators.geo import band_join, tolerant
from fathomline.operators.graph import components
from fathomline.runtime import materialise, ship

PROVENANCE = ("notes", "duplicate_group_id")


def quality_rank(grade: Column) -> Column:
    return F.when(grade == "A", 3).when(grade == "B", 2).when(grade == "C", 1).otherwise(0)


def severity(status: Column) -> Column:
    return F.when(status == "fail", 2).when(status == "flagged", 1).otherwise(0)


def first_match(
    candidates: DataFrame, corpus: DataFrame, bands: dict[str, float], *, key: str, order: str,
    equal: Iterable[str] = (), tolerant_on: Iterable[str] = (), extra=None,
) -> DataFrame:
    """Each candidate (l_*) with the earliest corpus row (r_*) that duplicates it, if any does.

    The earliest is found by a partial aggregate, so a candidate with many matches is no hot group.
    """
    met = band_join(candidates, corpus, bands, list(equal))
    for name in tolerant_on:
        met = met.filter(tolerant(F.col(f"l_{name}"), F.col(f"r_{name}")))
    if extra is not None:
        met = met.filter(extra)
    best = met.groupBy(F.col(f"l_{key}").alias("_k")).agg(F.min(f"r_{order}").alias("_first"))
    left = candidates.select(*(F.col(c).alias(f"l_{c}") for c in candidates.columns))
    right = corpus.select(*(F.col(c).alias(f"r_{c}") for c in corpus.columns))
    return left.join(best, F.col(f"l_{key}") == F.col("_k"), "left").join(right, F.col("_first") == F.col(f"r_{order}"), "left").drop("_k", "_first")


def disposition(identity: tuple[str, ...] = ("source_id", "source_record_id"), grade: str = "quality_grade") -> Column:
    """Admit, AlreadyPresent, Replace or AbsorbInto of a matched candidate; ties keep the corpus row."""
    same = F.lit(True)
    for name in identity:
        same = same & (F.col(f"l_{name}") == F.col(f"r_{name}"))
    better = quality_rank(F.col(f"l_{grade}")) > quality_rank(F.col(f"r_{grade}"))
    return (
        F.when(F.col(f"r_{identity[-1]}").isNull(), F.lit("Admit"))
        .when(F.coalesce(same, F.lit(False)), F.lit("AlreadyPresent"))
        .when(better, F.lit("Replace"))
        .otherwise(F.lit("AbsorbInto"))
    )


def merge_rows(survivor: str, dropped: str, fields: list[str]) -> dict[str, Column]:
    """The survivor's fields with its gaps filled, donated names, sticky status, group and note.

    ``survivor`` and ``dropped`` are struct columns (or column prefixes ending in a dot).
    """
    s, d = (lambda c: F.col(f"{survivor}{c}")), (lambda c: F.col(f"{dropped}{c}"))
    plain = [f for f in fields if f not in PROVENANCE]
    donated = F.array_sort(F.filter(F.array(*(F.when(s(f).isNull() & d(f).isNotNull(), F.lit(f)) for f in plain)), lambda x: x.isNotNull()))
    out = {f: F.coalesce(s(f), d(f)) for f in plain}
    worse = severity(d("qa_status")) > severity(s("qa_status"))
    out["qa_status"] = F.when(worse, d("qa_status")).otherwise(s("qa_status"))
    out["duplicate_group_id"] = F.coalesce(s("duplicate_group_id"), F.concat(F.lit("dupgrp_"), s("source_record_id")))
    link = F.concat(
        F.lit("duplicate of "), d("source_record_id"), F.lit(" ("), d("source_id"), F.lit(")"),
        F.when(F.size(donated) > 0, F.concat(F.lit("; merged fields: "), F.array_join(donated, ", "))).otherwise(F.lit("")),
        F.when(
            worse,
            F.concat(F.lit("; qa_status escalated "), s("qa_status"), F.lit(" -> "), d("qa_status"), F.lit(" from "), d("source_record_id")),
        ).otherwise(F.lit("")),
    )
    linked = F.coalesce(F.contains(s("notes"), F.concat(F.lit("duplicate of "), d("source_record_id"))), F.lit(False))
    out["notes"] = F.when(linked, s("notes")).otherwise(F.concat_ws("; ", s("notes"), link))
    out["donated_fields"] = donated
    return out


def _step(acc: Column, row: Column, fields: list[str]) -> Column:
    """One candidate folded into a corpus slot."""
    s, d = (lambda c: acc[c]), (lambda c: row[c])
    same = (s("source_id") == d("source_id")) & (s("source_record_id") == d("source_record_id"))
    wins = quality_rank(d("quality_grade")) > quality_rank(s("quality_grade"))
    a = {f: F.when(wins, d(f)).otherwise(s(f)) for f in fields}
    b = {f: F.when(wins, s(f)).otherwise(d(f)) for f in fields}
    plain = [f for f in fields if f not in PROVENANCE]
    donated = F.array_sort(F.filter(F.array(*(F.when(a[f].isNull() & b[f].isNotNull(), F.lit(f)) for f in plain)), lambda x: x.isNotNull()))
    merged = {f: F.coalesce(a[f], b[f]) for f in plain}
    worse = severity(b["qa_status"]) > severity(a["qa_status"])
    merged["qa_status"] = F.when(worse, b["qa_status"]).otherwise(a["qa_status"])
    merged["duplicate_group_id"] = F.coalesce(a["duplicate_group_id"], F.concat(F.lit("dupgrp_"), a["source_record_id"]))
    link = F.concat(
        F.lit("duplicate of "), b["source_record_id"], F.lit(" ("), b["source_id"], F.lit(")"),
        F.when(F.size(donated) > 0, F.concat(F.lit("; merged fields: "), F.array_join(donated, ", "))).otherwise(F.lit("")),
        F.when(worse, F.concat(F.lit("; qa_status escalated "), a["qa_status"], F.lit(" -> "), b["qa_status"], F.lit(" from "), b["source_record_id"])).otherwise(F.lit("")),
    )
    linked = F.coalesce(F.contains(a["notes"], F.concat(F.lit("duplicate of "), b["source_record_id"])), F.lit(False))
    merged["notes"] = F.when(linked, a["notes"]).otherwise(F.concat_ws("; ", a["notes"], link))
    return F.struct(*(F.when(same, s(f)).otherwise(merged[f]).alias(f) for f in fields))


#: Candidates of one component that a task decides at once.
AT_ONCE = 200_000
_RANK = {"A": 3, "B": 2, "C": 1}


class _Slots:
    """Slots of one component in cells twice the tolerances wide: what decides a match, and nothing else."""

    def __init__(self, bands: dict[str, float], tolerant_on: list[str]):
        self.bands, self.tolerant_on, self.rows, self.cells = list(bands.items()), tolerant_on, {}, {}

    def _cell(self, row: dict) -> tuple | None:
        at = [row[c] for c, _ in self.bands]
        return None if None in at else tuple(math.floor(v / (2 * t or 1.0)) for v, (_, t) in zip(at, self.bands, strict=True))

    def put(self, row: dict) -> None:
        seq = row["seq"]
        if seq in self.rows and (was := self._cell(self.rows[seq])) is not None:
            del self.cells[was][bisect.bisect_left(self.cells[was], seq)]
        self.rows[seq] = row
        if (cell := self._cell(row)) is not None:
            bisect.insort(self.cells.setdefault(cell, []), seq)

    def first(self, row: dict) -> dict | None:
        """The earliest slot that the candidate duplicates."""
        home = self._cell(row)
        if home is None:
            return None
        near = (self.cells.get(tuple(h + d for h, d in zip(home, step, strict=True)), ()) for step in itertools.product((-1, 0, 1), repeat=len(home)))
        for seq in heapq.merge(*near):
            slot = self.rows[seq]
            close = all(abs(slot[c] - row[c]) <= t for c, t in self.bands)
            alike = all(slot[c] is None or row[c] is None or slot[c] == row[c] for c in self.tolerant_on)
            source = row["evidence_class"] != "GRID" or (slot["source_id"] is not None and slot["source_id"] == row["source_id"])
            if close and alike and source and slot["evidence_class"] == row["evidence_class"]:
                return slot
        return None


def home_cell(bands: dict[str, float], equal: list[str]) -> list[Column]:
    """The cell, a tolerance wide, that a row lies in: rows of a cell are close to each other. Not a number is no place."""
    return [*(F.col(c) for c in equal), *(F.when(~F.isnan(c), F.floor(F.col(c).cast("double") / t)) for c, t in bands.items())]


def near_cells(spots: DataFrame, slots: DataFrame, bands: dict[str, float], equal: list[str]) -> DataFrame:
    """(cells, component) of all cells that hold a spot or lie near one: what is within the tolerances of a spot shares its component.

    Cells meet by the boxes of what they hold, so their pairs are as many as the cells have neighbours, however crowded they are.
    """
    cell = [*(f"as_{c}" for c in equal), *(f"at_{c}" for c in bands)]
    laid = slots.select(*equal, *bands, F.lit(0).alias("asks")).unionByName(spots.select(*equal, *bands, F.lit(1).alias("asks")))
    laid = laid.select(*(c.alias(n) for n, c in zip(cell, home_cell(bands, equal), strict=True)), "asks", *(F.col(c).cast("double").alias(c) for c in bands))
    box = [f(c).alias(f"{k}_{c}") for c in bands for k, f in (("lo", F.min), ("hi", F.max))]
    held = laid.na.drop(subset=cell).groupBy(*cell).agg(F.max("asks").alias("asks"), *box)
    held = materialise(held.withColumn("cell", F.monotonically_increasing_id()), "near-held")
    one = held.filter("asks = 1")
    for c, t in bands.items():
        one = one.withColumn(f"to_{c}", F.explode(F.sequence(F.floor((F.col(f"lo_{c}") - t) / t - 1e-6), F.floor((F.col(f"hi_{c}") + t) / t + 1e-6))))
    two = held.select(*(F.col(c).alias(f"b_{c}") for c in held.columns))
    met = [*(F.col(f"as_{c}") == F.col(f"b_as_{c}") for c in equal), *(F.col(f"to_{c}") == F.col(f"b_at_{c}") for c in bands)]
    met += [(F.greatest(F.col(f"b_lo_{c}") - F.col(f"hi_{c}"), F.col(f"lo_{c}") - F.col(f"b_hi_{c}")) <= t * (1 + 1e-9)) for c, t in bands.items()]
    pairs = one.join(two, reduce(lambda x, y: x & y, met)).select(F.col("cell").alias("a"), F.col("b_cell").alias("b"))
    label = components(pairs)
    near = held.join(label.select(F.col("id").alias("cell"), "component"), "cell", "left")
    return near.select(*cell, F.coalesce("component", "cell").alias("component"))


def _decide(bands: dict[str, float], tolerant_on: list[str]):
    """Dispositions of a component's candidates in order of arrival, and its slots as they are then."""
    kept = ["evidence_class", "source_id", "source_record_id", "quality_grade", *bands, *tolerant_on]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        slots, log = _Slots(bands, tolerant_on), []
        rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
        for row in (r for r in rows if r["is_slot"]):
            slots.put(row)
        for row in sorted((r for r in rows if not r["is_slot"]), key=lambda r: r["seq"]):
            slot = slots.first(row)
            same = slot is not None and None not in (row["source_id"], row["source_record_id"]) and all(slot[c] == row[c] for c in ("source_id", "source_record_id"))
            if slot is None or same:
                log.append((row, slot, "Admit" if slot is None else "AlreadyPresent"))
                continue
            wins = _RANK.get(row["quality_grade"], 0) > _RANK.get(slot["quality_grade"], 0)
            log.append((row, slot, "Replace" if wins else "AbsorbInto"))
            one, two = (row, slot) if wins else (slot, row)
            slots.put(slot | {c: one[c] if one[c] is not None else two[c] for c in kept})
        told = [{**row, "slot": slot and slot["seq"], "disposition": d, "displaced_source": slot and slot["source_id"]} for row, slot, d in log]
        return pd.DataFrame([*told, *slots.rows.values()], columns=[*frame.columns, "slot", "disposition", "displaced_source"], dtype=object)

    return run


def decisions(corpus: DataFrame, batch: DataFrame, bands: dict[str, float], tolerant_on: list[str], at_once: int = AT_ONCE) -> DataFrame:
    """(candidate, slot, disposition, evidence_class, source_id, displaced_source) of every candidate of a batch.

    A slot only ever moves to a candidate's position, so candidates and slots fall into components of closeness that know
    nothing of each other. Each is decided in one task, by the few columns that decide; a component of more than
    ``at_once`` candidates takes as many passes as it holds such parts, and hands its slots on.
    """
    ship(corpus.sparkSession)
    kept = list(dict.fromkeys(["seq", "evidence_class", "source_id", "source_record_id", "quality_grade", *bands, *tolerant_on]))
    slots, spots = corpus.select(*kept), batch.select(*kept)
    homes = materialise(near_cells(spots, slots, bands, ["evidence_class"]), "upsert-cells")
    cell = [c for c in homes.columns if c != "component"]

    def labelled(rows: DataFrame, is_slot: bool) -> DataFrame:
        node = F.col("seq") * 2 + (0 if is_slot else 1)
        at = rows.join(homes.select(*(F.col(c).alias(f"_{c}") for c in cell), "component"), reduce(lambda x, y: x & y, (c == F.col(f"_{n}") for n, c in zip(cell, home_cell(bands, ["evidence_class"]), strict=True))), "left")
        # rows without a cell are alone, numbered below zero
        return at.select(*kept, F.coalesce("component", -1 - node).alias("group"), F.lit(is_slot).alias("is_slot"))

    waiting, state = labelled(spots, False), labelled(slots, True)
    order = Window.partitionBy("group").orderBy("seq")
    waiting = materialise(waiting.withColumn("turn", F.floor((F.row_number().over(order) - 1) / at_once).cast("int")), "upsert-waiting")
    last = waiting.agg(F.max("turn").alias("t")).first()["t"]
    kinds = waiting.drop("turn").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(",", ", ").replace(":", " ")
    schema = f"{kinds}, slot bigint, disposition string, displaced_source string"
    logs = []
    for turn in range(0 if last is None else last + 1):
        now = waiting.filter(F.col("turn") == turn).drop("turn")
        active = now.select("group").distinct()
        told = materialise(now.unionByName(state.join(active, "group", "left_semi")).groupBy("group").applyInPandas(_decide(bands, list(tolerant_on)), schema), "upsert-told")
        logs.append(told.filter("not is_slot"))
        state = told.filter("is_slot").select(*state.columns)  # a component that is done is not asked for again
    log = reduce(DataFrame.unionByName, logs) if logs else waiting.withColumns({"slot": F.lit(None).cast("bigint"), "disposition": F.lit(""), "displaced_source": F.lit("")})
    return log.select(F.col("seq").alias("candidate"), "slot", "disposition", "evidence_class", "source_id", "displaced_source")


def changes(corpus: DataFrame, batch: DataFrame, bands: dict[str, float], *, tolerant_on: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows of the corpus that a batch changes or adds, as they are after it; disposition log). Both sides carry ``seq``, the order of arrival.

    Candidates match the corpus as it was before the batch and as earlier candidates of the batch changed it (a Replace
    moves its slot, a merge fills its gaps); rows of the batch do not see each other. Candidates of one slot fold in order.
    """
    fields = [c for c in corpus.columns if c != "seq"]
    log = materialise(decisions(corpus, batch, bands, list(tolerant_on)), "upsert-log")
    touched = log.filter(F.col("disposition").isin("Replace", "AbsorbInto")).select(F.col("candidate").alias("_c"), F.col("slot").alias("_slot"))
    rows = batch.join(touched, F.col("seq") == F.col("_c"))
    folds = rows.groupBy("_slot").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("queue"))
    start = F.struct(*(F.col(f) for f in fields))
    folded = F.aggregate("queue", start, lambda acc, row: _step(acc, row, fields))
    slots = corpus.join(folds, F.col("seq") == F.col("_slot")).withColumn("_row", folded).select("seq", *(F.col(f"_row.{f}").alias(f) for f in fields))
    admitted = batch.join(log.filter("disposition = 'Admit'").select(F.col("candidate").alias("seq")), "seq", "left_semi")
    return materialise(slots.unionByName(admitted.select("seq", *fields)), "upsert-changes"), log


def upsert(corpus: DataFrame, batch: DataFrame, bands: dict[str, float], *, tolerant_on: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(corpus after the batch, disposition log)."""
    changed, log = changes(corpus, batch, bands, tolerant_on=tolerant_on)
    return corpus.join(changed.select("seq"), "seq", "left_anti").select(*corpus.columns).unionByName(changed), log


def signed_log(log: DataFrame) -> DataFrame:
    """(source_id, evidence_class, admitted, absorbed, already_present) of a log of dispositions, as rows to add up.

    A Replace is two rows: the candidate's source gains an admitted one, and the displaced row, admitted before, goes over to
    its own source's absorbed ones. Sums over logs of several batches tell what the corpus holds, in whatever order they ran.
    """
    row = lambda source, a, b, c: F.struct(source.alias("source_id"), F.lit(a).alias("admitted"), F.lit(b).alias("absorbed"), F.lit(c).alias("already_present"))
    own, other, d = F.col("source_id"), F.col("displaced_source"), F.col("disposition")
    made = F.when(d == "Admit", F.array(row(own, 1, 0, 0))).when(d == "AbsorbInto", F.array(row(own, 0, 1, 0))).when(d == "AlreadyPresent", F.array(row(own, 0, 0, 1)))
    made = made.when(d == "Replace", F.array(row(own, 1, 0, 0), row(other, -1, 1, 0)))
    return log.select("evidence_class", F.explode(made).alias("r")).select("r.source_id", "evidence_class", "r.admitted", "r.absorbed", "r.already_present")


def dispositions(log: DataFrame, *by: str) -> DataFrame:
    """Sums of the signed log by source (and class); what nets to nothing is left out."""
    keys = by or ("source_id",)
    told = signed_log(log).groupBy(*keys).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("admitted", "absorbed", "already_present")))
    return told.filter("admitted <> 0 or absorbed <> 0 or already_present <> 0")


def running_order(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``seq`` 0.. in the order of ``by`` without one global sort task: ranks within ranges plus offsets."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts.withColumn("_nth", F.monotonically_increasing_id() - (F.col("_part").cast("bigint") * F.lit(1 << 33))), "order")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.withColumn("_base", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return parts.join(F.broadcast(base), "_part").withColumn("seq", F.col("_nth") + F.coalesce("_base", F.lit(0))).drop("_part", "_nth", "_n", "_base")
