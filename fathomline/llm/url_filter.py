"""URL filter: host and path rules, and a character language-model ratio for the rest.

Rules block or allow a host with its subdomains below a path; the longest rule that fits wins.
URLs that a rule decides are the examples of two smoothed variable-order Markov models, one of
accepted and one of rejected URLs. A character's probability blends orders 0 to ``ORDER``: at each
order the count gives way to the shorter context by the number of distinct successors seen
(Witten-Bell). The score is the difference of both log-likelihoods per character; its threshold
is calibrated on labelled URLs that took no part in the counts, and a URL at or above it passes.

Counts cover all labelled URLs. They are kept in ``2**LOG_SLOTS`` hashed cells per order and
class, so what the driver gathers and broadcasts has a fixed bound.

Edge cases. A null URL or one without ``://`` has an empty host and path, fits no rule, and is
judged by its whole text (null: empty, score 0). A long URL is read piece by piece. Without examples of both classes every score is
0 and every such URL passes. Rows are kept as they come, repeated ones too; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import common as C
from fathomline.runtime import ship

ORDER = 5
LOG_SLOTS = 15
#: A fold in so many of the labelled URLs calibrates the threshold.
HELD = 5
STEP = 0.01
ALPHABET = 64
#: Characters that are read at once.
PIECE = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. Rules read host/path; meant for some hundreds at most."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        site, _, below = rule.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{below}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _cells(column: pa.Array) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Some characters at a time: their cells and their contexts' cells at each order, and their URLs."""
    rows = 0
    for chunk in C.text_chunks(column, PIECE):
        url = np.repeat(np.arange(rows, rows + chunk.n), np.diff(chunk.starts))
        rows += chunk.n
        for a in range(0, len(chunk.data), PIECE):
            lo, to = max(0, a - ORDER), min(len(chunk.data), a + PIECE)
            data = C.LOWER[chunk.data[lo:to]].astype(np.uint64) + np.uint64(1)
            own = url[lo:to]
            place = np.arange(lo, to) - chunk.starts[:-1][own - url[0]]
            cells, contexts = [], []
            context = np.zeros(len(data), np.uint64)
            for order in range(ORDER + 1):
                if order:
                    back = np.zeros(len(data), np.uint64)
                    back[order:] = data[:-order]
                    back[place < order] = 0  # before the URL's start
                    context = C.mix(context + back + np.uint64(order << 20))
                contexts.append((C.mix(context) >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)[a - lo :])
                cells.append((C.mix(context + data * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - LOG_SLOTS)).astype(np.int64)[a - lo :])
            yield cells, contexts, own[a - lo :]


_COUNTS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("home", T.IntegerType())])
_PER = 1 << LOG_SLOTS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task, non-zero cells only, and the context each symbol's cell stands in.

    Cells: class, order, (symbol | context), slot.
    """
    total = np.zeros((2, ORDER + 1, 2, _PER), np.int64)
    home = np.full((2, ORDER + 1, 2, _PER), -1, np.int32)
    for batch in batches:
        label = batch.column("label").to_numpy()
        for cells, contexts, url in _cells(batch.column("url")):
            for c in (0, 1):
                own = label[url] == c
                for order in range(ORDER + 1):
                    total[c, order, 0] += np.bincount(cells[order][own], minlength=_PER)
                    total[c, order, 1] += np.bincount(contexts[order][own], minlength=_PER)
                    home[c, order, 0][cells[order][own]] = contexts[order][own]
    flat = total.ravel()
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at]), pa.array(home.ravel()[at])], names=_COUNTS.names)


class Ratio:
    """Log-likelihood difference per character under the two models' counts."""

    def __init__(self, counts: np.ndarray, home: np.ndarray):
        """Counts by cell, and for symbols' cells the contexts they stand in, whose distinct successors they are."""
        self.n = counts.reshape(2, ORDER + 1, 2, _PER).astype(np.float32)
        home = home.reshape(2, ORDER + 1, 2, _PER)
        self.kinds = np.zeros((2, ORDER + 1, _PER), np.float32)
        for c in (0, 1):
            for order in range(ORDER + 1):
                own = home[c, order, 0][self.n[c, order, 0] > 0]
                # a context has a successor, even where another context took its cell
                self.kinds[c, order] = np.maximum(1, np.bincount(own[own >= 0], minlength=_PER))

    def __call__(self, column: pa.Array) -> np.ndarray:
        total, size = np.zeros(len(column)), np.zeros(len(column))
        for cells, contexts, url in _cells(column):
            size += np.bincount(url, minlength=len(column))
            for c in (0, 1):
                p = np.full(len(url), 1 / ALPHABET, np.float32)
                for order in range(ORDER + 1):
                    n, all_, kinds = self.n[c, order, 0][cells[order]], self.n[c, order, 1][contexts[order]], self.kinds[c, order][contexts[order]]
                    p = np.where(all_ > 0, (np.minimum(n, all_) + kinds * p) / np.maximum(all_ + kinds, 1), p)
                total += (2 * c - 1) * np.bincount(url, np.log(p), len(column))
        return total / np.maximum(1, size)


def _score(shared, schema_names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                score = ratio(part.column("url")) if ratio is not None else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*schema_names, "score"])

    return run


def judge(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    spark = pages.sparkSession
    ship(spark)
    url = F.col("url").cast("string")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"))
    own = own.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("rule"))
    said = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        said = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(said)
    own = own.withColumn("said", said)
    marked = own.filter("said is not null").select("url", (F.col("said") == "allow").cast("int").alias("label"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0
    cells = marked.filter(~held).mapInArrow(_count, _COUNTS).groupBy("cell").agg(F.sum("n").alias("n"), F.max("home").alias("home")).toArrow()
    counts, home = np.zeros(2 * (ORDER + 1) * 2 * _PER, np.int64), np.full(2 * (ORDER + 1) * 2 * _PER, -1, np.int32)
    counts[cells.column("cell").to_numpy()], home[cells.column("cell").to_numpy()] = cells.column("n").to_numpy(), cells.column("home").to_numpy()
    both = counts.reshape(2, -1).sum(1).min() > 0
    shared = spark.sparkContext.broadcast(Ratio(counts, home) if both else None)
    limit = 0.0
    if both:
        scored = marked.filter(held).mapInArrow(_score(shared, ["url", "label"]), "url string, label int, score double")
        bins = scored.select("label", F.round(F.col("score") / STEP).cast("int").alias("bin")).groupBy("label", "bin").count().collect()
        limit = calibrate([(r["label"], r["bin"], r["count"]) for r in bins])
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    judged = own.mapInArrow(_score(shared, own.columns), schema)
    verdict = F.coalesce("said", F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def calibrate(bins: list[tuple[int, int, int]]) -> float:
    """Threshold with the best balanced accuracy over (label, score bin, count); the middle of ties."""
    total = [sum(n for c, _, n in bins if c == k) or 1 for k in (0, 1)]
    edges = sorted({b for _, b, _ in bins} | {b + 1 for _, b, _ in bins})
    rated = []
    for t in edges:
        kept = [sum(n for c, b, n in bins if c == k and b >= t) for k in (0, 1)]
        rated.append((kept[1] / total[1] - kept[0] / total[0], t))
    best = [t for v, t in rated if v == max(rated)[0]] or [0]
    return (best[0] + best[-1]) / 2 * STEP - STEP / 2
