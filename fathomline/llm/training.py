"""Labelled samples for the trained classifiers, and the Adam steps they share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import common as C
from fathomline.runtime import give_back

#: Most labelled texts of one class that a classifier is fitted on, and the longest of them in bytes.
PER_CLASS = 4000
MAX_BYTES = 24_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, *, folds: int = 4, held: int = 2,
    per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES,
) -> tuple[pa.Table, dict[int, int]]:
    """A bounded sample of labelled rows outside the held-out fold, and each class's whole count.

    At most about ``per_class`` rows a class, chosen by the hash of the id; texts beyond
    ``max_bytes`` are not drawn. Rows with a null or other label than 0 and 1 are ignored, and so are
    ids whose labels contradict each other. Of texts that share an id, the smallest hash is drawn.
    Columns: text, lang, label, in an order that depends on the ids only.
    """
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label"))
    marks = marks.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).filter(C.fold(F.col("doc_id"), folds) != held)
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(per_class / n)).otherwise(share)
    # about two times per_class ids at most, so this side may be broadcast
    chosen = F.broadcast(marks.filter(draw < share * float(1 << 30)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    text = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        lang.cast("string").alias("lang"),
    )
    rows = text.filter(F.octet_length("text") <= max_bytes).join(chosen, "doc_id")
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("one")
    table = rows.groupBy("doc_id", "label").agg(one).select("doc_id", "one.text", "one.lang", "label").toArrow()
    give_back(docs.sparkSession)
    order = np.argsort(C.mix(table.column("doc_id").to_numpy().astype(np.uint64) + np.uint64(9)), kind="stable")
    return table.take(pa.array(order)).drop_columns(["doc_id"]), counts


class Adam:
    """Adam over named arrays; ``rows`` limits a step to some rows of an embedding table."""

    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in values.items()}
        self.v = {k: np.zeros_like(v) for k, v in values.items()}

    def step(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            at = rows[k] if rows and k in rows else slice(None)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.values[k][at] -= (scale * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-7)).astype(self.values[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def class_weights(label: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a class its share of all labelled rows, not of the sample."""
    whole = sum(counts.values()) or 1
    drawn = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    return np.array([counts.get(int(c), 0) / whole / drawn[int(c)] for c in label]) * len(label)
