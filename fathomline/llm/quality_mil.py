"""Attention-based multiple-instance quality classifier.

A document is a bag of passages of ``PASSAGE`` words. A passage is described by the shares of its
bytes (one class per ASCII mark, letters, digits, capitals, others), by word shape (lengths,
distinct words, capital words, words with marks) and by hashed word counts. A tanh layer encodes
each passage, gated attention weighs it, and a logistic layer reads the weighted mean encoding.
Weights are learned from document labels on a bounded sample (``training.PER_CLASS``); scoring
encodes every passage of every text.

Edge cases. Null, empty and blank texts are one passage without words. A sample without both
classes gives every text the share of positives. Rows are kept as they come, repeated ones too;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import common as C
from fathomline.llm import training as L
from fathomline.runtime import ship, table

PASSAGE = 96
HASHED = 64
HIDDEN = 24
GATES = 12
EPOCHS = 8
BATCH = 64
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.uint8)
_CLASS[33:48] = np.arange(1, 16)
_CLASS[58:65] = np.arange(16, 23)
_CLASS[91:97] = np.arange(23, 29)
_CLASS[123:127] = np.arange(29, 33)
_CLASS[48:58] = 33
_CLASS[65:91] = 34
_CLASS[97:123] = 35
_CLASS[128:] = 36
_CLASS[10] = 37
CLASSES = 38
SHAPE = 8
WIDTH = CLASSES + SHAPE + HASHED


def passages(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of every passage, and the border of each text's passages (one at least)."""
    _, first, last, edge, word = C.words(chunk)
    count = np.diff(edge)
    bags = np.concatenate([[0], np.cumsum(np.maximum(1, -(-count // PASSAGE)))])
    text = C.owner(edge)
    home = bags[text] + (np.arange(len(word)) - edge[text]) // PASSAGE
    n = bags[-1]
    kind = _CLASS[chunk.data]
    # bytes belong to the passage of the latest word start before them
    begin = np.full(n, -1, np.int64)
    opening = np.flatnonzero(np.diff(home, prepend=-1))
    begin[home[opening]] = first[opening]
    blank = begin < 0
    begin[blank] = chunk.starts[np.searchsorted(bags, np.flatnonzero(blank), "right") - 1]
    begin[bags[:-1]] = chunk.starts[:-1]
    stop = np.concatenate([begin[1:], [len(chunk.data)]]) if n else begin
    of_byte = np.repeat(np.arange(n), stop - begin)
    bytes_ = np.bincount(of_byte * 64 + kind, minlength=n * 64).reshape(n, 64)[:, :CLASSES].astype(np.float32)
    size = np.maximum(1, (stop - begin)).astype(np.float32)[:, None]
    out = np.zeros((n, WIDTH), np.float32)
    out[:, :CLASSES] = np.sqrt(bytes_ / size)
    words = np.bincount(home, minlength=n).astype(np.float32)
    some = np.maximum(1, words)
    length = (last - first).astype(np.float32)
    mean = np.bincount(home, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(home, length**2, n) / some - mean**2))
    key = (word >> np.uint64(24)) | (home.astype(np.uint64) << np.uint64(40))
    distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (home[1:] == home[:-1])
    capital = (kind[first] == 34) & (kind[np.minimum(first + 1, last - 1)] == 34) if len(word) else again
    marked = (kind[last - 1] > 0) & (kind[last - 1] < 33) if len(word) else again
    shape = [
        np.log1p(words) / 5, np.log1p(mean) / 3, np.log1p(spread) / 3, distinct / some,
        np.bincount(home, again, n) / some, np.bincount(home, capital, n) / some, np.bincount(home, marked, n) / some,
        np.log1p(size[:, 0]) / 8,
    ]
    out[:, CLASSES : CLASSES + SHAPE] = np.stack(shape, 1)
    slot = (word >> np.uint64(52)).astype(np.int64) % HASHED
    sign = np.where(word & np.uint64(1), 1.0, -1.0)
    hashed = np.bincount(home * HASHED + slot, sign, n * HASHED).reshape(n, HASHED)
    out[:, CLASSES + SHAPE :] = hashed / np.sqrt(some)[:, None]
    return out, bags


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {
            "enc": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, HIDDEN)).astype(np.float32),
            "enc0": np.zeros(HIDDEN, np.float32),
            "tan": r.normal(0, 0.3, (HIDDEN, GATES)).astype(np.float32),
            "gate": r.normal(0, 0.3, (HIDDEN, GATES)).astype(np.float32),
            "att": r.normal(0, 0.3, GATES).astype(np.float32),
            "out": r.normal(0, 0.3, HIDDEN).astype(np.float32),
            "base": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["enc"] + p["enc0"])
        t, g = np.tanh(h @ p["tan"]), L.sigmoid(h @ p["gate"]).astype(np.float32)
        e = (t * g) @ p["att"]
        n = np.diff(bags)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags[:-1]), n))
        a = e / np.repeat(np.add.reduceat(e, bags[:-1]), n)
        z = np.add.reduceat(h * a[:, None], bags[:-1], axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": L.sigmoid((z @ p["out"]).astype(np.float64) + float(p["base"][0]))}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward(x, bags)["p"]

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> None:
        """Mini-batch Adam on weighted log loss; a small sample is passed over more often."""
        p = self.p
        prior = np.average(label, weights=weight)
        p["base"][0] = np.log(prior / (1 - prior))
        adam = L.Adam(p, 0.01)
        order = np.random.default_rng(2)
        epochs = int(np.clip(30_000 // len(bags), EPOCHS, 60))
        for epoch in range(epochs):
            if epoch == epochs - 2:
                adam.rate *= 0.3
            turn = order.permutation(len(bags))
            for at in range(0, len(turn), BATCH):
                pick = turn[at : at + BATCH]
                x = np.concatenate([bags[i] for i in pick])
                n = np.array([len(bags[i]) for i in pick])
                f = self._forward(x, np.concatenate([[0], np.cumsum(n)]))
                d = ((f["p"] - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dz = np.repeat(d[:, None] * p["out"], n, axis=0)
                da = (dz * f["h"]).sum(1)
                mean = np.add.reduceat(da * f["a"], np.concatenate([[0], np.cumsum(n)[:-1]]))
                de = f["a"] * (da - np.repeat(mean, n))
                dt, dg = de[:, None] * p["att"] * f["g"], de[:, None] * p["att"] * f["t"]
                dt *= 1 - f["t"] ** 2
                dg *= f["g"] * (1 - f["g"])
                dh = dz * f["a"][:, None] + dt @ p["tan"].T + dg @ p["gate"].T
                dh *= 1 - f["h"] ** 2
                adam.step(
                    {
                        "enc": x.T @ dh + 1e-4 * p["enc"], "enc0": dh.sum(0), "tan": f["h"].T @ dt, "gate": f["h"].T @ dg,
                        "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ d + 1e-4 * p["out"], "base": np.array([d.sum()]),
                    }
                )


def _as_bags(texts: pa.Array) -> list[np.ndarray]:
    made = []
    for chunk in C.text_chunks(texts):
        x, bags = passages(chunk)
        made += [x[a:b] for a, b in zip(bags, bags[1:], strict=False)]
    return made


class Model:
    def __init__(self, net: Net | None, prior: float):
        self.net, self.prior = net, prior

    def scores(self, chunk: C.Chunk) -> np.ndarray:
        if self.net is None:
            return np.full(chunk.n, self.prior)
        return self.net.score(*passages(chunk))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample, counts = L.labelled_sample(docs, labels, "quality")
    label = sample.column("label").to_numpy().astype(np.int64)
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(label.tolist())) < 2:
        return Model(None, prior)
    net = Net()
    net.fit(_as_bags(sample.column("text")), label, L.class_weights(label, counts))
    return Model(net, prior)


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for chunk in C.text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[chunk.rows], pa.array(model.scores(chunk))], names=_SCORED.names
                )

    return run


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(_apply(shared), _SCORED).select(
        "doc_id",
        (C.fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def _filter(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            good = [model.scores(c) >= threshold for c in C.text_chunks(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *good])))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below the threshold go; all columns of the others stay."""
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    C.give_back()
    return docs.mapInArrow(_filter(shared, THRESHOLD), docs.schema)
