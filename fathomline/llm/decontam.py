"""Benchmark decontamination by template canonicalisation.

A text becomes words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased). Two templates
are read off it: in both, numbers become a placeholder, and a unit standing right after a number
another; in the second, names become a third (a capital followed by a small letter, not at the
start of a sentence). A window is ``window`` consecutive template words, or a whole item if that
is shorter. Windows of items and documents meet by their template's hash; what the placeholders
stood for is kept as slots.

A match is a document window equal to an item's window in either template, or word for word. Matches
of one document and item that lie on one diagonal form a passage; those word for word form one of their
own, which has no slots and always counts. Slots are consistent when one value of the item
maps to one value of the document within a passage, so a re-parameterised question is
caught, and a chance meeting of placeholders is not. A passage is ``STRETCH`` words of the item at most: longer
items are judged stretch by stretch, so a slot that differs far off leaves the rest standing. An item occurs when the words that consistent
passages cover reach ``coverage`` of it, so an inserted or lost word does not hide it. An item of fewer
than ``LEAST`` words occurs only in a text that has no other words.

Documents stream once against a bit table of item windows whose size is fixed; only windows that
pass it are emitted and joined by hash. The item windows are broadcast if their count is within a
bound, and shuffled otherwise.

Edge cases. Null and empty texts and items match nothing; rows with a null id are left out, in items and in
documents (the pipeline's stage goes by texts, so it judges those too). Repeated rows give one result row per
(doc_id, item_id). Extra columns are ignored. Empty tables give an empty result. A window of
a template must hold half literal words at least, or it is no template of a question; word for word it
may hold any, so an item of numbers alone is found by its copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import common as C
from fathomline.runtime import materialise, ship, table

WINDOW = 8
COVERAGE = 0.6
LEAST = 4
STRETCH = 64
LOG_BITS = 22
#: Item windows up to this number are broadcast (about 100 bytes each).
BROADCAST_WINDOWS = 200_000
#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s ms min h hr hours hour minutes minute seconds second days day weeks week "
    "months month years year percent usd eur gbp dollars dollar euros euro cents cent kmh mph hz khz mhz kb mb gb tb w kw j "
    "kj cal kcal v a k c f n pa degrees degree meters meter metres metre miles mile feet foot inches inch pounds pound grams "
    "gram kilograms kilogram liters liter litres litre"
).split()

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = _SMALL[128:] = True
_BREAK = np.zeros(256, bool)
_BREAK[[10, 13, 33, 46, 58, 63]] = True
_NUM, _UNIT, _NAME = C.seeded(3, 901)


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    first, last, _ = C.spans(data != 32, np.array([0, len(data)]))
    return np.sort(C.span_hashes(data, first, last))


_UNITS = _unit_hashes()


def templates(chunk: C.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its own hash, its two template hashes, and the words' borders by text."""
    raw = chunk.data
    data = C.LOWER[raw]
    keep = _WORD[raw]
    first, last, edge = C.spans(keep, chunk.starts)
    word = C.span_hashes(data, first, last)
    if not len(word):
        return word, word, word, edge
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = (digits[last] - digits[first]) * 2 > (last - first)
    after = np.zeros(len(word), bool)
    after[1:] = number[:-1]
    after[edge[:-1][edge[:-1] < len(word)]] = False
    unit = after & ~number
    at = np.flatnonzero(unit)
    unit[at] = _UNITS[np.minimum(np.searchsorted(_UNITS, word[at]), len(_UNITS) - 1)] == word[at]
    plain = np.where(number, _NUM, np.where(unit, _UNIT, word))
    breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
    opens = np.ones(len(word), bool)
    opens[1:] = breaks[first[1:]] > breaks[last[:-1]]
    opens[edge[:-1][edge[:-1] < len(word)]] = True
    name = ~opens & _UPPER[raw[first]] & _SMALL[raw[np.minimum(first + 1, last - 1)]] & ~unit
    return word, plain, np.where(name, _NAME, plain), edge


def _windows(chunk: C.Chunk, widths: list[int], whole: bool):
    """(text, start, width, track, hash, words, slots) of windows; ``whole`` keeps, of widths below the
    largest, only those that span their text. Track 2 is word for word, for windows with slots in track 0."""
    word, plain, named, edge = templates(chunk)
    n = len(word)
    if not n:
        return
    text = C.owner(edge)
    room = edge[1:][text] - np.arange(n)
    size = np.diff(edge)[text]
    lane = C.seeded(max(widths), 31)
    salt = np.array([0, 0, 1 << 20], np.uint64)
    numbers = np.concatenate([[0], np.cumsum(plain != word)])
    for track, template in ((0, plain), (1, named), (2, word)):
        slot = template != word
        slots = np.concatenate([[0], np.cumsum(slot)])
        if track == 1 and not (named != plain).any() or track == 2 and not numbers[-1]:
            continue
        changed = np.concatenate([[0], np.cumsum(named != plain)])
        for width in widths:
            fit = n - width + 1
            if fit < 1:
                continue
            ok = (room[:fit] >= width) & (2 * (slots[width:] - slots[:fit]) <= width)
            if track == 1:  # the same as in the first track without a name
                ok &= changed[width:] > changed[:fit]
            elif track == 2:  # and without a number
                ok &= numbers[width:] > numbers[:fit]
            if whole and width < max(widths):
                ok &= size[:fit] == width
            h = np.zeros(fit, np.uint64)
            for k in range(width):
                h = (h + template[k : k + fit]) * (lane[k] | np.uint64(1))
                h ^= h >> np.uint64(32)
            yield text, edge, width, track, C.mix(h + np.uint64(width) + salt[track]), ok, word, slot


_ROWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("hash", T.LongType()),
        T.StructField("slots", T.ArrayType(T.LongType())),
    ]
)


def _emit(widths: list[int], whole: bool, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bits.value if bits is not None else None
        for batch in batches:
            ids = batch.column("id")
            for chunk in C.text_chunks(batch.column("text")):
                own = ids[chunk.rows]
                for text, edge, width, _, h, ok, word, slot in _windows(chunk, widths, whole):
                    if seen is not None:
                        cell = (h >> np.uint64(64 - LOG_BITS)).astype(np.int64)
                        ok = ok & ((seen[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    grid = at[:, None] + np.arange(width)
                    held = slot[grid]
                    offsets = np.concatenate([[0], np.cumsum(held.sum(1))])
                    home = text[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.take(pa.array(home)),
                            pa.array((at - edge[home]).astype(np.int32)),
                            pa.array(np.full(len(at), width, np.int32)),
                            pa.array(np.diff(edge)[home].astype(np.int32)),
                            pa.array(h[at].view(np.int64)),
                            pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(word[grid][held].view(np.int64))),
                        ],
                        names=_ROWS.names,
                    )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in C.text_chunks(batch.column("text")):
            n = np.unique(np.diff(C.spans(_WORD[chunk.data], chunk.starts)[2]))
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32))], names=["n"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, coverage: float = COVERAGE,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, item_id, matched_words, item_words, passages, reparameterised) of items found in documents."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), F.col("text")).filter("id is not null")
    short = items.mapInArrow(_lengths, "n int").filter((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()
    widths = sorted({r["n"] for r in short} | {window})
    wanted = materialise(items.mapInArrow(_emit(widths, True, None), _ROWS), "decontam-items")
    count = wanted.count()
    cells = wanted.select(F.shiftrightunsigned("hash", 64 - LOG_BITS).cast("int").alias("c")).distinct().toArrow()
    bits = np.zeros(1 << (LOG_BITS - 3), np.uint8)  # a fixed size, and so are the cells gathered
    cell = cells.column("c").to_numpy()
    np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text")).filter("id is not null")
    found = own.mapInArrow(_emit(widths, False, spark.sparkContext.broadcast(bits)), _ROWS)
    found = found.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "width", "hash", F.col("size").alias("doc_words"), F.col("slots").alias("doc_slots"))
    asked = wanted.select(
        F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("width").alias("w"), F.col("size").alias("item_words"),
        F.col("hash").alias("h"), F.col("slots").alias("item_slots"),
    )
    if count <= broadcast_windows:
        asked = F.broadcast(asked)
    hits = found.join(asked, (F.col("hash") == F.col("h")) & (F.col("width") == F.col("w")))
    hits = hits.filter(F.size("doc_slots") == F.size("item_slots")).filter((F.col("width") >= LEAST) | (F.col("doc_words") == F.col("width")))
    # one value of the item, one value of the document: first within the window, then along the diagonal
    mapped = F.zip_with("item_slots", "doc_slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    hits = hits.select(
        "doc_id", "item_id", "item_words", "item_at", "width", (F.col("doc_at") - F.col("item_at")).alias("diagonal"),
        F.array_distinct(mapped).alias("slots"),
    )
    one_each = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))) == F.size("slots")
    kinds = F.when(F.size("slots") > 0, F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    runs = (
        hits.filter(one_each)
        .withColumn("literal", F.explode(kinds))
        .groupBy("doc_id", "item_id", "item_words", "diagonal", "literal", F.floor(F.col("item_at") / STRETCH).alias("stretch"))
        .agg(
            F.collect_set(F.struct("item_at", "width")).alias("windows"),
            F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
        )
    )
    covered = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1))))
    runs = runs.filter(one_each).select(
        "doc_id", "item_id", "item_words", "diagonal", F.array_sort(covered).alias("covered"),
        F.exists("slots", lambda s: s["i"] != s["d"]).alias("changed"),
    )
    pairs = runs.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("covered")))).cast("bigint").alias("matched_words"),
        F.max("item_words").cast("bigint").alias("item_words"),
        F.size(F.collect_set("diagonal")).cast("bigint").alias("passages"),
        F.max("changed").alias("reparameterised"),
    )
    return pairs.filter(F.col("matched_words") >= F.ceil(F.col("item_words") * coverage))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which a benchmark item occurs go, whatever their id: texts are judged."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = contaminated(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_text")).distinct()
    leaks = materialise(leaks, "decontam-leaks")
    return docs.join(leaks, F.xxhash64(docs["text"]) == leaks["leak_text"], "left_anti")
