"""Language-model scoring by online logistic context mixing.

A text is its tokens: lower-cased words, then one end. A token is coded as bits, and several hashed-context
predictors of each bit are combined by gated weights and refined adaptively (``lm_bits``); a text's own weights
learn from its bits as it goes on. Words that share a leaf of the code follow their training counts there, new
words their spelling, which a second bitwise mixer gives (``lm_spelling``); both share their leaf with what the
text itself held in it before. The score adds up log probabilities; ``bits_per_byte`` is the same over the bytes
of the words, each with a separator.

Counts of words, contexts, topics and spelling come from all training texts. A training text is scored as if the
token in hand had not been counted.

Plan. The corpus is tokenised once, in blocks that keep each distinct word once. The commonest words' company in
texts gives topics; a word has the topic in which a block holds it most. Words meet their corpus counts, topic and
spelling in one join (the commonest words are known everywhere and stay out of it), which turns blocks into leaves.
One more pass over those counts contexts as one table a task, the last one scores. Word counts grow
with the vocabulary and stay in tables; contexts are counted by leaf, so their tables are bounded, and only they,
the code and the spelling tables reach the driver.

Edge cases. A null or empty text is its end alone. A null id is a training row. Without training
rows all counts are 0 and every bit has even odds. Repeated rows and ties are rows of their own. A text longer
than a block is a block of its own and is scored piece by piece. Words are told apart by 64-bit hashes.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm import common as C
from fathomline.llm import lm_bits as B
from fathomline.llm import lm_spelling as S
from fathomline.runtime import materialise, ship

BLOCK_BYTES = 8 << 20
#: Distinct words of a partial fit of the spelling, at least, where there are so many.
LEAST_FIT = 30_000
END = np.uint64(1)
CHUNK = 1 << 14
#: Tokens whose words are looked up within their leaves at a time, of whole texts.
RUN = 1 << 17
#: A text's words in a leaf are taken to have come again so often, of so many, before the first.
AGAIN = (0.1, 2.0)

_BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("doc", T.ArrayType(T.LongType())),
        T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("edge", T.ArrayType(T.IntegerType())),
        T.StructField("octets", T.ArrayType(T.LongType())),
        T.StructField("token", T.BinaryType()),
        T.StructField("hash", T.ArrayType(T.LongType())),
        T.StructField("word", T.ArrayType(T.BinaryType())),
    ]
)
_CODED = (
    "doc array<bigint>, held array<boolean>, edge array<int>, leaf array<smallint>, octets array<bigint>, known array<bigint>, "
    "base array<double>, inner array<double>"
)

_CHUNKS = "t int, k bigint, size bigint, n binary"


@contextmanager
def _few_rows(spark: SparkSession, rows: int = 2):
    """Rows of blocks are large: an Arrow batch takes few of them, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _list(values, kind: pa.DataType) -> pa.ListArray:
    """One row that holds all values."""
    own = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)


class _Block:
    """Tokens of whole texts, gathered until there are ``BLOCK_BYTES`` of them."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids, self.held, self.counts, self.octets, self.hashes, self.data, self.first, self.last = ([] for _ in range(8))

    def add(self, ids: pa.Array, held: np.ndarray, chunk: C.Chunk) -> None:
        data, first, last, edge, h = C.words(chunk)
        self.ids.append(ids)
        self.held.append(held)
        self.counts.append(np.diff(edge))
        self.octets.append(C.segment_sum(last - first + 1, edge).astype(np.int64) + 1)
        self.hashes.append(h)
        self.first.append(first + self.bytes)
        self.last.append(last + self.bytes)
        self.data.append(data)
        self.bytes += len(data)

    def batch(self) -> pa.RecordBatch:
        count, held = np.concatenate(self.counts), np.concatenate(self.held)
        h, first, last, data = (np.concatenate(x) for x in (self.hashes, self.first, self.last, self.data))
        text = np.repeat(np.arange(len(count)), count)
        # tokens with each text's end in its place
        at = np.arange(len(h)) + text
        edge = np.concatenate([[0], np.cumsum(count + 1)])
        tokens = np.full(edge[-1], END, np.uint64)
        tokens[at] = h
        kinds, where, token, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
        # a block's words by how often it holds them, so that tokens are small numbers
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        kinds, where, token = kinds[order], where[order], rank[token.reshape(-1)]
        back = np.full(edge[-1], -1, np.int64)
        back[at] = np.arange(len(h))
        own = back[where]
        # an end's bytes are a line break, put behind the block's
        begin, stop, data = np.append(first, len(data)), np.append(last, len(data) + 1), np.append(data, np.uint8(10))
        size = stop[own] - begin[own]
        cut = np.concatenate([[0], np.cumsum(size)])
        raw = data[np.arange(cut[-1]) + np.repeat(begin[own] - cut[:-1], size)]
        words = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(raw)])
        ids = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in self.ids])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.number], pa.int64()), _list(ids, pa.int64()), _list(held, pa.bool_()), _list(edge.astype(np.int32), pa.int32()),
                _list(np.concatenate(self.octets), pa.int64()), pa.array([C.pack_counts(token)], pa.binary()), _list(kinds.view(np.int64), pa.int64()),
                _list(words, pa.binary()),
            ],
            names=_BLOCKS.names,
        )


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    block = _Block(number)
    for batch in batches:
        ids, held = batch.column("id"), batch.column("held").to_numpy(zero_copy_only=False)
        for chunk in C.text_chunks(batch.column("text")):
            block.add(ids[chunk.rows], held[chunk.rows], chunk)
            if block.bytes >= BLOCK_BYTES:
                yield block.batch()
                number += 1
                block = _Block(number)
    if block.ids:
        yield block.batch()
    del block
    C.give_back()


def _columns(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(c).slice(i, 1).flatten().to_numpy(zero_copy_only=False) for c in names]


def _tokens(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: tokens, edges, and which texts are held out."""
    held, edge = _columns(batch, i, "held", "edge")
    edge = edge.astype(np.int64)
    return C.unpack_counts(batch.column("token")[i].as_py(), edge[-1]).astype(np.int64), edge, held


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of each block's commonest words."""
    for batch in batches:
        for i in range(batch.num_rows):
            token, edge, held = _tokens(batch, i)
            (h,) = _columns(batch, i, "hash")
            n = np.bincount(token, np.repeat(~held, np.diff(edge)), len(h)).astype(np.int64)
            top = np.argsort(-n, kind="stable")[: 8 * B.WORDS]
            top = top[(n[top] > 0) & (h[top] != np.int64(END))]
            yield pa.RecordBatch.from_arrays([pa.array(h[top]), pa.array(n[top])], names=["hash", "n"])


def _own(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the commonest words, -2 for a text's end, -1 for others."""
    h = h.view(np.uint64)
    if not len(words):
        return np.where(h == END, -2, -1)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(h == END, -2, np.where(words[at] == h, at, -1))


def _company(words: np.ndarray, batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each text of a block holds each of the commonest words, and which texts are held out."""
    token, edge, held = _tokens(batch, i)
    own = _own(words, _columns(batch, i, "hash")[0])[token]
    text = C.owner(edge)
    keep = own >= 0
    return np.bincount(text[keep] * B.WORDS + own[keep], minlength=len(held) * B.WORDS).reshape(-1, B.WORDS), held


def _together(shared):
    """One row a task: how many training texts hold two common words both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((B.WORDS, B.WORDS))
        for batch in batches:
            for i in range(batch.num_rows):
                n, held = _company(shared.value, batch, i)
                some = (n[~held] > 0).astype(np.float32)
                total += some.T @ some
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["made"])

    return run


def _words(shared):
    """Each block's words, their counts in its training texts, and the topic that holds most of these (with how many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, log = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                n, _ = _company(words, batch, i)
                topic = (n @ log).argmax(1) if len(log) else np.zeros(len(n), np.int64)
                token, edge, held = _tokens(batch, i)
                h, word = batch.column("hash").slice(i, 1).flatten(), batch.column("word").slice(i, 1).flatten()
                size = np.diff(edge)
                by = np.bincount(token * B.TOPICS + np.repeat(topic, size), np.repeat(~held, size), len(h) * B.TOPICS).astype(np.int64).reshape(-1, B.TOPICS)
                most = by.argmax(1)
                best = by[np.arange(len(h)), most] * B.TOPICS + most
                cols = {"hash": h, "word": word, "n": pa.array(by.sum(1)), "best": pa.array(best)}
                yield from pa.Table.from_pydict(cols).to_batches(max_chunksize=50_000)

    return run


def _places(words):
    """Each block's words but the commonest, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (h,) = _columns(batch, i, "hash")
                at = np.flatnonzero(_own(words, h) == -1)
                block = np.full(len(at), batch.column("block")[i].as_py(), np.int64)
                cols = {"hash": pa.array(h[at]), "block": pa.array(block), "place": pa.array(at.astype(np.int32))}
                yield from pa.Table.from_pydict(cols).to_batches(max_chunksize=50_000)

    return run


def _pack(batches: Iterator[pa.RecordBatch], least: int = 200_000) -> Iterator[pa.RecordBatch]:
    """What is known of words, as one row a block for every so many of them."""
    held, rows = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        block = whole.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cols = [whole.column(c).to_numpy()[order] for c in ("place", "n", "topic", "spelled")]
        kinds, start = np.unique(block[order], return_index=True)
        for b, at, to in zip(kinds, start, np.append(start[1:], len(order)), strict=True):
            made = [c[at:to] for c in cols]
            made[3] = made[3].astype(np.float32).view(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b]), pa.array([to - at]), pa.array([C.pack_counts(np.concatenate([m.astype(np.uint32) for m in made]))], pa.binary())],
                names=["block", "size", "packed"],
            )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= least:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _strip(words):
    """Blocks with the numbers of the commonest words in place of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [C.pack_counts((_own(words, _columns(batch, i, "hash")[0]) + 2).astype(np.uint32)) for i in range(batch.num_rows)]
            size = [len(batch.column("hash")[i]) for i in range(batch.num_rows)]
            keep = [batch.column(c) for c in ("block", "doc", "held", "edge", "octets", "token")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(own, pa.binary()), pa.array(size, pa.int64())], names=_STRIPPED)

    return run


_STRIPPED = ["block", "doc", "held", "edge", "octets", "token", "own", "words"]


def _code(shared, n: int, v: int):
    """A block's texts as leaves, with their base scores and the log probabilities within leaves."""
    base_total = math.log10(n + 0.5 * (v + 1))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        code = shared.value
        made = []
        for rows in left.to_batches():
            for i in range(rows.num_rows):
                token, edge, held = _tokens(rows, i)
                own = C.unpack_counts(rows.column("own")[i].as_py(), rows.column("words")[i].as_py()).astype(np.int64) - 2
                count, topic, spelled = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own))
                for size, packed in zip(right.column("size").to_pylist(), right.column("packed"), strict=True):
                    place, c, t, s = C.unpack_counts(packed.as_py(), 4 * size).reshape(4, -1)
                    count[place], topic[place], spelled[place] = c, t, s.view(np.float32)
                count[own >= 0] = code.counts[own[own >= 0]]
                count[own == -2] = code.weight[code.end]
                ways = [code.leaves(own, c, topic) for c in (np.maximum(count - 1, 0), count)]
                kind = np.repeat(held, np.diff(edge)).astype(np.int64)
                leaf = np.stack([w[0] for w in ways])[kind, token]
                share = np.stack([np.where(w[0] == code.new, spelled, w[1]) for w in ways])[kind, token]
                base = (np.log10(count + 0.5) - base_total)[token]
                made.append(
                    [
                        rows.column("doc").slice(i, 1), rows.column("held").slice(i, 1), rows.column("edge").slice(i, 1),
                        _list(leaf.astype(np.int16), pa.int16()), rows.column("octets").slice(i, 1),
                        _list(np.add.reduceat((count > 0)[token].astype(np.int64), edge[:-1]), pa.int64()),
                        _list(np.add.reduceat(base, edge[:-1]), pa.float64()), _list(within(code, leaf, token, share, edge), pa.float64()),
                    ]
                )
        names = ["doc", "held", "edge", "leaf", "octets", "known", "base", "inner"]
        C.give_back()
        return pa.concat_tables([pa.Table.from_arrays(m, names=names) for m in made])

    return run


def within(code: B.Code, leaf: np.ndarray, token: np.ndarray, share: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Log probability of each text's words within their leaves: their shares there, mixed with what the text itself held
    there before, by how often the text's words in the leaf have come again so far."""
    made, begin = np.zeros(len(edge) - 1), 0
    while begin < len(made):  # some texts at a time: what is sorted is many times their tokens
        end = max(int(np.searchsorted(edge, edge[begin] + RUN, "right")) - 1, begin + 1)
        own = slice(edge[begin], edge[end])
        made[begin:end] = _within(code, leaf[own], token[own], share[own], edge[begin : end + 1] - edge[begin])
        begin = end
    return made


def _within(code: B.Code, leaf: np.ndarray, token: np.ndarray, share: np.ndarray, edge: np.ndarray) -> np.ndarray:
    at = np.flatnonzero((leaf >= len(code.words)) & (leaf != code.end))
    text = C.owner(edge)[at]
    word, _ = _before(text * (int(token.max(initial=0)) + 1) + token[at], np.zeros(len(at), np.int64))
    there, again = _before(text * (code.end + 1) + leaf[at], (word > 0).astype(np.int64))
    part = (again + AGAIN[0]) / (there + AGAIN[1])
    part[there == 0] = 0
    # a long word's spelling may be too small for a float
    p = np.logaddexp(np.log1p(-part) + share[at], np.log(np.maximum(part * word / np.maximum(1, there), 1e-300)))
    return np.bincount(text, p, len(edge) - 1)


def _before(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many earlier items have the same key, and the sum of their values."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    at = np.arange(len(own))
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    total = np.concatenate([[0], np.cumsum(value[order])])
    n, made = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    n[order], made[order] = at - head, total[at] - total[head]
    return n, made


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves and edges of the training texts of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            held, edge, leaf = _columns(batch, i, "held", "edge", "leaf")
            size = np.diff(edge)
            yield leaf[np.repeat(~held, size)].astype(np.int64), np.concatenate([[0], np.cumsum(size[~held])]).astype(np.int64)


def _count(shared):
    """Bit counts of a task's training texts, in chunks of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.empty()
        for leaf, edge in _training(batches):
            shared.value.count(tables, leaf, edge)
        for t, table in enumerate(tables):
            for k in range(0, len(table), CHUNK):
                if (own := table[k : k + CHUNK]).any():
                    cols = [pa.array([t], pa.int32()), pa.array([k]), pa.array([len(own)]), pa.array([C.pack_counts(own)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["t", "k", "size", "n"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    parts = [C.unpack_counts(raw.as_py(), table.column("size")[0].as_py()).astype(np.uint64) for raw in table.column("n")]
    # a table's slots keep at most what 32 bits hold
    made = C.pack_counts(np.minimum(sum(parts), 0xFFFFFFFF).astype(np.uint32))
    return pa.table({"t": table.column("t")[:1], "k": table.column("k")[:1], "size": table.column("size")[:1], "n": pa.array([made], pa.binary())})


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, edge, leaf, octets, known, base, inner = _columns(batch, i, "held", "edge", "leaf", "octets", "known", "base", "inner")
                edge = edge.astype(np.int64)
                score = (shared.value.log(leaf.astype(np.int64), edge, held) + inner) / math.log(10)
                bits = -score * math.log2(10)
                cols = {
                    "doc_id": batch.column("doc").slice(i, 1).flatten(), "held_out": held, "n_tokens": np.diff(edge), "n_known": known,
                    "base_score": base, "score": score, "bits_per_token": bits / np.diff(edge), "bits_per_byte": bits / octets,
                }
                yield from pa.Table.from_pydict({k: x if isinstance(x, pa.Array) else pa.array(x) for k, x in cols.items()}).to_batches()

    return run


def _gather(frame: DataFrame, step) -> list:
    """What each of as many tasks as the cluster runs at once makes of its rows."""
    lanes = frame.sparkSession.sparkContext.defaultParallelism
    return [pickle.loads(bytes(r["made"])) for r in frame.coalesce(lanes).mapInArrow(step, "made binary").collect()]


def _speller(known: DataFrame, distinct: int) -> S.Mixer:
    sc = known.sparkSession.sparkContext
    weight = np.zeros(256, np.int64)
    for r in known.select("word").mapInArrow(S.count_bytes, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        weight[r["b"]] = r["n"]
    tree = S.Tree(weight)
    # as many partial tables as the cluster runs at once, so what is added up does not grow with the corpus
    counted = (
        known.select("word").coalesce(sc.defaultParallelism).mapInArrow(S.learn(sc.broadcast(tree)), "t int, k int, n binary")
        .groupBy("t", "k").applyInArrow(S.sum_chunks, "t int, k int, n binary")
    )
    tables = np.zeros((S.TABLES, 2 << S.LOG_SLOTS), np.float32)
    plain = np.zeros(2 * S.CHUNK, np.float32)
    for r in counted.collect():  # a fixed number of rows: the tables' chunks
        part = np.frombuffer(bytes(r["n"]), np.float32)
        if r["t"] == S.TABLES:
            plain += part
        else:
            tables[r["t"], 2 * r["k"] * S.CHUNK : 2 * (r["k"] + 1) * S.CHUNK] = part
    mixer = S.Mixer(tree, tables, plain)
    mixer.freeze()
    # partial fits of LEAST_FIT words each or more, averaged
    fits = known.select("hash", "word").coalesce(max(1, min(sc.defaultParallelism, distinct // LEAST_FIT)))
    mixer.average([x for x in _gather(fits, S.fit(sc.broadcast(mixer))) if x is not None])
    return mixer


def mixing_scores(docs: DataFrame, *, folds: int = 5, held: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_token, bits_per_byte) of every row."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    own = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text"), (C.fold(F.col("doc_id"), folds) == held).alias("held"))
    blocks = materialise(own.mapInArrow(_tokenise, _BLOCKS), "lm-blocks", "zstd")
    parts = blocks.select("held", "edge", "token", "hash")
    with _few_rows(spark):
        common = parts.mapInArrow(_tally, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
        common = common.filter("n >= 2").orderBy(F.desc("n"), "hash").limit(B.WORDS).select("hash").collect()
        words = np.sort(np.array([r["hash"] for r in common], np.int64).view(np.uint64))
        together = sum(_gather(parts, _together(sc.broadcast(words))), np.zeros((B.WORDS, B.WORDS)))
        np.fill_diagonal(together, 0)
        log = B.topics(together)
        every = blocks.select("held", "edge", "token", "hash", "word").mapInArrow(_words(sc.broadcast((words, log))), "hash bigint, word binary, n bigint, best bigint")
        topic = F.pmod(F.max("best"), F.lit(B.TOPICS)).cast("int").alias("topic")
        vocabulary = materialise(every.groupBy("hash").agg(F.first("word").alias("word"), F.sum("n").alias("n"), topic), "lm-words", "zstd")
    end = F.col("hash") == F.lit(int(END))
    known = vocabulary.filter("n > 0")
    n, v, texts = known.agg(F.sum("n"), F.count(F.lit(1)), F.max(F.when(end, F.col("n")))).first()
    counts = {r["hash"]: r["n"] for r in known.filter(F.col("hash").isin([r["hash"] for r in common])).select("hash", "n").collect()} if common else {}
    counts = np.array([counts[int(h)] for h in words.view(np.int64)], np.int64)
    shared_leaf = known.filter(~end & ~F.col("hash").isin([r["hash"] for r in common])) if common else known.filter(~end)
    band = sum((F.col("n") >= c).cast("int") for c in B.BANDS)
    kinds = shared_leaf.groupBy("topic", F.when(F.col("n") <= 2, F.col("n")).alias("few"), band.alias("band")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
    mass, once, twice = np.zeros((B.TOPICS, len(B.BANDS) + 1), np.int64), np.zeros(B.TOPICS, np.int64), np.zeros(B.TOPICS, np.int64)
    for r in kinds.collect():  # a row a topic and band
        if r["few"] == 1:
            once[r["topic"]] += r["words"]
        else:
            mass[r["topic"], r["band"]] += r["n"]
            twice[r["topic"]] += r["words"] if r["few"] == 2 else 0
    code = B.Code(words, counts, mass, once, twice, int(texts or 0))
    spelled = vocabulary.mapInArrow(S.spell(sc.broadcast(_speller(known.filter(~end), int(v)))), "hash bigint, n bigint, topic int, spelled float")
    placed = blocks.select("hash", "block").mapInArrow(_places(words), "hash bigint, block bigint, place int")
    here = placed.join(spelled, "hash").select("block", "place", "n", "topic", "spelled").mapInArrow(_pack, "block bigint, size bigint, packed binary")
    stripped = "block bigint, doc array<bigint>, held array<boolean>, edge array<int>, octets array<bigint>, token binary, own binary, words bigint"
    whole = blocks.drop("word").mapInArrow(_strip(words), stripped)
    coded = whole.groupBy("block").cogroup(here.groupBy("block")).applyInArrow(_code(sc.broadcast(code), int(n or 0), int(v)), _CODED)
    coded = materialise(coded, "lm-coded", "zstd")
    train = coded.select("held", "edge", "leaf")
    with _few_rows(spark):
        model = B.Model(code, log[: len(words)], B.log_slots(int(n or 0)))
        counted = train.coalesce(sc.defaultParallelism).mapInArrow(_count(sc.broadcast(model)), _CHUNKS)
        tables = model.empty()
        for r in counted.groupBy("t", "k").applyInArrow(_sum, _CHUNKS).collect():  # a fixed number of rows: the tables' chunks
            tables[r["t"]][r["k"] : r["k"] + r["size"]] = C.unpack_counts(bytes(r["n"]), r["size"])
        model.freeze(tables)
        columns = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, bits_per_token double, bits_per_byte double"
        scored = materialise(coded.mapInArrow(_score(sc.broadcast(model)), columns), "lm-scores", "zstd")
    names = ("base_score", "score", "bits_per_token", "bits_per_byte")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n or 0)).cast("bigint").alias("train_tokens"), *names)
