"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A document's ids are its text's ids and one end id; only documents longer than the capacity are
cut, into capacity-long pieces and a last one. Which pieces share a sequence depends on their
lengths alone, so the packing problem is solved on the histogram of lengths: at most ``capacity``
classes whatever the input. The driver works on that histogram only; it gives runs (length, ranks
from-to, first sequence, offset), of which there are at most a few per pair of lengths.

Reduction: a set of pieces dominates when some best packing surely holds it. For each length
from the largest down, in this order:
  * nothing else fits beside it: it is alone;
  * a piece fills the rest exactly: that pair is fixed;
  * no two remaining pieces fit beside it together: it is fixed with the largest single that fits.
Whole classes are fixed at once. What is left goes best-fit by falling length.

Each piece's rank among its length is found without gathering a length in one task: pieces carry
a hashed block, blocks are ranked by counts per (length, block), and rows within theirs.

Edge cases. Null or empty text: the end id alone. Null id: packed like any other row, id null.
Repeated rows and ties: each row is a document; equal keys keep an arbitrary but complete order.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from fathomline.llm import common as C
from fathomline.runtime import materialise, ship, shuffle_width

CAPACITY = 4096
END_ID = 1
#: Words a worker remembers before it starts afresh.
CACHE_WORDS = 150_000

_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


class WordTokenizer:
    """Ids of a text, one white-space word at a time.

    The vocabulary drops white space, so a text's ids are its words' ids in order, and each
    distinct word is encoded once. Words of Latin letters, digits and ASCII marks are encoded in
    bulk by the same merges held as ranks (the end-of-word mark is a NUL byte merged first);
    any other word goes through the tokenizer file itself.
    """

    PLAIN = re.compile("[\\x21-\\x7e\\xa1-\\u024f]+")
    _PART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self._fast = self._table = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = any(step.get("pattern", {}).get("Regex") == self._PART for step in steps)
        if known and spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>":
            self._prepare(spec["model"])

    def _prepare(self, model: dict) -> None:
        vocab = model["vocab"]
        # byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        back = {c: b for b, c in letter.items()}

        def raw(token: str) -> bytes:
            ended = token.endswith("</w>")
            body = bytes(back[c] for c in (token[:-4] if ended else token))
            return body + b"\0" if ended else body

        ranks, ids = {}, []

        def put(token: bytes, i: int) -> None:
            if token not in ranks:
                ranks[token] = len(ids)
                ids.append(i)

        for b in range(256):
            put(bytes([b]), vocab[letter[b]])
        for b in range(256):
            put(bytes([b, 0]), vocab[letter[b] + "</w>"])
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            put(raw(left + right), vocab[left + right])
        self._stop = len(ids)
        self._table = np.array([*ids, 0], np.uint32)
        self._fast = tiktoken.Encoding(
            "word_end", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={}
        )
        self._bar = ranks[b"\n"]
        self._part = regex.compile(self._PART)

    def learn(self, new: list[bytes]) -> None:
        plain, other = [], []
        for w in new:
            s = w.decode()
            (plain if self._fast and self.PLAIN.fullmatch(s) and "<|" not in s else other).append((w, s))
        if plain:
            joined = self._part.sub("\\g<0>\0", "\n".join(s.lower() for _, s in plain))
            got = np.array(self._fast.encode_ordinary(joined), np.int64)
            cuts = np.flatnonzero(got == self._bar)
            data = self._table[got].astype("<u4").tobytes()
            edges = [-1, *cuts.tolist(), len(got)]
            for (w, _), a, b in zip(plain, edges, edges[1:], strict=False):
                self.known[w] = data[4 * a + 4 : 4 * b]
        for (w, s), e in zip(other, self.slow.encode_batch([s for _, s in other], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        split = [t.split() for t in texts]
        known = self.known
        new = [w for w in set().union(*split) if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = list(set().union(*split))
        if new:
            self.learn(new)
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_READY: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer of a file, made once: its tables take longer to build than many a task to run."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = WordTokenizer(path)
    return _READY[path]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        try:
            for batch in batches:
                for chunk in C.text_chunks(batch.column("text")):
                    raw = chunk.data.tobytes()
                    cut = chunk.starts.tolist()
                    texts = [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]
                    row, piece, start, length, crc = [], [], [], [], []
                    for i, ids in enumerate(tok.encode(texts)):
                        ids += end
                        for k, at in enumerate(range(0, len(ids), step)):
                            part = ids[at : at + step]
                            row.append(i)
                            piece.append(k)
                            start.append(at // 4)
                            length.append(len(part) // 4)
                            crc.append(zlib.crc32(part))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id")[chunk.rows].take(pa.array(row, pa.int64())),
                            pa.array(piece, pa.int32()),
                            *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                        ],
                        names=_PIECES.names,
                    )
        finally:  # workers live on: the words a task remembers go with it, the tables stay
            tok.known = {}
            C.give_back()

    return run


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(_cut(path, capacity, end_id), _PIECES)


class _Counts:
    """Multiset of lengths with ordered access to those still present."""

    def __init__(self, histogram: dict[int, int]):
        self.n = {k: v for k, v in histogram.items() if v > 0}
        self.keys = sorted(self.n)
        self.used: dict[int, int] = defaultdict(int)

    def take(self, length: int, count: int) -> int:
        """Removes ``count`` of a length; returns the rank of the first."""
        first = self.used[length]
        self.used[length] += count
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            del self.keys[bisect.bisect_left(self.keys, length)]
        return first

    def lowest(self, k: int) -> int | None:
        """Sum of the ``k`` smallest pieces; None if there are fewer."""
        total = 0
        for length in self.keys:
            m = min(k, self.n[length])
            total += m * length
            k -= m
            if not k:
                return total
        return None

    def at_most(self, limit: int) -> int | None:
        i = bisect.bisect_right(self.keys, limit)
        return self.keys[i - 1] if i else None


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], dict[str, int]]:
    """Runs (length, rank from, rank to, first sequence, offset) and statistics of the packing.

    Piece number r of a length, from <= r < to, goes into sequence first + r - from at that offset.
    """
    bag = _Counts(histogram)
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def place(length: int, count: int, sequence: int, offset: int) -> None:
        first = bag.take(length, count)
        runs.append((length, first, first + count, sequence, offset))

    total = sum(k * v for k, v in bag.n.items())
    for length in sorted(bag.keys, reverse=True):
        while have := bag.n.get(length):
            room = capacity - length
            mate = bag.at_most(room)
            if mate == length and have == 1:
                mate = bag.at_most(length - 1)
            if mate is None:  # alone
                place(length, have, bins, 0)
                bins += have
                break
            two = bag.lowest(2)  # counts the piece itself too: too low at worst, which only keeps it
            if mate != room and two is not None and two <= room:
                break
            pairs = have // 2 if mate == length else min(have, bag.n[mate])
            place(length, pairs, bins, 0)
            place(mate, pairs, bins, length)
            bins += pairs
    fixed = bins
    # best fit by falling length: open holds runs of equal sequences as (first, count) by room
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def offer(room: int, first: int, count: int) -> None:
        if room not in open_:
            bisect.insort(rooms, room)
        open_[room].append((first, count))

    while bag.keys:
        length = bag.keys[-1]
        left = bag.n[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                whole, over = divmod(left, each)
                for slot in range(each):
                    if whole:
                        place(length, whole, bins, slot * length)
                if whole:
                    offer(capacity - each * length, bins, whole)
                    bins += whole
                for slot in range(over):
                    place(length, 1, bins, slot * length)
                if over:
                    offer(capacity - over * length, bins, 1)
                    bins += 1
                left = 0
                continue
            room = rooms[i]
            first, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                del rooms[i]
            m = min(count, left)
            place(length, m, first, capacity - room)
            left -= m
            if count > m:
                offer(room, first + m, count - m)
            offer(room - length, first, m)
    return runs, {"sequences": bins, "fixed": fixed, "bound": -(-total // capacity)}


_PLACED = T.StructType([*_PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def _locate(runs):
    """Sequence and offset of pieces from their length and rank, by binary search in the runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = runs.value
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(length * (1 << 48) + first, size * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in _PIECES.names),
                    pa.array(sequence[at] + rank - first[at]),
                    pa.array(offset[at]),
                ],
                names=_PLACED.names,
            )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``pieces`` must be a written table."""
    spark = pieces.sparkSession
    width = max(64, 4 * shuffle_width(spark))
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int"))
    counts = materialise(blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    rows = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    runs, _ = solve({r["length"]: r["n"] for r in rows}, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((table[:, 0], table[:, 1], table[:, 3], table[:, 4]))
    base = counts.selectExpr(
        "length", "block", "sum(n) over (partition by length order by block rows unbounded preceding) - n as base"
    )
    ranked = blocked.selectExpr(
        "*", "row_number() over (partition by block, length order by doc_id, piece) - 1 as nth"
    ).join(base, ["length", "block"])
    return ranked.select(*_PIECES.names, (F.col("nth") + F.col("base")).cast("bigint").alias("rank")).mapInArrow(
        _locate(shared), _PLACED
    )


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(materialise(tokenised_pieces(docs, path, capacity, end_id), "packing-pieces"), capacity)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    return public_tokenizers.path(name)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of all documents."""
    return packed_sequences(docs, vocabulary())
