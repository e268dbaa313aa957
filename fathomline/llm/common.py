"""Text plumbing shared by the operators: Arrow chunks, byte-level words and their hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the word definition: space and the bytes 9 to 13.
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def fold(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; a null key falls in fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(n), F.lit(0)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` 64-bit words that depend on the seed only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_SYMBOL = seeded(256, 11)
_P = np.uint64(0x5851F42D4C957F2D)
_P_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            steps = np.full(size, _P, np.uint64)
            steps[0] = 1
            cls.up = np.multiply.accumulate(steps)
            steps[1:] = _P_INV
            cls.down = np.multiply.accumulate(steps)
        return cls.up[:n], cls.down[:n]


class Chunk:
    """Some whole texts of an Arrow batch: bytes, and where each text starts and ends."""

    def __init__(self, rows: slice, data: np.ndarray, starts: np.ndarray):
        self.rows, self.data, self.starts = rows, data, starts

    @property
    def n(self) -> int:
        return len(self.starts) - 1


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Split a string column into chunks of about ``limit`` bytes; null texts count as empty.

    A text is never cut: one longer than the limit is a chunk of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        to = min(to, n)
        yield Chunk(slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    if n and offsets[n] - offsets[0] > 8 << 20:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on and share an executor's limit with its heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def spans(keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a text's border: (start, end, first run of each text)."""
    n = len(keep)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    inner = starts[(starts > 0) & (starts < n)]
    begin[inner] = keep[inner]
    stop = keep.copy()
    stop[:-1] &= ~keep[1:]
    stop[inner - 1] = keep[inner - 1]
    first, last = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return first, last, np.searchsorted(first, starts)


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, symbol: np.ndarray = _SYMBOL) -> np.ndarray:
    """64-bit hash of every span's bytes; equal bytes give equal hashes wherever they stand."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(symbol[data] * up, out=total[1:])
    length = (last - first).astype(np.uint64)
    return mix((total[last] - total[first]) * down[first] + length * np.uint64(0xA0761D6478BD642F))


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a chunk: (bytes, start, end, first word of each text, word hash)."""
    data = LOWER[chunk.data]
    first, last, edge = spans(~_WS[data], chunk.starts)
    return data, first, last, edge, span_hashes(data, first, last)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: low bytes apart from the few high ones."""
    flat = np.ascontiguousarray(counts, np.uint32).view(np.uint8).reshape(-1, 4)
    return pa.compress(np.ascontiguousarray(flat.T).tobytes(), codec="zstd", asbytes=True)


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view(np.uint32).ravel()


def owner(edge: np.ndarray) -> np.ndarray:
    """For items grouped by text (``edge`` as from ``spans``): the text each belongs to."""
    return np.repeat(np.arange(len(edge) - 1), np.diff(edge))


def segment_sum(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sum of the items of each text; texts without items give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[edge[1:]] - total[edge[:-1]]
