"""Spelling of words by bitwise context mixing.

A word's bytes and an end mark are coded by a binary tree (Huffman's, from the training words' bytes),
so a byte is a few bits. For each bit, hashed contexts of the previous 1, 2, 3 and 5 bytes and of the
whole beginning of the word look up how often the bit was 1 before. The predictors, as log odds, are
combined by weights that a gate picks: how often the contexts of 3 and of 5 bytes were seen. A last table, indexed by the
mixed odds and the gate, is moved towards the bits that came and refines the odds.

Counts come from every distinct training word. Weights and refinement are learned online on all of
them, in partial fits that are averaged, each word seen as if it were new: its own counts are taken out.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa

from fathomline.llm import common as C
from fathomline.llm.training import sigmoid

ORDERS = (1, 2, 3, 5)
LOG_SLOTS = 20
#: Hashed contexts: the orders, and the word's beginning.
TABLES = len(ORDERS) + 1
#: Tables whose counts pick the gate, and the counts at which the gate changes.
GATED, SURE = (2, 3), (1, 3, 10)
GATES = (len(SURE) + 1) ** 2
PRIOR = 0.4
PIECE = 1 << 13
CHUNK = 1 << 12
STOP = 32
BUCKETS = 33
REACH = 8.0
_SALT = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class Tree:
    """Binary code of the 256 bytes: the nodes and bits on the way to each."""

    def __init__(self, weight: np.ndarray):
        heap = [(int(w) + 1, i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        children, node = {}, 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], node, node))
            node += 1
        paths: dict[int, list[tuple[int, int]]] = {}
        walk = [(heap[0][2], [])]
        while walk:
            at, path = walk.pop()
            if at < 256:
                paths[at] = path
            else:
                walk += [(child, [*path, (at - 256, bit)]) for bit, child in enumerate(children[at])]
        self.size = np.array([len(paths[s]) for s in range(256)])
        depth = int(self.size.max())
        self.node = np.zeros((256, depth), np.uint16)
        self.bit = np.zeros((256, depth), np.uint8)
        for s, path in paths.items():
            for k, (n, b) in enumerate(path):
                self.node[s, k], self.bit[s, k] = n, b


def symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each with its end mark, and where each word begins."""
    words = words.cast(pa.large_binary())
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    size = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(starts[-1], STOP, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(n), size)] = raw
    return out, starts


def events(tree: Tree, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Every bit of the words: (word, node, bit, slots by table)."""
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(data)) - starts[:-1][word]
    value = data.astype(np.uint64) + np.uint64(1)
    before = []
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros(len(data), np.uint64)
        back[k:] = value[:-k]
        back *= place >= k
        before.append(back)
    contexts = []
    for order in ORDERS:
        h = np.full(len(data), order, np.uint64)
        for back in before[:order]:
            h += back
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        contexts.append(h)
    up, down = C._Powers.get(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(C._SYMBOL[data] * up, out=total[1:])
    first = starts[:-1].take(word)
    contexts.append(C.mix((total[:-1] - total.take(first)) * down.take(first) + np.uint64(99)))
    many = tree.size.take(data)
    at = np.repeat(data * np.int64(tree.node.shape[1]) - np.cumsum(many) + many, many)
    at += np.arange(len(at))
    node, bit = tree.node.ravel().take(at).astype(np.int64), tree.bit.ravel().take(at)
    salt = _SALT.take(node)
    slots = []
    for h in contexts:
        x = np.repeat(h, many)
        x ^= salt
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - LOG_SLOTS)
        slots.append(x.view(np.int64))
    return np.repeat(word, many), node, bit, slots


def _pieces(starts: np.ndarray) -> Iterator[slice]:
    """Runs of words with about ``PIECE`` bytes."""
    at = 0
    while at < len(starts) - 1:
        to = max(int(np.searchsorted(starts, starts[at] + PIECE, "right")) - 1, at + 1)
        yield slice(at, to)
        at = to


def _cut(data: np.ndarray, starts: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    own = starts[part.start : part.stop + 1]
    return data[own[0] : own[-1]], own - own[0]


def learn(shared):
    """Bit counts of a task's words, in chunks of each table (the last table: by node alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        total = np.zeros((TABLES, 2 << LOG_SLOTS), np.uint32)
        plain = np.zeros(2 * CHUNK, np.uint32)
        for batch in batches:
            data, starts = symbols(batch.column("word"))
            for part in _pieces(starts):
                _, node, bit, slots = events(tree, *_cut(data, starts, part))
                plain += np.bincount(node * 2 + bit, minlength=2 * CHUNK).astype(np.uint32)
                for t in range(TABLES):
                    np.add.at(total[t], slots[t] * 2 + bit, np.uint32(1))
        rows = [(TABLES, 0, plain)]
        rows += [(t, k, total[t, 2 * k * CHUNK : 2 * (k + 1) * CHUNK]) for t in range(TABLES) for k in range((1 << LOG_SLOTS) // CHUNK)]
        for at in range(0, len(rows), 64):
            some = [r for r in rows[at : at + 64] if r[2].any()]
            if some:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()),
                        pa.array([C.pack_counts(r[2]) for r in some], pa.binary()),
                    ],
                    names=["t", "k", "n"],
                )

    return run


def sum_chunks(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * CHUNK, np.float32)
    for raw in table.column("n"):
        total += C.unpack_counts(raw.as_py(), 2 * CHUNK)
    return pa.table({"t": table.column("t")[:1], "k": table.column("k")[:1], "n": pa.array([total.tobytes()], pa.binary())})


class Mixer:
    """Bit counts, gated weights and the refinement table."""

    def __init__(self, tree: Tree, tables: np.ndarray, plain: np.ndarray):
        self.tree, self.tables, self.plain = tree, tables, plain
        self.weight = np.full((GATES, TABLES + 1), 0.25)
        line = np.linspace(-REACH, REACH, BUCKETS)
        self.apm = np.repeat(line[None], GATES, 0)

    def freeze(self) -> None:
        """Counts (tables x slots x 2) to log odds: as they are, and without a 0 or a 1 of the word's own."""
        n = self.tables.reshape(TABLES, -1, 2)
        top = n.max(-1)
        few = np.where(top > 255, np.float32(255) / np.maximum(top, 1), np.float32(1)).astype(np.float32)
        n = np.ceil(np.minimum(n * few[..., None], 255)).astype(np.uint16)
        self.states = n[..., 0] << np.uint16(8) | n[..., 1]
        state = np.arange(1 << 16)
        n = np.stack([state >> 8, state & 255], -1).astype(np.float64)
        own = np.where(n.max(1) < 255, 1.0, 0.0)[:, None]
        less = [n, *(np.maximum(n - own * np.eye(2)[k], 0) for k in (0, 1))]
        self.odds = np.stack([np.log((x[:, 1] + PRIOR) / (x[:, 0] + PRIOR)) for x in less]).astype(np.float32).ravel()
        self.sure = np.stack([np.digitize(x.sum(1), SURE) for x in less]).astype(np.int8).ravel()
        plain = self.plain.reshape(-1, 2)
        self.flat = np.log((plain[:, 1] + PRIOR) / (plain[:, 0] + PRIOR)).astype(np.float32)
        self.tables = self.plain = None

    def inputs(self, node, bit, slots, own: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Predictors' log odds (tables + 1 x bits) and the gate; ``own`` is taken from the bit's count."""
        x = np.empty((TABLES + 1, len(node)), np.float32)
        gate = np.zeros(len(node), np.int64)
        x[0] = self.flat.take(node)
        shift = (bit + np.int64(1)) * (np.asarray(own) != 0) << 16
        for t in range(TABLES):
            state = self.states[t].take(slots[t]) + shift
            x[t + 1] = self.odds.take(state)
            if t in GATED:
                gate *= len(SURE) + 1
                gate += self.sure.take(state)
        return x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weight = self.weight.T.astype(np.float32, order="C")
        dot = x[0] * weight[0].take(gate)
        for k in range(1, TABLES + 1):
            dot += x[k] * weight[k].take(gate)
        return dot

    def refined(self, dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log odds after the table: half as mixed, half as the table has it, between its two nearest cells."""
        spot = (np.clip(dot, -REACH, REACH - 1e-3) + REACH) * ((BUCKETS - 1) / (2 * REACH))
        low = spot.astype(np.int64)
        part = spot - low
        low += gate * BUCKETS
        return 0.5 * dot + 0.5 * (self.apm.ravel().take(low) * (1 - part) + self.apm.ravel().take(low + 1) * part)

    def train(self, words: pa.Array, batch: int = 4096) -> np.ndarray:
        """Learns weights and refinement from all bits; returns the number of bits by gate."""
        data, starts = symbols(words)
        seen = np.zeros(GATES)
        for part in _pieces(starts):
            _, node, bit, slots = events(self.tree, *_cut(data, starts, part))
            x, gate = self.inputs(node, bit, slots, True)
            for at in range(0, len(bit), batch):
                cut = slice(at, at + batch)
                own, g = x[:, cut], gate[cut]
                dot = self.mixed(own, g)
                err = bit[cut] - sigmoid(dot)
                n = np.bincount(g, minlength=GATES)
                seen += n
                rate = 0.05 / np.sqrt(1 + seen / 20_000) / np.sqrt(np.maximum(1, n))
                for k in range(TABLES + 1):
                    self.weight[:, k] += rate * np.bincount(g, err * own[k], GATES)
                self._adapt(dot, g, bit[cut])
        return seen

    def average(self, fits: list) -> None:
        """Takes the mean of partial fits, by the bits each gate saw."""
        total = sum((n for _, _, n in fits), np.zeros(GATES))
        for g in np.flatnonzero(total):
            self.weight[g] = sum(w[g] * n[g] for w, _, n in fits) / total[g]
            self.apm[g] = sum(a[g] * n[g] for _, a, n in fits) / total[g]

    def _adapt(self, dot, gate, bit) -> None:
        spot = np.rint((np.clip(dot, -REACH, REACH) + REACH) * ((BUCKETS - 1) / (2 * REACH))).astype(np.int64)
        cell = gate * BUCKETS + spot
        err = np.bincount(cell, bit - sigmoid(self.apm).ravel().take(cell), self.apm.size)
        n = np.bincount(cell, minlength=self.apm.size)
        self.apm += (0.5 * err / np.sqrt(np.maximum(1, n)) * 0.2).reshape(self.apm.shape)

    def log(self, words: pa.Array, known: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word's spelling; ``known`` words are spelled without their own counts."""
        data, starts = symbols(words)
        out = np.zeros(len(starts) - 1)
        for part in _pieces(starts):
            word, node, bit, slots = events(self.tree, *_cut(data, starts, part))
            x, gate = self.inputs(node, bit, slots, known[part][word] if known is not None else 0.0)
            z = self.refined(self.mixed(x, gate), gate).astype(np.float32)
            z *= 1 - 2 * bit.astype(np.float32)
            cost = np.log1p(np.exp(np.clip(z, -60, 60)))
            # every word has an end's bits at least
            out[part] = -np.add.reduceat(cost, np.flatnonzero(np.diff(word, prepend=-1)), dtype=np.float64)
        return out


def fit(shared):
    """Weights and refinement learned from all words of a task, and how many bits each gate saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("hash"), b.column("word")) for b in batches if b.num_rows]
        made = None
        if rows:
            base = shared.value
            own = copy(base)
            own.weight, own.apm = base.weight.copy(), base.apm.copy()
            order = np.argsort(np.concatenate([h.to_numpy() for h, _ in rows]), kind="stable")
            seen = own.train(pa.concat_arrays([w for _, w in rows]).take(pa.array(order)))
            made = own.weight, own.apm, seen
        del rows
        C.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["made"])

    return run


def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(symbols(batch.column("word"))[0], minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256, dtype=np.int32)), pa.array(total)], names=["b", "n"])


def spell(shared):
    """Of each word: its training count and topic, and the log of its spelling where training holds it once or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("n").to_numpy()
            rare = np.flatnonzero(count <= 1)
            log = np.zeros(len(count), np.float32)
            log[rare] = shared.value.log(batch.column("word").take(pa.array(rare)), count[rare] == 1)
            cols = [batch.column("hash"), batch.column("n"), batch.column("topic"), pa.array(log)]
            yield pa.RecordBatch.from_arrays(cols, names=["hash", "n", "topic", "spelled"])

    return run
