"""Bitwise context mixing over the words of a text.

Code. A word is a leaf of a binary (Huffman) tree: each of the commonest training words has a leaf of
its own, others share a leaf with words of their topic that are about as frequent, words that training
holds once share one with those of their topic, new words have one leaf, and so has a text's end. A token
is the bits on the way to its leaf. A training text's own token is not counted: a word that only it holds
is new.

Predictors. For each bit, the counts of its node in these contexts give log odds: none, the topic of
the text so far, the leaf before, the two leaves before (hashed), and the text's own earlier tokens. Bits
of training texts are scored as if they had not been counted.

Mixing. The odds are combined by weights that a gate picks (how often the leaf before, and this text, were at the
node), plus weights of the text's own, and refined by a correction of the text's own that depends on the mixed odds.
The gate's weights are constants; what belongs to the text starts at 0 and learns from its bits as it goes on, in
steps of 32 tokens that grow to 1,024, always after they were scored. So a score hangs on the text and on what was
counted, not on other texts that are scored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np

from fathomline.llm import common as C

#: Leaves of single words at most; topics, and the counts at which a word passes to the next leaf of its topic.
WORDS, TOPICS, BANDS = 254, 8, (8, 64)
TOPIC_WINDOW = 64
#: Slots of the hashed table: one for every counted token, between these powers of two.
LEAST_SLOTS, MOST_SLOTS = 16, 20
PRIOR = 0.4
INPUTS = 5
#: Weights of the predictors, by how sure the leaf before is (3) and how often the text was at the node (4).
GATED = np.array(
    [
        [none, topic, before, pair, text]
        for none, topic, before, pair in ((0.15, 0.75, 0.4, 0.2), (0.15, 0.65, 0.6, 0.3), (0.1, 0.4, 0.4, 0.45)) for text in (0.0, 0.1, 0.15, 0.3)
    ],
    np.float32,
)
#: Learning rates of a text's weights and corrections; corrections by mixed odds, in equal parts of -REACH to REACH.
RATES = (0.03, 0.1)
PATCHES, REACH = 6, 6.0
PIECE = 1 << 15


class Code:
    """The tree: leaves, and the nodes and bits on the way to each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, mass: np.ndarray, once: np.ndarray, twice: np.ndarray, texts: int):
        """From the commonest words, the tokens of each shared leaf (topics x bands), and by topic the number of
        words that training holds once and twice."""
        order = np.argsort(words)
        self.words, self.counts, self.mass, self.n_once = words[order], counts[order], mass, once
        self.once = len(words) + mass.size
        self.new, self.end = self.once + TOPICS, self.once + TOPICS + 1
        self.weight = np.concatenate([self.counts, mass.ravel(), 2 * twice, [once.sum(), texts]]).astype(np.int64)
        self.nodes = len(self.weight) - 1
        paths = self._paths()
        self.size = np.array([len(p) for p in paths])
        self.start = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p], np.uint16)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)

    def _paths(self) -> list[list[tuple[int, int]]]:
        n = len(self.weight)
        heap = [(int(w) + 1, i) for i, w in enumerate(self.weight)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], n + len(children)))
            children.append((a[1], b[1]))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        walk = [(heap[0][1], [])]
        while walk:
            at, path = walk.pop()
            if at < n:
                paths[at] = path
            else:
                walk += [(child, [*path, (at - n, bit)]) for bit, child in enumerate(children[at - n])]
        return paths

    def leaves(self, own: np.ndarray, counts: np.ndarray, topic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves of words, given their number among the commonest or -1 (a text's end: -2), their training counts and
        their topics; and their log shares in leaves other than the new words'."""
        band = np.digitize(counts, BANDS)
        shared = len(self.words) + topic * (len(BANDS) + 1) + band
        leaf = np.where(counts >= 2, shared, np.where(counts == 1, self.once + topic, self.new))
        share = np.where(counts >= 2, counts / np.maximum(1, self.mass[topic, band]), 1 / np.maximum(1, self.n_once[topic]))
        share = np.where((own != -1) | (counts <= 0), 1.0, np.minimum(share, 1.0))
        return np.where(own == -2, self.end, np.where(own >= 0, own, leaf)), np.log(share)

    def own(self, hashes: np.ndarray) -> np.ndarray:
        """The commonest word that each hash is, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


def topics(together: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Log probabilities (words x topics): a mixture over the rows of how many texts hold two common words both."""
    rows = together[together.sum(1) > 0]
    if not len(rows):
        return np.zeros((len(together), TOPICS))
    share = rows / rows.sum(1, keepdims=True)
    centre = [share[0]]
    for _ in range(TOPICS - 1):
        near = np.min([((np.sqrt(share) - np.sqrt(c)) ** 2).sum(1) for c in centre], axis=0)
        centre.append(share[near.argmax()])
    mean = np.stack(centre) + share.mean(0)
    for _ in range(rounds):
        log = np.log((mean + 1e-5) / (mean + 1e-5).sum(1, keepdims=True))
        z = rows @ log.T
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        mean = z.T @ rows
        mean /= np.maximum(mean.sum(1, keepdims=True), 1e-9)
    return log.T.copy()


class Past:
    """What a text longer than a piece carries from one piece to the next."""

    def __init__(self, nodes: int):
        self.place = 0
        self.leaf = np.zeros(0, np.int64)
        self.seen = np.zeros((2, nodes), np.float32)
        self.weight = np.zeros((1, INPUTS), np.float32)
        self.patch = np.zeros((1, PATCHES), np.float32)


class Model:
    """Counts by context, and the log odds they give."""

    def __init__(self, code: Code, topic: np.ndarray, log_slots: int):
        """``topic``: log probabilities of the commonest words (in the code's order) by topic."""
        self.code, self.log_slots = code, log_slots
        self.topic = np.zeros((len(code.weight), TOPICS))
        self.topic[: len(topic)] = topic
        self.salt = C.seeded(code.nodes, 77)

    # -- contexts ---------------------------------------------------------------------------

    def contexts(self, leaf: np.ndarray, edge: np.ndarray, past: Past | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the leaf before (0: none), a hash of the two before, and the topic so far."""
        back = past.leaf[-TOPIC_WINDOW:] if past is not None else np.zeros(0, np.int64)
        if len(back):
            leaf = np.concatenate([back, leaf])
            edge = np.array([0, len(leaf)])
        first = np.repeat(edge[:-1], np.diff(edge))
        at = np.arange(len(leaf))
        one, two = np.zeros(len(leaf), np.int32), np.zeros(len(leaf), np.uint64)
        one[1:] = leaf[:-1] + 1
        one[edge[:-1]] = 0
        two[1:] = one[:-1]
        two[edge[:-1]] = 0
        total = np.zeros((len(leaf) + 1, TOPICS))
        np.cumsum(self.topic.take(leaf, axis=0), axis=0, out=total[1:])
        near = total[:-1] - total.take(np.maximum(first, at - TOPIC_WINDOW), axis=0)
        topic = np.where(near[:, 0] < -1e-9, near.argmax(1), TOPICS).astype(np.int32)
        cut = len(back)
        return one[cut:], C.mix(two * np.uint64(1 << 20) + one.astype(np.uint64) + np.uint64(1))[cut:], topic[cut:]

    def bits(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every bit of the tokens: (token, node, bit)."""
        size = self.code.size.take(leaf)
        token = np.repeat(np.arange(len(leaf)), size)
        at = np.repeat(self.code.start.take(leaf) - np.cumsum(size) + size, size)
        at += np.arange(len(at))
        return token, self.code.node.take(at), self.code.bit.take(at)

    def slots(self, context: np.ndarray, token: np.ndarray, salt: np.ndarray) -> np.ndarray:
        x = context.take(token)
        x ^= salt
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x >>= np.uint64(64 - self.log_slots)
        return x.view(np.int64)

    # -- counting ---------------------------------------------------------------------------

    def empty(self) -> list[np.ndarray]:
        """Bit counts: by the leaf before and node, hashed by the two before, by topic and node."""
        return [np.zeros(2 * n, np.uint32) for n in ((self.code.end + 2) * self.code.nodes, 1 << self.log_slots, (TOPICS + 1) * self.code.nodes)]

    def count(self, tables: list[np.ndarray], leaf: np.ndarray, edge: np.ndarray) -> None:
        for a, b, whole in pieces(edge):
            own, past = leaf[a:b], None
            if whole:
                past, cut = Past(1), np.array([0, b - a])
                past.leaf = leaf[max(whole[0], a - TOPIC_WINDOW) : a]
            else:
                cut = edge[np.searchsorted(edge, a) : np.searchsorted(edge, b) + 1] - a
            one, two, topic = self.contexts(own, cut, past)
            token, node, bit = self.bits(own)
            n = np.int32(self.code.nodes)
            for table, slot in zip(tables, ((one * n).take(token) + node, self.slots(two, token, self.salt.take(node)), (topic * n).take(token) + node), strict=True):
                np.add.at(table, slot * 2 + bit, np.uint32(1))

    def freeze(self, tables: list[np.ndarray]) -> None:
        """Counts to log odds: three of each, as they are, and without a 0 or a 1 of the bit's own."""
        self.states = []
        for table in tables[:2]:
            n = table.reshape(-1, 2).astype(np.float32)
            top = n.max(1)
            n *= np.where(top > 255, 255 / np.maximum(top, 1), 1)[:, None]
            n = np.ceil(np.minimum(n, 255)).astype(np.uint16)
            self.states.append(n[:, 0] << np.uint16(8) | n[:, 1])
        state = np.arange(1 << 16)
        n = np.stack([state >> 8, state & 255], 1).astype(np.float64)
        less = [n, *(np.maximum(n - np.where(n.max(1) < 255, 1, 0)[:, None] * np.eye(2)[k], 0) for k in (0, 1))]
        self.odds = np.stack([_odds(x) for x in less]).ravel()
        self.sure = np.stack([np.digitize(x.sum(1), [1, 8]) for x in less]).astype(np.int8).ravel()
        n = tables[2].reshape(TOPICS + 1, -1, 2).astype(np.float64)
        plain = n.sum(0)
        self.flat = np.stack([_odds(np.maximum(plain - x, 0)) for x in (np.zeros(2), *np.eye(2))]).ravel()
        self.by_topic = np.stack([_odds(np.maximum(n - x, 0)) for x in (np.zeros(2), *np.eye(2))]).ravel()

    # -- scoring ----------------------------------------------------------------------------

    def inputs(self, leaf: np.ndarray, edge: np.ndarray, held: np.ndarray, turn: np.ndarray, past: Past | None):
        """(log odds by predictor, gate, bit, text) of every bit, with the tokens in the order of ``turn``."""
        one, two, topic = self.contexts(leaf, edge, past)
        token, node, bit = self.bits(leaf)
        who = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        seen, often = self.seen(who.take(token), node, bit, past)
        # bits from the text's order to that of the turns
        size = self.code.size.take(leaf)
        own = size.take(turn)
        at = np.repeat((np.cumsum(size) - size).take(turn) - np.cumsum(own) + own, own)
        at += np.arange(len(at))
        token, node, bit = token.take(at), node.take(at), bit.take(at)
        text = who.take(token)
        nodes = np.int32(self.code.nodes)
        kind = (~held).astype(np.int32).take(text) * (bit + np.int32(1))
        x = np.empty((INPUTS, len(token)), np.float32)
        wide = kind * nodes + node
        x[0] = self.flat.take(wide)
        wide += (topic * nodes).take(token)
        wide += kind * (TOPICS * nodes)
        x[1] = self.by_topic.take(wide)
        shift = kind << 16
        state = self.states[0].take((one * nodes).take(token) + node) + shift
        x[2] = self.odds.take(state)
        gate = self.sure.take(state) * np.int8(4) + often.take(at)
        x[3] = self.odds.take(self.states[1].take(self.slots(two, token, self.salt.take(node))) + shift)
        x[4] = seen.take(at)
        return x, gate, bit, text

    def seen(self, text: np.ndarray, node: np.ndarray, bit: np.ndarray, past: Past | None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of how often the text was at a bit's node before, and with which bit; and how often in steps of the gate."""
        order = np.argsort(node, kind="stable")
        text, where, what = text.take(order), node.take(order), bit.take(order)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (where[1:] != where[:-1])
        head = np.flatnonzero(fresh)
        many = np.diff(np.append(head, len(order)))
        ones = np.cumsum(what, dtype=np.int32) - what
        n1 = (ones - np.repeat(ones.take(head), many)).astype(np.float32)
        n = (np.arange(len(order)) - np.repeat(head, many)).astype(np.float32)
        if past is not None:
            n1 += past.seen[1].take(where)
            n += past.seen.sum(0).take(where)
            for k in (0, 1):
                past.seen[k] += np.bincount(node[bit == k], minlength=self.code.nodes).astype(np.float32)
        odds, often = np.empty(len(order), np.float32), np.empty(len(order), np.int8)
        odds[order] = np.log((n1 + np.float32(PRIOR)) / (n - n1 + np.float32(PRIOR)))
        often[order] = (n > 0).astype(np.int8) + (n > 3) + (n > 15)
        return odds, often

    def walk(self, leaf: np.ndarray, edge: np.ndarray, held: np.ndarray) -> Iterator[tuple]:
        """Steps of the texts: (texts, odds, gate, bit, which text, weights and corrections of the texts)."""
        past = None
        for a, b, whole in pieces(edge):
            if whole:
                if a == whole[0]:
                    past = Past(self.code.nodes)
                cut, who = np.array([0, b - a]), np.array([np.searchsorted(edge, whole[0], "right") - 1])
                own, patch, begin = past.weight, past.patch, past.place
            else:
                past, begin = None, 0
                lo, hi = np.searchsorted(edge, a), np.searchsorted(edge, b)
                cut, who = edge[lo : hi + 1] - a, np.arange(lo, hi)
                own, patch = np.zeros((hi - lo, INPUTS), np.float32), np.zeros((hi - lo, PATCHES), np.float32)
            piece = leaf[a:b]
            step = _step(np.arange(b - a) - np.repeat(cut[:-1], np.diff(cut)) + begin)
            step = (step - step.min()).astype(np.uint16)
            # tokens step by step, so that the bits of a step lie together
            x, gate, bit, text = self.inputs(piece, cut, held[who], np.argsort(step, kind="stable"), past)
            to = np.cumsum(np.bincount(step, self.code.size.take(piece)).astype(np.int64))
            for k in range(len(to)):
                at = slice(to[k - 1] if k else 0, to[k])
                yield who, x[:, at], gate[at], bit[at], text[at], own, patch
            if past is not None:
                past.place += b - a
                past.leaf = np.concatenate([past.leaf, piece])[-TOPIC_WINDOW:]

    def mix(self, x, gate, text, own, patch):
        """Mixed odds, refined odds, and the cell of the text's correction."""
        weight = GATED.T[:, None, :] + own.T[:, :, None]
        cell = text * len(GATED) + gate
        dot = x[0] * weight[0].ravel().take(cell)
        for k in range(1, INPUTS):
            dot += x[k] * weight[k].ravel().take(cell)
        cell = ((np.clip(dot, -REACH, REACH - 1e-3) + np.float32(REACH)) * np.float32(PATCHES / (2 * REACH))).astype(np.int64)
        cell += text * PATCHES
        return dot, dot + patch.ravel().take(cell), cell

    def log(self, leaf: np.ndarray, edge: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each text's leaves."""
        out = np.zeros(len(edge) - 1)
        for who, x, gate, bit, text, own, patch in self.walk(leaf, edge, held):
            dot, z, fix = self.mix(x, gate, text, own, patch)
            sign = bit.astype(np.float32) * 2 - 1
            miss = np.exp(np.clip(-sign * z, -30, 30))
            # a step's bits are in the order of texts
            head = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            here, many = text[head], np.diff(np.append(head, len(text)))
            out[who[here]] -= np.add.reduceat(np.log1p(miss), head, dtype=np.float64)
            n = np.sqrt(many).astype(np.float32)
            err = sign * (miss / (1 + miss)) / np.repeat(n, many)
            patch += (RATES[1] * np.bincount(fix, err, patch.size).reshape(patch.shape)).astype(np.float32)
            x *= sign / (1 + np.exp(np.clip(sign * dot, -30, 30)))
            own[here] += (np.float32(RATES[0]) * np.add.reduceat(x, head, axis=1) / n).T
        return out


def _odds(n: np.ndarray) -> np.ndarray:
    """Log odds of a 1; 0 where nothing was seen."""
    return np.log((n[..., 1] + PRIOR) / (n[..., 0] + PRIOR)).astype(np.float32)


def _step(place: np.ndarray) -> np.ndarray:
    """Number of the step that a token at this place of its text belongs to."""
    early = np.log2(np.maximum(place, 16) / 16).astype(np.int64)
    return np.where(place < 1024, early, 5 + place // 1024)


def pieces(edge: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Runs of whole texts of about ``PIECE`` tokens; a longer text is cut, and its borders are told."""
    at = 0
    while at < len(edge) - 1:
        to = max(int(np.searchsorted(edge, edge[at] + PIECE, "right")) - 1, at + 1)
        a, b = int(edge[at]), int(edge[to])
        if b - a > PIECE:
            for c in range(a, b, PIECE):
                yield c, min(c + PIECE, b), (a, b)
        else:
            yield a, b, None
        at = to


def log_slots(tokens: int) -> int:
    return min(MOST_SLOTS, max(LEAST_SLOTS, math.ceil(math.log2(tokens + 1))))
