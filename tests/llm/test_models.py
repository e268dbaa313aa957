"""Classifiers, language model, and the pipeline."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from fathomline.llm import common as C
from fathomline.llm import lm_bits as B
from fathomline.llm import lm_mixing, quality_mil, toxicity
from fathomline.llm import lm_spelling as S
from fathomline.llm.queries import QUERIES

#: The base is no distribution: it gives every unseen word the same part, which helps it on a small corpus.
SMALLER, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


# ---------------------------------------------------------------- bytes and words

def test_words_are_those_of_the_definition():
    texts = ["Ab\tc  D\x0be", None, "", "é ABC\x1cd  x", " ", "z"]
    chunk = next(C.text_chunks(pa.array(texts)))
    data, first, last, edge, h = C.words(chunk)
    raw = data.tobytes()
    got = [[raw[first[k] : last[k]] for k in range(edge[i], edge[i + 1])] for i in range(len(texts))]
    assert got == [(t or "").encode().lower().split() for t in texts]
    again = C.words(next(C.text_chunks(pa.array(["q z ab"]))))[4]
    assert h[0] == again[2] and h[-1] == again[1] and len(set(h.tolist())) == len({w for ws in got for w in ws})


def test_chunks_never_cut_a_text():
    texts = pa.array(["a" * 10, "b" * 50, "", "c" * 5, "d"])
    parts = list(C.text_chunks(texts, 16))
    assert [p.n for p in parts] == [1, 1, 3] and sum(len(p.data) for p in parts) == 66
    assert [p.n for p in C.text_chunks(texts.slice(3), 100)] == [2] and list(C.text_chunks(texts.slice(5))) == []


# ---------------------------------------------------------------- classifiers

def corpus(r, n):
    """Invented words; bad texts hold a slur's inflection, poor ones are marked junk."""
    vocabulary = ["".join(r.choices(["ba", "ke", "lo", "mi", "nu", "sta"], k=r.randrange(1, 5))) for _ in range(600)]
    rows = []
    for k in range(n):
        words = r.choices(vocabulary, k=r.randrange(5, 300))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words) + 1), "zugrob" + r.choice(["", "a", "en", "ist", f"q{k}"]))
        good = k % 3 > 0
        text = " ".join(words) if good else " ".join(w + r.choice(["$$$", "***"]) for w in words)
        rows.append((k, text, ["en", "de"][k % 2], int(toxic), int(good)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = corpus(random.Random(4), 900)
    docs = spark.createDataFrame([(k, t, lang) for k, t, lang, _, _ in rows], "doc_id bigint, text string, lang string").cache()
    labels = spark.createDataFrame([(k, q, x) for k, _, _, x, q in rows], "doc_id bigint, quality int, toxic int").cache()
    return docs, labels, {k: (x, q) for k, _, _, x, q in rows}


@pytest.mark.parametrize(("op", "target"), [(toxicity, 0), (quality_mil, 1)])
def test_held_out_accuracy(labelled, op, target):
    docs, labels, truth = labelled
    got = op.scored(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and len(held) > 150
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= (0.3, 0.7)[target]) for r in got)
    right = sum(r["predicted"] == truth[r["doc_id"]][target] for r in held)
    assert right / len(held) >= 0.95


@pytest.mark.parametrize(("op", "column"), [(toxicity, "toxic"), (quality_mil, "quality")])
def test_labels_of_the_held_out_fold_do_not_matter(labelled, op, column):
    from pyspark.sql import functions as F

    docs, labels, _ = labelled
    flipped = labels.withColumn(column, F.when(C.fold(F.col("doc_id"), 4) == 2, 1 - F.col(column)).otherwise(F.col(column)))
    few = docs.filter("doc_id < 60")
    one, two = ({r["doc_id"]: r["score"] for r in op.scored(docs, x).join(few.select("doc_id"), "doc_id").collect()} for x in (labels, flipped))
    assert one == pytest.approx(two, abs=1e-9)


@pytest.mark.parametrize("op", [toxicity, quality_mil])
def test_classifiers_bear_odd_rows(spark, odd_docs, odd_labels, no_docs, op):
    got = op.scored(odd_docs, odd_labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert max(by[0]) == pytest.approx(min(by[0]), abs=1e-7) and max(by[1]) == pytest.approx(max(by[2]), abs=1e-7)
    assert op.scored(no_docs, odd_labels).count() == 0
    assert {r["score"] for r in op.scored(odd_docs, odd_labels.limit(0)).collect()} == {0.0}


def test_long_texts_are_read_to_their_end(labelled):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    clean = " ".join(["bakelo", "minu", "sta"] * 60_000)
    score = lambda t: model.scores(next(C.text_chunks(pa.array([t]))))[0]
    assert score(clean) < 0.3 <= score(clean + " zugroben")


def test_convolution_and_pooling_equal_a_plain_loop():
    net = toxicity.Net()
    texts = pa.array(["aa bb cc dd", "", "x", "bb cc"])
    slots, edge = toxicity._slots(next(C.text_chunks(texts)))
    got = net.score(slots, edge, piece=3)
    for i in range(4):
        own = slots[edge[i] : edge[i + 1]]
        x = net.p["emb"][own].sum(1)
        best, at = [], 0
        for width in toxicity.WIDTHS:
            taps = net.p["conv"][:, at : at + width * toxicity.FILTERS].reshape(toxicity.DIM, width, toxicity.FILTERS)
            best.append(np.max([sum(x[p + k] @ taps[:, k] for k in range(width)) for p in range(len(own) - toxicity.PAD // 2)], axis=0))
            at += width * toxicity.FILTERS
        z = np.maximum(np.concatenate(best) + net.p["bias"], 0) @ net.p["out"] + net.p["base"][0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_gradients_of_the_attention_net():
    r = np.random.default_rng(0)
    net = quality_mil.Net()
    bags = [r.normal(size=(n, quality_mil.WIDTH)).astype(np.float32) for n in (1, 3, 2)]
    label, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])
    x, edge = np.concatenate(bags), np.array([0, 1, 4, 6])

    def loss():
        p = net.score(x, edge)
        return -np.mean(weight * (label * np.log(p) + (1 - label) * np.log(1 - p)))

    before, steps = loss(), []
    for _ in range(3):
        net.fit(bags, label, weight)
        steps.append(loss())
    assert steps[-1] < before / 10


def test_attention_equals_plain_loops():
    r = np.random.default_rng(7)
    net = quality_mil.Net(3)
    net.p["enc0"], net.p["base"] = r.normal(size=quality_mil.HIDDEN).astype(np.float32), np.array([0.3], np.float32)
    texts = ["One short line.", " ".join(f"Wort{k % 31} und, mehr" for k in range(220)), "", "x " * 400]
    x, bags = quality_mil.passages(next(C.text_chunks(pa.array(texts))))
    assert np.diff(bags).tolist() == [1, 7, 1, 5]
    got = net.score(x, bags)
    p = {k: v.astype(float) for k, v in net.p.items()}
    for i in range(len(texts)):
        weights, shown = [], []
        for row in x[bags[i] : bags[i + 1]].astype(float):
            h = [math.tanh(sum(row[j] * p["enc"][j, k] for j in np.flatnonzero(row)) + p["enc0"][k]) for k in range(quality_mil.HIDDEN)]
            e = 0.0
            for g in range(quality_mil.GATES):
                t = math.tanh(sum(h[k] * p["tan"][k, g] for k in range(len(h))))
                e += p["att"][g] * t / (1 + math.exp(-sum(h[k] * p["gate"][k, g] for k in range(len(h)))))
            weights.append(math.exp(e))
            shown.append(h)
        z = [sum(w * h[k] for w, h in zip(weights, shown, strict=True)) / sum(weights) for k in range(quality_mil.HIDDEN)]
        want = 1 / (1 + math.exp(-sum(z[k] * p["out"][k] for k in range(len(z))) - p["base"][0]))
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_labels_that_contradict_are_left_out(spark):
    from fathomline.llm.training import labelled_sample

    docs = spark.createDataFrame([(1, "a", "en"), (1, "b", "en"), (3, "c", None), (4, "d", "de"), (5, None, "de")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (3, 1), (4, 0), (5, 1), (None, 1), (9, 2)], "doc_id bigint, toxic int")
    table, counts = labelled_sample(docs, labels, "toxic", folds=1, held=9)
    got = sorted(zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True))
    assert counts == {0: 1, 1: 2} and [c for _, c in got] == [1, 1, 0] and {t for t, _ in got} - {"a", "b"} == {"", "d"}
    again, _ = labelled_sample(docs.orderBy("text"), labels, "toxic", folds=1, held=9)
    assert again.equals(table)


# ---------------------------------------------------------------- language model

def test_base_counts_are_exact(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    tokens = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, _) in enumerate(rows)}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(rows[k][0]), held[k], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4))
        for k, ws in tokens.items()
    )
    got = lm_mixing.mixing_scores(odd_docs).collect()
    names = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names), round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_mixing.mixing_scores(no_docs).count() == 0


def small_mixer(words):
    tree = S.Tree(np.bincount(np.frombuffer(b" ".join(words), np.uint8), minlength=256))
    tables, plain = np.zeros((S.TABLES, 2 << S.LOG_SLOTS), np.float32), np.zeros(2 * S.CHUNK, np.float32)
    mixer = S.Mixer(tree, tables, plain)
    column = pa.array(words, pa.binary())
    data, starts = S.symbols(column)
    _, node, bit, slots = S.events(tree, data, starts)
    np.add.at(plain, node * 2 + bit, 1)
    for t in range(S.TABLES):
        np.add.at(tables[t], slots[t] * 2 + bit, 1)
    mixer.freeze()
    mixer.train(column)
    return mixer


def test_spelling_is_a_distribution():
    """Over all symbols after one beginning, the probabilities add up to 1."""
    r = random.Random(1)
    mixer = small_mixer([bytes(r.choices(b"abcdef", k=r.randrange(1, 9))) for _ in range(400)] + [b"aaaa"] * 600)
    for beginning in (b"", b"a", b"fed", b"zz"):
        whole = np.frombuffer(b"".join(beginning + bytes([s]) for s in range(256)), np.uint8)
        size = len(beginning) + 1
        starts = np.arange(257) * size
        word, node, bit, slots = S.events(mixer.tree, whole, starts)
        x, gate = mixer.inputs(node, bit, slots)
        z = mixer.refined(mixer.mixed(x, gate), gate).astype(float)
        cost = np.logaddexp(0, np.where(bit == 1, -z, z))
        last = np.concatenate([[False] * int(mixer.tree.size[list(beginning)].sum()) + [True] * int(mixer.tree.size[s]) for s in range(256)])
        assert np.exp(-np.bincount(word[last], cost[last], 256)).sum() == pytest.approx(1, abs=1e-3)


def test_mixing_learns_spelling():
    r = random.Random(2)
    make = lambda: b"".join(r.choices([b"tion", b"ment", b"que", b"ell"], k=r.randrange(2, 6)))
    words = sorted({make() for _ in range(600)})
    new = sorted({make() for _ in range(200)} - set(words))
    mixer = small_mixer(words)
    per_byte = lambda ws, *a: -mixer.log(pa.array(ws, pa.binary()), *a).sum() / math.log(2) / sum(len(w) + 1 for w in ws)
    assert per_byte(new) < 1.1
    # without its own counts, a word of the vocabulary costs about what a new one does
    assert per_byte(words) < per_byte(words, np.ones(len(words), bool))


def small_model(texts, held=()):
    """A model of texts of word numbers, and the texts' leaves."""
    train = Counter(w for k, t in enumerate(texts) if k not in held for w in t)
    many = np.array(sorted(w for w, n in train.items() if n >= 2)[: B.WORDS], np.uint64)
    code = B.Code(
        many, np.array([train[int(w)] for w in many], np.int64), np.zeros((B.TOPICS, len(B.BANDS) + 1), np.int64),
        np.full(B.TOPICS, sum(n == 1 for n in train.values())), np.zeros(B.TOPICS, np.int64), len(texts) - len(held),
    )
    at = {int(w): k for k, w in enumerate(many)}
    leaf = []
    for k, t in enumerate(texts):
        own, count = np.array([at.get(w, -1) for w in t], np.int64), np.array([train[w] - (k not in held) for w in t], np.int64)
        leaf.append(np.append(code.leaves(own, count, np.array([w % B.TOPICS for w in t], np.int64))[0], code.end))
    log = np.log(np.random.default_rng(3).dirichlet(np.ones(B.TOPICS), len(many)))
    model = B.Model(code, log, 16)
    edge = np.concatenate([[0], np.cumsum([len(x) for x in leaf])])
    learned = [x for k, x in enumerate(leaf) if k not in held]
    tables = model.empty()
    model.count(tables, np.concatenate(learned), np.concatenate([[0], np.cumsum([len(x) for x in learned])]))
    model.freeze(tables)
    return model, np.concatenate(leaf), edge, np.array([k in held for k in range(len(texts))])


def plain_log(model, leaf, held):
    """One text, bit by bit: the whole forward pass in plain Python."""
    code, total, seen = model.code, 0.0, Counter()
    own, patch = np.zeros(B.INPUTS), np.zeros(B.PATCHES)
    step, moved, fixed, n = 0, np.zeros(B.INPUTS), np.zeros(B.PATCHES), 0
    mask = (1 << 64) - 1
    for i, x in enumerate(leaf):
        now = int(math.log2(max(i, 16) / 16)) if i < 1024 else 5 + i // 1024
        if now != step:
            own, patch = own + B.RATES[0] * moved / math.sqrt(n), patch + B.RATES[1] * fixed / math.sqrt(n)
            step, moved, fixed, n = now, np.zeros(B.INPUTS), np.zeros(B.PATCHES), 0
        one, two = (int(leaf[i - k]) + 1 if i >= k else 0 for k in (1, 2))
        pair = int(C.mix(np.array([(two << 20) + one + 1], np.uint64))[0])
        near = sum((model.topic[y] for y in leaf[max(0, i - B.TOPIC_WINDOW) : i]), np.zeros(B.TOPICS))
        topic = int(near.argmax()) if near[0] < -1e-9 else B.TOPICS
        for at in range(code.start[x], code.start[x] + code.size[x]):
            node, bit = int(code.node[at]), int(code.bit[at])
            kind = 0 if held else 1 + bit
            slot = (((pair ^ int(model.salt[node])) * 0xBF58476D1CE4E5B9) & mask) >> (64 - model.log_slots)
            state = [kind << 16 | int(model.states[0][one * code.nodes + node]), kind << 16 | int(model.states[1][slot])]
            past = seen[node, 0], seen[node, 1]
            odds = np.array(
                [
                    model.flat[kind * code.nodes + node], model.by_topic[(kind * (B.TOPICS + 1) + topic) * code.nodes + node],
                    model.odds[state[0]], model.odds[state[1]], math.log((past[1] + B.PRIOR) / (past[0] + B.PRIOR)),
                ]
            )
            gate = int(model.sure[state[0]]) * 4 + (sum(past) > 0) + (sum(past) > 3) + (sum(past) > 15)
            dot = float(odds @ (B.GATED[gate] + own))
            cell = int((min(max(dot, -B.REACH), B.REACH - 1e-3) + B.REACH) * B.PATCHES / (2 * B.REACH))
            p = 1 / (1 + math.exp(-dot - patch[cell]))
            total += math.log(p if bit else 1 - p)
            fixed[cell] += bit - p
            moved += (bit - 1 / (1 + math.exp(-dot))) * odds
            seen[node, bit] += 1
            n += 1
    return total


def test_texts_score_as_bit_by_bit(monkeypatch):
    monkeypatch.setattr(B, "PIECE", 1 << 10)
    r = random.Random(5)
    texts = [[int(r.paretovariate(0.7)) % 300 for _ in range(n)] for n in (1, 0, 40, 700, 2600, 90, 33, 1024)]
    model, leaf, edge, held = small_model(texts, {3, 5})
    got = model.log(leaf, edge, held)
    for k in range(len(texts)):
        assert got[k] == pytest.approx(plain_log(model, leaf[edge[k] : edge[k + 1]], held[k]), rel=2e-3)
    # a text's score does not hang on its neighbours or on where pieces end
    monkeypatch.setattr(B, "PIECE", 1 << 20)
    assert model.log(leaf, edge, held) == pytest.approx(got, rel=1e-4)


def test_steps_are_cut_without_copies():
    """Scoring passes over each predictor's odds in one run of memory: a step is a part of its piece, not gathered from it."""
    r = random.Random(7)
    model, leaf, edge, held = small_model([[int(r.paretovariate(0.7)) % 300 for _ in range(n)] for n in (40, 700, 2600, 1, 90)], {1})
    steps = list(model.walk(leaf, edge, held))
    assert len(steps) == 8 and sum(len(s[3]) for s in steps) == model.code.size[leaf].sum()
    for _, x, gate, bit, text, _, _ in steps:
        assert x.shape == (B.INPUTS, len(bit)) and x.strides == (x.base.shape[1] * 4, 4)
        assert x.base is steps[0][1].base and gate.base is steps[0][2].base and bit.base is steps[0][3].base
        assert (np.diff(text) >= 0).all()
    mixer = small_mixer([bytes(r.choices(b"abcdef", k=5)) for _ in range(50)])
    _, node, bit, slots = S.events(mixer.tree, *S.symbols(pa.array([b"abc", b"fed"], pa.binary())))
    assert mixer.inputs(node, bit, slots, True)[0].shape == (S.TABLES + 1, len(bit))


def test_words_within_leaves_by_some_texts_at_a_time(monkeypatch):
    r = np.random.default_rng(8)
    model, *_ = small_model([list(range(50)) * 2])
    edge = np.concatenate([[0], np.cumsum([1, 300, 2, 40, 700, 1])])
    leaf, token = r.integers(0, len(model.code.weight), edge[-1]), r.integers(0, 30, edge[-1])
    share = np.log(r.random(edge[-1]))
    whole = lm_mixing.within(model.code, leaf, token, share, edge)
    monkeypatch.setattr(lm_mixing, "RUN", 50)
    assert lm_mixing.within(model.code, leaf, token, share, edge) == pytest.approx(whole, rel=1e-12)
    assert whole[1] < -10


def test_leaves_are_a_distribution():
    r = random.Random(6)
    model, leaf, edge, _ = small_model([[r.randrange(40) for _ in range(30)] for _ in range(20)])
    before = leaf[:17]
    ways = [np.append(before, x) for x in range(len(model.code.weight))]
    flat, edges = np.concatenate(ways), np.arange(len(ways) + 1) * 18
    with_it = model.log(flat, edges, np.ones(len(ways), bool))
    without = model.log(before, np.array([0, 17]), np.ones(1, bool))[0]
    assert np.exp(with_it - without).sum() == pytest.approx(1, abs=1e-3)


def test_a_text_learns_as_it_goes():
    model, leaf, edge, _ = small_model([list(range(50)) * 2, [3] * 400])
    cost = -model.log(leaf, edge, np.ones(2, bool))
    assert cost[1] / 401 < 0.2 * cost[0] / 101


@pytest.mark.parametrize("folder", [SMALLER, LARGER])
@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables here")
def test_score_beats_the_base_on_held_out_texts(spark, folder):
    got = [r for r in QUERIES["op6_context_mixing"](spark, folder).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


# ---------------------------------------------------------------- pipeline

@pytest.fixture(scope="module")
def tables(spark, odd_docs, odd_labels, labelled, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels, _ = labelled
    more = docs.selectExpr("doc_id + 5000 as doc_id", "text", "lang")
    leak = spark.createDataFrame([(9000, "bake lo mi the quick brown fox jumps over the lazy dog again sta"), (9001, "bake lo")], "doc_id bigint, text string")
    odd_docs.unionByName(more, True).unionByName(leak, True).write.parquet(f"{d}/documents.parquet")
    labels.selectExpr("doc_id + 5000 as doc_id", "quality", "toxic").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_stages_take_effect(spark, tables, labelled):
    truth = labelled[2]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity_cnn", "quality_mil", "minhash_near_dedup", "template_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if k < 4:
            assert out.columns == columns
        from fathomline.runtime import materialise

        docs = materialise(out, "test-pipeline")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    old = [i for i in kept[0] if i is not None and 5000 <= i < 6000]
    assert sum(truth[i - 5000][0] for i in old) <= 10 and len(old) >= 640
    assert sum(1 - truth[i - 5000][1] for i in kept[1] if i is not None and 5000 <= i < 6000) <= 10
    assert 9000 not in kept[3] and kept[4] == kept[3]
    got = corpus_pipeline.run(spark, tables)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == kept[3]


def test_stages_bear_empty_input(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_topics_and_weights_learn_from_all_rows(spark, monkeypatch):
    # one kind of text is longer than 24,000 bytes throughout
    kinds = ["red green blue", "one two three four", "north south east west", "salt " * 6000]
    docs = [(k, " ".join([kinds[k % 4]] * (1 if k % 4 == 3 else 40)) + f" w{k}x") for k in range(60)]
    seen, plain = [], S.Mixer.average
    monkeypatch.setattr(S.Mixer, "average", lambda self, fits: (seen.extend(fits), plain(self, fits))[1])
    bits, also = [], B.Model.freeze
    monkeypatch.setattr(B.Model, "freeze", lambda self, tables: (bits.extend((self, t.copy()) for t in tables), also(self, tables))[1])
    made, find = [], B.topics
    monkeypatch.setattr(B, "topics", lambda *a: (made.append(find(*a)), made[-1])[1])
    got = lm_mixing.mixing_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 60 and all(math.isfinite(r["score"]) for r in got)
    assert len({tuple(row) for row in np.round(made[0], 3)}) >= 3  # words of one kind of text share their topic
    words = {w for _, t in docs for w in t.split()}
    assert sum(n.sum() for _, _, n in seen) > len(words)
    # every bit of every training text: each has one end, and no other bit tells as much
    training = sum(zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in docs)
    code = bits[0][0].code
    last = code.start[code.end] + code.size[code.end] - 1
    by_topic = bits[2][1].reshape(B.TOPICS + 1, code.nodes, 2).sum(0)
    assert by_topic[code.node[last], code.bit[last]] == training == code.weight[code.end]


def test_score_of_odd_texts(spark):
    docs = [(1, "a b a b " * 3000), (2, None), (3, ""), (2, None), (4, "x" * 100_000), (None, "a b"), (6, "a b a b " * 3000), (7, "Új 数 \t\n")]
    got = lm_mixing.mixing_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 8 and all(math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    same = [r for r in got if r["doc_id"] in (2, 3)]
    assert len({(r["n_tokens"], round(r["base_score"], 6)) for r in same}) == 1
