"""MinHash and embedding near-duplicates against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fathomline.llm import embed_dedup, minhash


def sets(text, width):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def classes(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b) and linked(a, b):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


def family(r, n, edits, words=90):
    base = [f"w{r.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(r.randrange(edits + 1)):
            t[r.randrange(len(t))] = f"x{r.randrange(9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small_bucket", [48, 2])
def test_minhash_links_equal_brute_force(spark, small_bucket):
    """Borderline families of near copies, exact copies and short texts; with and without in-place blocks."""
    r = random.Random(5)
    texts = family(r, 60, 9) + family(r, 40, 3) + ["a b c"] * 3 + ["A  B\tc", "a b", "", None, "x y z w", "x y z w v"]
    texts += [" ".join(f"u{r.randrange(9999)}" for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(docs, shingle=4, small_bucket=small_bucket).collect()}
    s = {i: sets(t, 4) for i, t in enumerate(texts)}
    want = classes(list(s), lambda a, b: s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]))
    assert {i: (x["n_shingles"], x["component_id"], x["kept"]) for i, x in got.items()} == {i: (len(s[i]), want[i], want[i] == i) for i in s}
    assert len(set(want.values())) < len(want) - 40


def test_minhash_odd_rows(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {x["doc_id"]: x for x in got}
    assert by[6]["component_id"] == 0 and by[0]["kept"] and by[8]["component_id"] == 7
    assert by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["kept"]
    assert by[None]["component_id"] is None
    assert minhash.near_duplicates(no_docs).count() == 0
    left = minhash.stage(spark, odd_docs, "")
    assert left.columns == odd_docs.columns
    ids = [x["doc_id"] for x in left.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 7, 9, 10, 11, 12, 13, 3000] and ids.count(None) == 1
    assert minhash.stage(spark, no_docs, "").count() == 0


def brute_links(rows, threshold):
    ok = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v) or len(v) != 16:
            continue
        ok[i] = (np.array(v, float) / np.linalg.norm(v), label)
    near = lambda a, b: a in ok and b in ok and ok[a][1] == ok[b][1] and ok[a][0] @ ok[b][0] >= threshold
    ids = [i for i, _, _ in rows]
    return classes(ids, near), {a: sum(near(a, b) for b in ids if a != b) for a in ids}


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(300):
        base = r.normal(size=16) if k % 5 == 0 else base + r.normal(size=16) * r.choice([0, 0.1, 0.2])
        rows.append((k, [float(np.float32(x)) for x in base], [0, 1, None][k % 17 // 8]))
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [1.0] * 15 + [None], 0), (903, [1.0] * 15 + [float("nan")], 0), (904, [1.0] * 15 + [float("inf")], 0), (905, [], 0), (906, [1.0, 2.0], 0)]
    rows += [(907, [1e300] * 16, 0), (908, [1e-300] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 as rep", "2 as cell", "3 as links")
    want, links = brute_links(rows[:-2], 0.93)
    for tile in (1024, 16):
        got = {x["vec_id"]: x for x in embed_dedup.near_duplicates(df, tile=tile).collect()}
        for i in want:
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], want[i], want[i] == i)
        assert got[908]["component_id"] == 907 and got[907]["n_links"] == 1
    assert sum(links.values()) > 200
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embed_dedup.near_duplicates(df.filter("vec_id >= 900 and vec_id < 905")).count() == 5


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    e = np.eye(4)
    near = e[0] + 0.1 * e[1]
    rows = [(1, e[0], 0), (1, [0.0] * 4, 0), (1, e[2], 0), (5, near, 0), (5, near, 0), (7, e[2], 0), (7, None, 0), (None, e[0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (3, e[3], 0)]
    rows = [(i, None if v is None else [float(x) for x in v], c) for i, v, c in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((tuple(x) for x in embed_dedup.near_duplicates(df).collect()), key=str)
    want = [
        (1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (5, 2, 1, False), (5, 2, 1, False), (7, 1, 1, False), (7, 0, 7, True),
        (None, 0, None, None), (8, 1, 8, True), (9, 1, 8, False), (3, 0, 3, True),
    ]
    assert got == sorted(want, key=str)


def test_texts_that_share_an_id(spark):
    t, u, v = ("one two three four five six " * 3 + k for k in "tuv")
    t, u, v = t.replace("one", "t1"), u.replace("two", "u2"), v.replace("six", "v6")
    rows = [(7, u), (7, t), (8, u), (1, t), (9, v), (9, v), (9, v.upper()), (None, t), (None, t), (4, ""), (4, None), (6, None), (7, u)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as row", "1 as nth", "2 as rep", "3 as first")
    got = sorted((tuple(x)[0:1] + tuple(x)[2:] for x in minhash.near_duplicates(docs).collect()), key=str)
    want = [(7, 7, True)] * 2 + [(7, 1, False), (8, 7, False), (1, 1, True)] + [(9, 9, True)] * 3 + [(None, None, True)] * 2 + [(4, 4, True)] * 2 + [(6, 6, True)]
    assert got == sorted(want, key=str)
    left = minhash.stage(spark, docs, "")
    assert left.columns == docs.columns
    kept = sorted(((x["doc_id"], (x["text"] or "").lower()) for x in left.collect()), key=str)
    assert kept == sorted([(7, u), (1, t), (9, v), (None, t), (None, t), (4, ""), (6, "")], key=str)


def test_no_pair_is_given_up_wrongly():
    r = np.random.default_rng(4)
    u = r.normal(size=(200, 32)) + 1.5
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    axes = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    i, j = embed_dedup.linked(u, u, axes, 0.8)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(u @ u.T >= 0.8)), strict=True))


@pytest.mark.parametrize("sides", [1, 2])
def test_a_tile_that_links_whole_stays_small(sides):
    """All pairs of two blocks and more are linked: counts and first members without a list of pairs."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    r = np.random.default_rng(1)
    n = 2600
    x = np.ones((n, 16)) + 0.01 * r.normal(size=(n, 16))
    ids = r.permutation(n) * 3
    side = np.zeros(n, np.int32) if sides == 1 else (np.arange(n) % 2).astype(np.int32)
    table = pa.table({"cid": ids, "times": np.full(n, 2), "side": side, "vec": pa.array(x.tolist())})
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    tracemalloc.start()
    got = embed_dedup._compare(SimpleNamespace(value=axes), 0.9, 16)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got.column("root").to_pylist()) == {0} and got.num_rows == n
    assert set(got.column("links").to_pylist()) == {2 * (n - 1) if sides == 1 else n}
    assert peak < 300e6
