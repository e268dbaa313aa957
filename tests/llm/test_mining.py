"""Collocations, ball-tree clusters and quality rules against brute force, and against their SQL."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomline.llm import ball_tree, phrases, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = Counter(tuple(r[c] for c in names) for r in got.collect())
    assert rows == Counter(want.fetchall()) and rows


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, least, longest, top, cover):
    words, grams = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                grams.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out = []
    held = {k: n for k, n in grams.items() if len(k[1]) > 1 and n >= least}
    for (lang, g), a in held.items():
        score, k = min((1000000 * a * a // (grams[lang, g[:k]] * grams[lang, g[k:]]), k) for k in range(1, len(g)))
        inside = [n for (x, h), n in held.items() if x == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if not any(100 * n >= cover * a for n in inside):
            out.append((lang, -score, -a, " ".join(g).encode(), grams[lang, g[:k]], grams[lang, g[k:]]))
    made = []
    for lang, group in itertools.groupby(sorted(out), key=lambda r: r[0]):
        made += [(lang, i, p.decode(), -a, left, right, words[lang], -s) for i, (_, s, a, p, left, right) in enumerate(itertools.islice(group, top), 1)]
    return made


@pytest.mark.parametrize(("longest", "slots", "shares"), [(3, 1 << 16, 1 << 14), (3, 4, 8), (4, 1 << 16, 3)])
def test_phrases_equal_brute_force(spark, odd_docs, longest, slots, shares):
    """Also where nearly all words share a slot, and where nearly all pivots are hot."""
    r = random.Random(3)
    vocabulary = ["a", "a", "a", "The", "the", "of", "x#", "é", "Ünï", "zz"] + [f"w{k}" for k in range(40)]
    rows = []
    for k in range(120):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n"]) for _ in range(r.randrange(60)))
        rows.append((r.choice(["en", "de", "und", None]), text))
    rows += [("en", None), ("en", ""), (None, " . , "), ("fr", "a a a a a a a a"), ("fr", "a a a"), *[("en", "of the x# of the x#")] * 9]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "'x' as phrase", "1 as n", "'x' as word")
    got = phrases.collocations(docs, least=3, longest=longest, top=40, cover=50, slots=slots, shares=shares)
    assert [tuple(x) for x in got.orderBy(F.expr("cast(lang as binary)"), "rank").collect()] == sorted(brute_phrases(rows, 3, longest, 40, 50), key=lambda x: (x[0].encode(), x[1]))
    assert phrases.collocations(docs.limit(0)).collect() == []
    odd = phrases.collocations(odd_docs, least=2).collect()
    assert {"und"} <= {x["lang"] for x in odd}


# ---------------------------------------------------------------- clusters


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [int(256 * x // 1) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < float("inf") for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    now = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(now))
    for _ in range(rounds):
        sums, count = [[0] * dim for _ in now], Counter()
        for _, v in kept:
            n = near(v)[1]
            count[n] += 1
            sums[n] = [a + b for a, b in zip(sums[n], v, strict=True)]
        now = [[s // count[n] for s in sums[n]] if count[n] else c for n, c in enumerate(now)]
    told = [(i, *near(v)) for i, v in kept]
    part = Counter()
    for _, d, n in told:
        part[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, n, d, part[n], sum(part.values()), sha[n]) for i, d, n in told)


@pytest.mark.parametrize(("block", "scale"), [(64, 1.0), (4096, 1.0), (64, 3e5)])
def test_clusters_equal_brute_force(spark, block, scale):
    """Families, one large group of copies, ties, rows without use; with numbers beyond the tree's range too."""
    r = random.Random(4)
    heart = [[r.uniform(-1, 1) for _ in range(5)] for _ in range(12)]
    rows = [(i, [scale * (c + r.gauss(0, 0.05)) for c in r.choice(heart)]) for i in range(300)]
    rows += [(300 + i, [scale * 0.5] * 5) for i in range(200)] + [(600, [0.0] * 5), (601, [-0.001] * 5), (601, [1.0] * 5), (None, [0.25] * 5)]
    rows += [(700, None), (701, []), (702, [1.0] * 4), (703, [1.0, None, 1.0, 1.0, 1.0]), (704, [float("nan")] * 5), (705, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance", "'x' as v").repartition(3)
    got = ball_tree.clusters(df, centroids=9, rounds=3, dim=5, block=block)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 9, 3, 5)
    few = df.filter("vec_id in (600, 601)")
    assert Counter(map(tuple, ball_tree.clusters(few, centroids=9, rounds=2, dim=5).collect())) == brute_clusters([x for x in rows if x[0] in (600, 601)], 9, 2, 5)
    none = ball_tree.clusters(df.limit(0), dim=5)
    assert none.collect() == [] and none.columns == got.columns


def test_trees_assign_balls_whole():
    """Apart from a few shared leaves, far families are settled without a look at their points."""
    import numpy as np

    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(-3, 4, (256, 8)) + 1000 * k for k in range(8)])
    tree = ball_tree.Tree(points)
    import pyarrow as pa

    names = [c.split()[0] for c in ball_tree._TREE.split(", ")]
    row = dict(zip(names, tree.row(pa.array(range(len(points)))), strict=True))
    stored = ball_tree.Stored({c: pa.scalar(v.to_pylist(), pa.list_(pa.int64())) if c == "ids" else pa.scalar(v) for c, v in row.items()}, 8)
    nodes, own, at, _, _ = ball_tree.descend(stored, [[1000 * k] * 8 for k in range(8)])
    assert len(at) == 0 and len(nodes) <= 16 and sorted(set(own.tolist())) == list(range(8))
    assert (stored.stop - stored.start)[nodes].sum() == len(points)


# ---------------------------------------------------------------- quality rules


def brute_counts(text):
    text = text or ""
    w = re.findall("[^ \t-\r]+", text)
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    inside = {i + d for i, g in enumerate(grams) if often[g] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_quality_rules_equal_brute_force(spark, odd_docs, no_docs):
    r = random.Random(6)
    rows = [(k, "".join(r.choice(["the", "a", "of", "b", "é#", "|", "x*"]) + r.choice([" ", " ", "  ", "\n", "\t", "\n\n", "\r\n"]) for _ in range(r.randrange(120)))) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n_words", "'x' as broken").unionByName(
        odd_docs.selectExpr("doc_id", "text", "1 as n_words", "'x' as broken")
    )
    got = quality_rules.judge(docs.drop("n_words", "broken")).drop("doc_id").collect()
    texts = [x["text"] for x in docs.collect()]
    assert Counter((x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) for x in got) == Counter(map(brute_counts, texts))
    for x in got:
        base = x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"]
        assert x["base_failed"] == base and x["kept"] == (x["broken"] == "") and not (base and x["kept"])
    assert quality_rules.judge(no_docs).collect() == []
    assert quality_rules.judge(odd_docs).filter("kept").count() >= 0


def test_rules_are_a_table(spark):
    """A changed table changes the verdicts, and the projection holds no function of the user's."""
    docs = spark.createDataFrame([(1, "one two three four # five")], "doc_id bigint, text string")
    strict = (quality_rules.Rule("none", "n_symbols", None, None, 0), quality_rules.Rule("share", "n_symbols", "n_words", 10, 20))
    assert quality_rules.judge(docs, strict).first()["broken"] == "none"
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
