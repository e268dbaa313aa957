"""Rows that every operator must bear: nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import pytest

#: Names that the operators use inside.
CLASHES = "id, hash, cell, rep, bucket, size, sig, score, label, count, block, nth, held, seen, target, sha, rank, gone_id, leak_id"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(f"word{k % 9973}" for k in range(120_000))
    texts = [
        "the quick brown fox jumps over the lazy dog again and again in the park", None, "", "  \n\t ", "one", "two words",
        "the quick brown fox jumps over the lazy dog again and again in the park", long, long + " tail", "ünïcödé wörds ärе hére – “quoted” 数 字",
        "A" * 50_000, "\u0000 nul \x1c sep", "<|endoftext|> and <|startoftext|>", "$$$ &&& *** %%%",
    ]
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, "a row without an id", "en", "src0", 19), rows[0], rows[0], (3000, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *(f"'x' as {c.strip()}" for c in CLASHES.split(",")))


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(0, 1, 0), (1, 0, 1), (2, None, None), (4, 1, 0), (5, 0, 1), (None, 1, 1), (99_999, 1, 1), (7, 1, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as label", "'x' as text")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
