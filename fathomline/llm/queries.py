"""Queries over the synthetic tables: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import (
    ball_tree, decontam, embed_dedup, html_layout, lm_mixing, minhash, packing, phrases, quality_mil, quality_rules, toxicity, url_filter, warc_shards,
)
from fathomline.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, shingle=4, similarity=0.8)


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_layout.visible_text(table(spark, sf_dir, "pages"))
    return texts.select(
        "page_id", "text", F.length("text").cast("bigint").alias("n_chars"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
    )


def op3_embedding_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.3)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.mixing_scores(table(spark, sf_dir, "documents"), folds=5, held=1)


def op7_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_shards.round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(table(spark, sf_dir, "documents"), packing.vocabulary(), 4096, 1)


def op11_pivot_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, longest=3, top=2000, cover=50)


def op12_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.clusters(table(spark, sf_dir, "embeddings"), centroids=40, rounds=5, dim=64, scale=256, salt="2")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_url_markov_ratio": op1_url_markov_ratio,
    "op2_html_layout": op2_html_layout,
    "op3_embedding_pca_tiles": op3_embedding_pca_tiles,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_context_mixing": op6_context_mixing,
    "op7_warc_shards": op7_warc_shards,
    "op8_quality_mil": op8_quality_mil,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_pivot_collocations": op11_pivot_collocations,
    "op12_ball_tree_clusters": op12_ball_tree_clusters,
    "op13_quality_rules": op13_quality_rules,
}

#: DuckDB SQL of the same rows, where SQL can state them at the tables' whole size.
ORACLE: dict[str, str] = {
    "op11_pivot_collocations": phrases.oracle(),
    "op12_ball_tree_clusters": ball_tree.oracle(),
    "op13_quality_rules": quality_rules.oracle(),
}
