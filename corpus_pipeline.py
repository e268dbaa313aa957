"""Training-data pipeline: each stage takes all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import decontam, minhash, packing, quality_mil, toxicity
from fathomline.runtime import discard, materialise, table

STAGES = [
    ("toxicity_cnn", toxicity.stage),
    ("quality_mil", quality_mil.stage),
    ("minhash_near_dedup", minhash.stage),
    ("template_decontamination", decontam.stage),
    ("best_fit_packing", packing.stage),
]

#: Trained models and tokenised sequences are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
