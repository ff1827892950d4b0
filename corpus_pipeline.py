"""Corpus pipeline over ``documents``; each stage is a written table.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame. run() applies them in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import common, decontam, ngram_join, packing, suffix_dedup, toxicity


_left: dict[int, list[str]] = {}      # tables that the last call of each stage made


def _stage(k: int, stage):
    """Stage number k. What stage k - 1 left behind goes first: its output is
    written and read again as ``docs``, so its own tables and shuffle files are
    not needed any more."""
    def run(spark, docs, sf_dir):
        common.discard(spark, _left.pop(k - 1, []))
        common.release(spark)
        held = common.made()
        out = stage(spark, docs, sf_dir)
        _left[k] = [t for t in common.made() if t not in held]
        return out
    return run


STAGES = [(name, _stage(k, stage)) for k, (name, stage) in enumerate([
    ("toxicity", toxicity.stage),
    ("ngram_join", ngram_join.stage),
    ("suffix_dedup", suffix_dedup.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
])]

# The label model, tokenizer ids and the latent retrieval are not SQL. Only
# ngram_join.stage and suffix_dedup.stage are tested against brute-force
# versions in tests/llm; of the toxicity, decontam and packing stages,
# test_pipeline.py checks columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.drop(before)
        before = docs
    return docs
