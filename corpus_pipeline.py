"""The corpus pipeline: toxicity, exact dedup, near-dedup, decontamination, mixing.

Each stage reads all that the one before kept, and its decisions take effect: the first four return
the rows of documents that stay, the last adds what the mix takes of each and leaves out documents
of which it takes nothing.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from nebulark.llm import decontam, exact_dedup, mixing, queries, simhash, toxicity
from nebulark.llm._common import drop_work_tables, materialize, scratch
from nebulark.plans.work import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.train_rows())
    return toxicity.drop_toxic(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with size, source_size, target, taken, copies (whole) and spans (words taken once more)."""
    return mixing.mix_sources(docs, whole_rows=True).where("taken > 0")


def _shipped(stage):
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(drop_toxic)),
    ("exact_dedup", _shipped(drop_exact_copies)),
    ("simhash_near_dedup", _shipped(drop_near_copies)),
    ("benchmark_decontamination", _shipped(drop_contaminated)),
    ("source_mixing", _shipped(mix)),
]

#: Scores and fingerprints cannot be written in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it.

    A stage's work tables, and the result of the one before, go once its own result is written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as outside:
            folder = f"{outside}/pipeline-{uuid.uuid4().hex}"
            docs = materialize(stage(spark, docs, sf_dir), name, folder)
        if before:
            drop_work_tables(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
