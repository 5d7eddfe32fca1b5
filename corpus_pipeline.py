"""A corpus from ``documents``: quality, near duplicates, benchmark, mix, shards.

Each stage takes the documents that the one before kept and returns documents with all their
columns; the last returns the place of each in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import decontaminate, mixing, quality, sharding, shared, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def kd_tree_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.op8(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", kd_tree_sharding),
]

#: The quality, SimHash and mixing stages hash with XXH64, which DuckDB's SQL lacks; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted when its result is written, that result when the next one is."""
    docs, last = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with shared.scope(spark) as paths:
            docs = shared.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept = paths.pop()
            if last:
                paths.append(last)
            last = kept
    return STAGES[-1][1](spark, docs, sf_dir)
