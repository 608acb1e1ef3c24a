"""The corpus pipeline: five stages, each over all that the one before it kept.

quality rules -> near-duplicate removal -> benchmark decontamination -> mixing to target
weights -> sharding.  Every stage is written and read again, so that a lost executor costs one
stage at most and the next one is planned with real sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm import decontaminate, jaccard, mixing, quality, sharding
from commitlens.llm.common import materialise, table

SHARDS = 24
#: The near-duplicate stage's own: words a shingle, and least similarity in percent.  op10 has other values.
WIDTH, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.unique_documents(docs, width=WIDTH, percent=PERCENT)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shards(docs, sharding.even_topology(SHARDS))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Template windows and their slots cannot be told in DuckDB's patterns; tests take the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
