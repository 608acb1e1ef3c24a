"""The two tables every query reads, derived from the driver tables.

``commits`` is the state after the pipeline's load and weighting steps: the
adapter's commits (pattern-enriched) with revert weighting applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import adapter
from ..operators import weights


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.repositories(spark, sf_dir)


def loaded_commits(spark: SparkSession, sf_dir: str, files: bool = False) -> DataFrame:
    return adapter.loaded_commits(spark, sf_dir, files)


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What weighting reads of the commits, without the text rules of the enrichment."""
    return adapter.commit_messages(spark, sf_dir).select("repository_id", "hash", "subject")


def commits(spark: SparkSession, sf_dir: str, mode: str = weights.COMPATIBLE) -> DataFrame:
    return weights.apply_revert_weights(loaded_commits(spark, sf_dir), mode, subjects=subjects(spark, sf_dir))
