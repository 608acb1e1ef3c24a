"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.session import checkpoint_dir

#: Fixed by the contracts: a word is a run without space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut and
    Catalyst plans what follows with the table's real size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)


def text_hash(text: Column) -> Column:
    """With doc_id, the key that joins a decision back to its row; null and empty differ."""
    return F.xxhash64(text)


def placed(df: DataFrame) -> DataFrame:
    """Add ``_pid`` and ``_idx``, the partition and the place in it of each row of a
    checkpointed frame, whose partitions no longer change."""
    row = F.monotonically_increasing_id()
    return df.withColumn("_row", row).withColumn("_pid", F.shiftright("_row", 33)).withColumn(
        "_idx", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))


def aside(df: DataFrame, *own: Column | str) -> DataFrame:
    """The rows of the input as one column ``_row`` beside the operator's own columns, so that no names clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *own)


def restored(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The input's columns out of ``_row``, some of them replaced."""
    return df.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in columns])


def fresh(columns: list[str], name: str) -> str:
    """A name that the input does not have."""
    while name in columns:
        name = f"_{name}"
    return name
