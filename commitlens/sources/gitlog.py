"""Git log dumps -> commits.

Input is the text of ``git log --numstat`` with the format
``COMMIT|%H|%ai|%an|%ae|%s|BODY|%b|BODYEND|``: a header line, body lines up
to ``BODYEND|`` and then ``added<TAB>deleted<TAB>path`` lines.

The text source splits files on ``"\\nCOMMIT|"``, so every record is one commit
and a large dump is read by many tasks; each record is parsed by Column
expressions (``split``, ``transform``, ``aggregate``) - no Python per row.

Rules kept from the original parser: the header is cut at the first
``|BODY|`` and split into at most five fields, so a subject keeps its pipes;
the first body line is split on ``|`` and its pieces become lines; a line
containing ``BODYEND|`` is dropped; binary ``-``/``-`` numstat lines add
nothing; a date that cannot be parsed stays as text (``commit_date`` NULL).

A body line that itself begins with ``COMMIT|`` cuts its record.  ``stitched`` puts such records together
again: a piece whose hash is not 40 hex digits continues the record before it, also across splits, as long as
that record's body is open (no ``BODYEND|`` yet).  Other pieces of that kind are no commits; ``git_log`` gives them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

RECORD_SEPARATOR = "\nCOMMIT|"
BODY_MARK = "|BODY|"
BODY_END = "BODYEND|"


def _to_int(s: Column) -> Column:
    """Leading integer of a text, 0 when none (as a permissive integer read)."""
    return F.coalesce(F.regexp_extract(s, r"^[\t\n\x0B\f\r ]*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def read_records(spark: SparkSession, paths) -> DataFrame:
    """Pieces of the dumps between ``COMMIT|`` marks, with their place: file, split, position (ascending, without
    gaps in a split) and whether the piece begins a record."""
    raw = spark.read.option("lineSep", RECORD_SEPARATOR).text(paths)
    placed = raw.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                        F.monotonically_increasing_id().alias("_pos"))
    return placed.withColumn("_head", F.col("value").rlike(r"^(?:COMMIT\|)?[0-9a-f]{40}\|"))


def _ended(value: Column) -> Column:
    return F.contains(value, F.lit(BODY_END))


def stitched(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their continuations put back, pieces that belong to none).

    Pieces that begin no record are rare, so only they and per-split counts are shuffled: a run of such pieces
    continues the piece before the run, or, at the beginning of a split, the last record of an earlier split of the
    file (a running value over the file's splits).  The few records that are continued are found by a join with these.
    """
    loose = records.where(~F.col("_head"))
    place = Window.partitionBy("_file", "_block").orderBy("_pos")
    runs = loose.withColumn("_run", F.col("_pos") - F.row_number().over(place))
    runs = runs.withColumn("_at", F.min("_pos").over(Window.partitionBy("_file", "_block", "_run")) - 1)
    splits = records.groupBy("_file", "_block").agg(F.min("_pos").alias("_first"), F.max(F.when(F.col("_head"), F.struct("_block", "_pos"))).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_block", "_first", earlier.alias("_earlier"))
    owner = F.when(F.col("_at") >= F.col("_first"), F.struct(F.col("_block"), F.col("_at").alias("_pos"))).otherwise(F.col("_earlier"))
    owned = runs.join(splits, ["_file", "_block"]).select("_file", "_block", "_pos", "value", owner.alias("_owner"))
    heads = records.where("_head").select(F.col("_file").alias("_of"), F.col("_block").alias("_oblock"), F.col("_pos").alias("_opos"), _ended("value").alias("_closed"))
    at = (F.col("_file") == F.col("_of")) & (F.col("_owner._block") == F.col("_oblock")) & (F.col("_owner._pos") == F.col("_opos"))
    pieces = owned.join(heads, at, "left")
    before = Window.partitionBy("_file", "_owner").orderBy("_block", "_pos").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.coalesce(F.col("_closed"), F.lit(True)) | F.coalesce(F.max(_ended("value")).over(before), F.lit(False))
    pieces = pieces.withColumn("_stray", closed)
    more = pieces.where(~F.col("_stray")).groupBy("_of", "_oblock", "_opos").agg(F.array_sort(F.collect_list(F.struct("_block", "_pos", "value"))).alias("_more"))
    own = (F.col("_file") == F.col("_of")) & (F.col("_block") == F.col("_oblock")) & (F.col("_pos") == F.col("_opos"))
    text_ = F.concat("value", F.array_join(F.transform(F.coalesce("_more", F.array().cast(more.schema["_more"].dataType)), lambda m: F.concat(F.lit(RECORD_SEPARATOR), m["value"])), ""))
    whole = records.where("_head").join(more, own, "left").select("_file", text_.alias("value"))
    return whole, pieces.where("_stray").where(F.trim("value") != "").select("_file", "value")


def parse_records(records: DataFrame, value: str = "value") -> DataFrame:
    """Parse one commit record per row (text after the ``COMMIT|`` marker)."""
    rec = F.regexp_replace(F.col(value), r"^COMMIT\|", "")
    first_line = F.col("_first")
    rest = F.when(F.instr("_rec", "\n") > 0, F.expr("substring(_rec, instr(_rec, '\n') + 1)")).otherwise(F.lit(""))
    mark = F.instr(first_line, BODY_MARK)
    header = F.when(mark > 0, F.expr("substring(_first, 1, instr(_first, '|BODY|') - 1)")).otherwise(first_line)
    body_portion = F.when(mark > 0, F.expr("substring(_first, instr(_first, '|BODY|') + 6)")).otherwise(F.lit(""))

    file = F.col("_file") if "_file" in records.columns else F.input_file_name()
    df = records.select(file.alias("_file"), rec.alias("_rec")) \
        .select("*", F.substring_index("_rec", "\n", 1).alias("_first"))
    df = df.select("_file", "_rec", "_first", header.alias("_header"), body_portion.alias("_bp"),
                   rest.alias("_rest"), (mark > 0).alias("_marked"))

    parts = F.split("_header", r"\|", 5)
    pieces = F.split("_bp", r"\|", -1)
    end_in_first = F.array_position(pieces, "BODYEND")
    first_body = F.when(~F.col("_marked"), F.array().cast("array<string>")).when(
        end_in_first > 0, F.slice(pieces, 1, end_in_first - 1)).otherwise(pieces)
    in_body = F.col("_marked") & (end_in_first == 0)  # a body may begin on the next line

    lines = F.split(F.regexp_replace("_rest", "\n$", ""), "\n", -1)
    ends = F.transform(lines, lambda l: F.instr(l, BODY_END) > 0)
    first_end = F.array_position(ends, True)
    body_more = F.when(in_body & (first_end > 0), F.slice(lines, 1, first_end - 1)) \
        .when(in_body, lines).otherwise(F.array().cast("array<string>"))
    after = F.when(in_body & (first_end > 0), F.slice(lines, first_end + 1, F.size(lines))) \
        .when(in_body, F.array().cast("array<string>")).otherwise(lines)
    stat_lines = F.filter(after, lambda l: (F.instr(l, BODY_END) == 0) & (text.strip(l) != ""))
    stats = F.transform(stat_lines, lambda l: F.split(l, "\t", 3))
    files = F.transform(
        F.filter(stats, lambda p: (F.size(p) >= 3) & (p[0] != "-") & (p[1] != "-")),
        lambda p: F.struct(p[2].alias("filename"), _to_int(p[0]).alias("added"), _to_int(p[1]).alias("deleted")))

    out = df.select(
        "_file",
        *(F.get(parts, i).alias(c) for i, c in enumerate(("hash", "date", "author_name", "author_email", "subject"))),
        F.array_join(F.concat(first_body, body_more), "\n").alias("body"),
        files.alias("files"))
    return out.select(
        "_file", "hash", "date", text.parse_git_date("date").alias("commit_date"),
        text.iso_date_text("date").alias("iso_date"), "author_name", "author_email", "subject", "body",
        F.aggregate("files", F.lit(0).cast("bigint"), lambda acc, f: acc + f["added"]).alias("lines_added"),
        F.aggregate("files", F.lit(0).cast("bigint"), lambda acc, f: acc + f["deleted"]).alias("lines_deleted"),
        F.size("files").alias("files_changed"), "files",
        (~F.coalesce(F.col("hash").rlike("^[0-9a-f]{40}$"), F.lit(False))).alias("_corrupt"))


def git_log(spark: SparkSession, paths, repository: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, rejected) of one or more log dumps; commits are enriched with category (T1) and tools (T5),
    rejected pieces (``_file``, ``value``) are no commits."""
    records, rejected = stitched(read_records(spark, paths))
    parsed = parse_records(records).select(F.lit(repository).cast("string").alias("repository"), "*")
    enriched = text.add_ai_tools(text.add_category(parsed, "subject", "category"), "body", "ai_tools")
    return enriched.withColumn("weight", F.lit(100)), rejected


def read_git_log(spark: SparkSession, paths, repository: str | None = None) -> DataFrame:
    """The commits of ``git_log``."""
    return git_log(spark, paths, repository)[0]
