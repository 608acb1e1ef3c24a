"""Revert weighting: reverted work and its revert get weight 0.

A revert is a subject with the word ``Revert`` and without ``Unrevert`` (P13).
Its references ``(!n)`` / ``(#n)`` (T7) are looked up in every *other* commit
of the same repository (J3).  When at least one original is found, the revert
and all originals found are set to 0 (U1, O2).  Weights are never raised.

Matching modes:

* ``compatible`` (default) - an original is any commit whose subject contains
  the reference as a substring, so ``!104`` also hits ``!10463``, and unrevert
  commits are zeroed like any other original.
* ``documented`` - references match whole ``[!#]digits`` runs only and
  unrevert commits keep their weight.

Plan: instead of comparing every revert with every commit, each commit's
subject is exploded into prefixes of its reference runs (a needle occurs in
a text exactly when it prefixes one of the text's runs), and needles are
equi-joined on ``(repository_id, token)``.  Only prefixes as long as some needle are made: the lengths
that needles have come along as a one-row subquery, so a run of any number of digits gives a few tokens and
no more text than the needles hold.  There is no cartesian product, and a huge repository is
spread over many join keys.

Only J3 and the dry run list pairs.  The zeroed keys need none: per token, the least
and the greatest hash on either side tell whether there is another commit than
the own one, so a token shared by many reverts and many commits costs their sum.
All of it is one lazy plan; AQE picks the joins from run-time sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

COMPATIBLE = "compatible"
DOCUMENTED = "documented"


def revert_needles(commits: DataFrame) -> DataFrame:
    """(repository_id, revert_hash, token) for every revert and each of its references."""
    return (commits.where(text.is_revert("subject"))
            .select("repository_id", F.col("hash").alias("revert_hash"),
                    F.explode(text.pr_references("subject")).alias("token")))


def needle_lengths(commits: DataFrame) -> Column:
    """The distinct lengths of all needles, as an array: a one-row subquery of the plan."""
    return revert_needles(commits).agg(F.sort_array(F.collect_set(F.length("token"))).alias("lengths")).scalar()


def _with_tokens(commits: DataFrame, mode: str) -> DataFrame:
    """Add ``_tokens``: every string of a commit's subject that a needle could match."""
    if mode == COMPATIBLE:
        return (commits.withColumn("_lengths", needle_lengths(commits))
                .withColumn("_tokens", text.reference_prefixes("subject", F.col("_lengths"))).drop("_lengths"))
    if mode == DOCUMENTED:
        runs = F.array_distinct(text.reference_runs("subject"))
        return commits.withColumn("_tokens", F.when(~text.is_unrevert("subject"), runs).otherwise(F.array().cast("array<string>")))
    raise ValueError(f"unknown mode {mode!r}")


def original_tokens(commits: DataFrame, mode: str = COMPATIBLE) -> DataFrame:
    """(repository_id, original_hash, token): every string a needle could match."""
    return _with_tokens(commits, mode).select("repository_id", F.col("hash").alias("original_hash"), F.explode("_tokens").alias("token"))


def revert_matches(commits: DataFrame, mode: str = COMPATIBLE) -> DataFrame:
    """(repository_id, revert_hash, token, original_hash) pairs, revert excluded."""
    originals = original_tokens(commits, mode)
    return (revert_needles(commits).join(originals, ["repository_id", "token"], "inner")
            .where(F.col("revert_hash") != F.col("original_hash"))
            .select("repository_id", "revert_hash", "token", "original_hash"))


def zeroed_keys(commits: DataFrame, mode: str = COMPATIBLE) -> DataFrame:
    """Distinct (repository_id, hash) of reverts with a match and of their originals.

    One frame of (token, hash, side) meets its own aggregate: a commit counts on one side of a token when the other side
    holds a hash that differs from its own, that is when the least or the greatest one there does.
    """
    key = ["repository_id", "token"]
    sided = lambda tokens, revert: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(revert).alias("revert")))
    needles = F.when(text.is_revert("subject"), text.pr_references("subject")).otherwise(F.array().cast("array<string>"))
    both = F.concat(sided(F.col("_tokens"), False), sided(needles, True))
    rows = _with_tokens(commits, mode).select("repository_id", "hash", F.explode(both).alias("t"))
    rows = rows.select("repository_id", "hash", "t.token", "t.revert")
    ends = [f(F.when(F.col("revert") == side, F.col("hash"))).alias(f"_{name}{int(side)}") for side in (False, True) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    tokens = rows.groupBy(*key).agg(*ends).where(F.col("_lo0").isNotNull() & F.col("_lo1").isNotNull())
    other = lambda side: (F.col(f"_lo{side}") != F.col("hash")) | (F.col(f"_hi{side}") != F.col("hash"))
    return rows.join(tokens, key).where(F.when(F.col("revert"), other(0)).otherwise(other(1))).select("repository_id", "hash").distinct()


def apply_revert_weights(commits: DataFrame, mode: str = COMPATIBLE,
                         repository_ids: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """O2: the commit table with weights of reverted work set to 0.

    ``repository_ids`` (one ``repository_id`` column) limits the run to some
    repositories (P14); other repositories pass through unchanged.  ``subjects`` (repository_id, hash, subject) stands in
    for ``commits`` where the subjects are at hand more cheaply.
    """
    scope = commits if subjects is None else subjects
    if repository_ids is not None:
        scope = scope.join(repository_ids.select("repository_id").distinct(), "repository_id", "left_semi")
    zero = zeroed_keys(scope, mode).withColumn("_zeroed", F.lit(True))
    cols = commits.columns
    out = commits.join(zero, ["repository_id", "hash"], "left")
    return out.select(*[
        (F.when(F.col("_zeroed"), F.lit(0)).otherwise(F.col("weight")).cast("int").alias("weight")
         if c == "weight" else F.col(c))
        for c in cols
    ])


def weighting_plan(commits: DataFrame, mode: str = COMPATIBLE) -> DataFrame:
    """O3 dry run: commits whose weight would change, with old/new weight and reason.

    Commits already at 0 are skipped.  A commit that is itself a matched revert
    gets ``Revert commit``; an original gets ``Reverted by <first 8 of revert>``
    (the smallest revert hash when several revert it).
    """
    matches = revert_matches(commits, mode)
    roles = F.array(F.struct(F.col("revert_hash").alias("hash"), F.lit(None).cast("string").alias("by")),
                    F.struct(F.col("original_hash").alias("hash"), F.col("revert_hash").alias("by")))
    keys = (matches.select("repository_id", F.explode(roles).alias("r")).groupBy("repository_id", F.col("r.hash").alias("hash"))
            .agg(F.bool_or(F.col("r.by").isNull()).alias("_is_revert"), F.min("r.by").alias("_by")))
    return (commits.join(keys, ["repository_id", "hash"], "inner")
            .where(F.col("weight") != 0)
            .select("repository_id", "hash",
                    F.col("weight").alias("old_weight"),
                    F.lit(0).alias("new_weight"),
                    F.when(F.col("_is_revert"), F.lit("Revert commit"))
                    .otherwise(F.concat(F.lit("Reverted by "), F.substring("_by", 1, 8)))
                    .alias("reason")))


@dataclass
class WeightingReport:
    """Counts and warnings of one weighting run (all lazy DataFrames)."""
    summary: DataFrame            # commits_processed, reverts_found, commits_zeroed
    reverts_without_number: DataFrame
    numbers_without_original: DataFrame


def weighting_report(commits: DataFrame, mode: str = COMPATIBLE) -> WeightingReport:
    needles = revert_needles(commits)
    changed = weighting_plan(commits, mode)
    # One global aggregate over the commits and the planned changes together.
    flags = commits.select(F.lit(1).alias("_p"), text.is_revert("subject").cast("int").alias("_r"),
                           F.lit(0).alias("_z"))
    flags = flags.unionByName(changed.select(F.lit(0).alias("_p"), F.lit(0).alias("_r"), F.lit(1).alias("_z")))
    summary = flags.agg(F.sum("_p").cast("long").alias("commits_processed"),
                        F.sum("_r").cast("long").alias("reverts_found"),
                        F.sum("_z").cast("long").alias("commits_zeroed"))
    no_number = (commits.where(text.is_revert("subject") & (F.size(text.pr_references("subject")) == 0))
                 .select("repository_id", "hash", "subject"))
    found = F.count_if(F.col("original_hash") != F.col("revert_hash"))  # null, too, where there is none
    no_original = (needles.join(original_tokens(commits, mode), ["repository_id", "token"], "left")
                   .groupBy("repository_id", "revert_hash", "token").agg(found.alias("_n")).where(F.col("_n") == 0).drop("_n"))
    return WeightingReport(summary, no_number, no_original)
