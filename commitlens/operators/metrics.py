"""The metric block shared by every statistics view.

A view is ``groupBy(keys).agg(raw sums)`` followed by one projection that turns
the integral sums into the published metrics.  Keeping the aggregate integral
(counts and bigint sums, with ``lines * weight`` widened before multiplying)
lets Spark do partial aggregation map-side and keeps every rounding exact; the
ratios are rounded half-up in integer arithmetic (``functions.numeric``).

Two flavours exist because the reference's team and author views cast
differently: team views return bigint counts, author views ``::int``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numeric import hundredths, ratio

TEAM = "team"
AUTHOR = "author"


def _long(name: str) -> Column:
    return F.col(name).cast("long")


# Raw aggregate name -> builder.  Every builder returns an integral or
# timestamp aggregate so the partial/final aggregation stays exact.
RAW = {
    "_n": lambda: F.count(F.lit(1)),
    "_sw": lambda: F.sum(_long("weight")),
    "_sa": lambda: F.sum(_long("lines_added")),
    "_sd": lambda: F.sum(_long("lines_deleted")),
    "_sad": lambda: F.sum(_long("lines_added") + _long("lines_deleted")),
    "_sf": lambda: F.sum(_long("files_changed")),
    "_saw": lambda: F.sum(_long("lines_added") * _long("weight")),
    "_sdw": lambda: F.sum(_long("lines_deleted") * _long("weight")),
    "_sadw": lambda: F.sum((_long("lines_added") + _long("lines_deleted")) * _long("weight")),
    "_sfw": lambda: F.sum(_long("files_changed") * _long("weight")),
    "_authors": lambda: F.countDistinct("author_email"),
    "_repos": lambda: F.countDistinct("repository_id"),
    "_min": lambda: F.min("commit_date"),
    "_max": lambda: F.max("commit_date"),
}


def _count(raw: str, flavor: str) -> Column:
    return F.col(raw).cast("int" if flavor == AUTHOR else "long")


# Metric name -> (raw aggregates it needs, final expression builder(flavor)).
METRICS = {
    "total_commits": (["_n"], lambda fl: _count("_n", fl)),
    "unique_authors": (["_authors"], lambda fl: F.col("_authors")),
    "repositories": (["_repos"], lambda fl: F.col("_repos")),
    "repositories_contributed": (["_repos"], lambda fl: F.col("_repos")),
    "repositories_count": (["_repos"], lambda fl: _count("_repos", fl)),
    "total_lines_added": (["_sa"], lambda fl: F.col("_sa")),
    "total_lines_deleted": (["_sd"], lambda fl: F.col("_sd")),
    "total_lines_changed": (["_sad"], lambda fl: F.col("_sad")),
    "total_files_changed": (["_sf"], lambda fl: _count("_sf", fl)),
    "weighted_lines_added": (["_saw"], lambda fl: hundredths("_saw")),
    "weighted_lines_deleted": (["_sdw"], lambda fl: hundredths("_sdw")),
    "weighted_lines_changed": (["_sadw"], lambda fl: hundredths("_sadw")),
    "weighted_files_changed": (["_sfw"], lambda fl: hundredths("_sfw")),
    "effective_commits": (["_sw"], lambda fl: hundredths("_sw")),
    "avg_weight": (["_sw", "_n"], lambda fl: ratio("_sw", "_n", 1)),
    "weight_efficiency_pct": (["_sw", "_n"], lambda fl: ratio("_sw", "_n", 1)),
    "avg_lines_changed_per_commit": (["_sad", "_n"], lambda fl: ratio("_sad", "_n", 2)),
    "avg_lines_added_per_commit": (["_sa", "_n"], lambda fl: ratio("_sa", "_n", 2)),
    "avg_lines_deleted_per_commit": (["_sd", "_n"], lambda fl: ratio("_sd", "_n", 2)),
    "avg_files_changed_per_commit": (["_sf", "_n"], lambda fl: ratio("_sf", "_n", 2)),
    "avg_lines_per_commit_1dp": (["_sad", "_n"], lambda fl: ratio("_sad", "_n", 1)),
    "avg_lines_per_commit_2dp": (["_sad", "_n"], lambda fl: ratio("_sad", "_n", 2)),
    "avg_lines_added_per_author": (["_sa", "_authors"], lambda fl: ratio("_sa", "_authors", 2)),
    "avg_lines_deleted_per_author": (["_sd", "_authors"], lambda fl: ratio("_sd", "_authors", 2)),
    "avg_lines_changed_per_author": (["_sad", "_authors"], lambda fl: ratio("_sad", "_authors", 2)),
    "avg_commits_per_author": (["_n", "_authors"], lambda fl: ratio("_n", "_authors", 2)),
    "first_commit_date": (["_min"], lambda fl: F.col("_min")),
    "last_commit_date": (["_max"], lambda fl: F.col("_max")),
    "first_commit": (["_min"], lambda fl: F.col("_min")),
    "latest_commit": (["_max"], lambda fl: F.col("_max")),
    "first_usage": (["_min"], lambda fl: F.col("_min")),
    "latest_usage": (["_max"], lambda fl: F.col("_max")),
    "activity_days": (["_min", "_max"], lambda fl: dates.whole_days_between("_min", "_max")),
}

# Output name of metrics whose internal name carries a precision suffix.
OUTPUT_NAME = {
    "avg_lines_per_commit_1dp": "avg_lines_per_commit",
    "avg_lines_per_commit_2dp": "avg_lines_per_commit",
}


def raw_aggregates(metric_names: list[str]) -> list[Column]:
    """The aggregate Columns needed by ``metric_names`` (each raw sum once)."""
    needed: list[str] = []
    for m in metric_names:
        for r in METRICS[m][0]:
            if r not in needed:
                needed.append(r)
    return [RAW[r]().alias(r) for r in needed]


def final_metrics(metric_names: list[str], flavor: str = TEAM) -> list[Column]:
    """The published metric Columns, in the given order, over the raw aggregates."""
    return [METRICS[m][1](flavor).alias(OUTPUT_NAME.get(m, m)) for m in metric_names]


# Metric lists of the views, in the reference's column order --------------
_WEIGHTED_ALL = ["weighted_lines_added", "weighted_lines_deleted", "weighted_lines_changed"]
_EFFICIENCY = ["effective_commits", "avg_weight", "weight_efficiency_pct"]
_TOTALS = ["total_lines_added", "total_lines_deleted", "total_lines_changed"]
_AVG_LINES = ["avg_lines_changed_per_commit", "avg_lines_added_per_commit", "avg_lines_deleted_per_commit"]

REPO_DAILY = (["total_commits", "unique_authors"] + _TOTALS + ["total_files_changed"] + _WEIGHTED_ALL
              + ["weighted_files_changed"] + _EFFICIENCY + _AVG_LINES + ["avg_files_changed_per_commit"])
REPO_WEEKLY = [m for m in REPO_DAILY if m != "avg_files_changed_per_commit"]
REPO_MONTHLY = REPO_DAILY + ["avg_lines_added_per_author", "avg_lines_deleted_per_author",
                             "avg_lines_changed_per_author", "avg_commits_per_author"]
CONTRIBUTOR = (["repositories_contributed", "total_commits"] + _TOTALS + ["total_files_changed"]
               + _WEIGHTED_ALL + _EFFICIENCY + _AVG_LINES
               + ["first_commit_date", "last_commit_date", "activity_days"])
AI_TOOLS = (["total_commits", "unique_authors", "repositories"] + _TOTALS + ["weighted_lines_changed"]
            + _EFFICIENCY + ["avg_lines_per_commit_2dp", "first_usage", "latest_usage"])
AI_TOOLS_BY_REPO = (["total_commits", "unique_authors", "total_lines_changed", "weighted_lines_changed"]
                    + _EFFICIENCY + ["avg_lines_per_commit_2dp"])
CATEGORY = (["total_commits", "unique_authors", "repositories"] + _TOTALS + _WEIGHTED_ALL + _EFFICIENCY
            + ["avg_lines_per_commit_1dp", "first_commit", "latest_commit"])
CATEGORY_BY_REPO = (["total_commits", "unique_authors"] + _TOTALS + _WEIGHTED_ALL + _EFFICIENCY
                    + ["avg_lines_per_commit_1dp"])
AUTHOR_DAILY = (["total_commits"] + _EFFICIENCY + _TOTALS + _WEIGHTED_ALL
                + ["total_files_changed", "weighted_files_changed"] + _AVG_LINES
                + ["avg_files_changed_per_commit"])
AUTHOR_WEEKLY = [m for m in AUTHOR_DAILY if m != "avg_files_changed_per_commit"]
AUTHOR_CATEGORY = (["total_commits"] + _EFFICIENCY + _TOTALS + _WEIGHTED_ALL
                   + ["repositories_count", "first_commit_date", "last_commit_date", "avg_lines_per_commit_1dp"])
AUTHOR_CATEGORY_BY_REPO = (["total_commits"] + _EFFICIENCY + _TOTALS + _WEIGHTED_ALL
                           + ["avg_lines_per_commit_1dp"])
