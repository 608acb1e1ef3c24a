"""Views of the commit table as lazy DataFrame builders.

Every statistics view keeps only active commits (``weight > 0``); list views
keep their own rule.  Views aggregate on ``repository_id`` and attach the
repository name *after* aggregating, so the shuffle carries an int key and the
join runs on the small aggregate; AQE picks its kind from run-time sizes.

Nothing here sorts: declared view orders are applied by ``presented`` (L1)
so that views stay composable (a filter on a group key is pushed below the
aggregate by Catalyst).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from . import metrics as M

# Fixed value: label of commits without category in the personal views.
UNCATEGORIZED = "UNCATEGORIZED"


def repo_names(repositories: DataFrame) -> DataFrame:
    return repositories.select(F.col("id").alias("repository_id"),
                               F.col("name").alias("repository_name"),
                               F.col("url").alias("repository_url"))


# ------------------------------------------------------------- filters ----
def active(commits: DataFrame) -> DataFrame:
    """P5: statistics never count reverted work."""
    return commits.where(F.col("weight") > 0)


def categorized(commits: DataFrame) -> DataFrame:
    """P6."""
    return commits.where(F.col("category").isNotNull() & (F.col("weight") > 0))


def with_tools(commits: DataFrame) -> DataFrame:
    """P7."""
    return commits.where(F.col("ai_tools").isNotNull() & (F.col("weight") > 0))


# ------------------------------------------------------------ builder -----
def _stats(rows: DataFrame, keys: list[tuple[str, Column]], metric_names: list[str],
           flavor: str, repositories: DataFrame | None = None,
           relabel: dict[str, Column] | None = None, category_weights: DataFrame | None = None) -> DataFrame:
    """groupBy(keys).agg(raw) -> join repository names -> project keys + metrics.

    ``keys`` are (output name, expression) pairs in output order.  The
    repository name is not a grouping key: it is attached to the aggregate by
    ``repository_id`` (names are unique, so the groups are the same).
    ``relabel`` replaces a key's output expression after grouping.  ``category_weights`` (J2: ``name, weight``, names
    unique) adds ``category_weight`` (NULL when unlisted) right after the category, also by a join of the aggregate.
    """
    group_cols = [(F.col(name) if expr is None else expr).alias(name) for name, expr in keys
                  if name not in ("repository_name", "repository_url")]
    agg = rows.groupBy(*group_cols).agg(*M.raw_aggregates(metric_names))
    if repositories is not None:
        agg = agg.join(repo_names(repositories), "repository_id", "inner")
    relabel, names = relabel or {}, [name for name, _ in keys]
    if category_weights is not None:
        agg = agg.join(category_weights.select(F.col("name").alias("category"), F.col("weight").alias("category_weight")), "category", "left")
        names.insert(names.index("category") + 1, "category_weight")
    out_keys = [relabel.get(name, F.col(name)).alias(name) for name in names]
    return agg.select(*out_keys, *M.final_metrics(metric_names, flavor))


def _k(name: str, expr: Column | None = None) -> tuple[str, Column | None]:
    """A grouping key: output name and expression (None = the column itself)."""
    return name, expr


def of_repository(commits: DataFrame, repositories: DataFrame, name: str) -> DataFrame:
    """The commits of one repository: its id first, so that a table stored by repository is read in that
    folder only (dynamic partition pruning)."""
    ids = repositories.where(F.col("name") == name).select(F.col("id").alias("repository_id"))
    return commits.join(ids, "repository_id", "left_semi")



# ------------------------------------------------------------ list views --
def commit_details(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """P1 ``v_commit_details``: every commit with its repository, all weights."""
    c = commits.join(repo_names(repositories), "repository_id", "inner")
    return c.select(
        "id", "hash", "commit_date", "author_name", "author_email", "subject",
        "lines_added", "lines_deleted", "files_changed",
        (F.col("lines_added") + F.col("lines_deleted")).alias("lines_changed"),
        "weight", "ai_tools", "category", "repository_id", "repository_name", "repository_url")


def personal_commit_details(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """P2 ``v_personal_commit_details``: 18 columns, category labelled, all weights."""
    c = commits.join(repo_names(repositories), "repository_id", "inner")
    return c.select(
        "author_email", "author_name", "repository_id", "repository_name", "repository_url",
        F.col("id").alias("commit_id"), "hash", "commit_date", "subject",
        F.col("lines_added").cast("int").alias("lines_added"),
        F.col("lines_deleted").cast("int").alias("lines_deleted"),
        (F.col("lines_added") + F.col("lines_deleted")).cast("int").alias("lines_changed"),
        F.col("files_changed").cast("int").alias("files_changed"),
        F.col("weight").cast("int").alias("weight"),
        F.coalesce(F.col("category"), F.lit(UNCATEGORIZED)).alias("category"),
        F.col("ai_confidence").cast("smallint").alias("ai_confidence"),
        "ai_tools", "created_at")


def reverted_commits(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """P3 ``v_reverted_commits``: exactly weight 0."""
    c = commits.where(F.col("weight") == 0).join(repo_names(repositories), "repository_id", "inner")
    return c.select("repository_name", "hash", "commit_date", "author_name", "subject",
                    "lines_added", "lines_deleted", "weight")


def uncategorized_commits(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """P4 ``v_uncategorized_commits``: category IS NULL, any weight."""
    c = commits.where(F.col("category").isNull()).join(repo_names(repositories), "repository_id", "inner")
    return c.select("repository_name", "hash", "commit_date", "author_name", "subject",
                    F.col("category").isNull().alias("missing_category"))


# ------------------------------------------------------ repository views --
_REPO = [_k("repository_id"), _k("repository_name")]


def daily_stats_by_repo(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V1 ``v_daily_stats_by_repo``."""
    keys = _REPO + [_k("commit_date", dates.day("commit_date"))]
    return _stats(active(commits), keys, M.REPO_DAILY, M.TEAM, repositories)


def weekly_stats_by_repo(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V2 ``v_weekly_stats_by_repo``: Monday week, calendar year and ISO week."""
    keys = _REPO + [_k("week_start_date", dates.week_start("commit_date")),
                    _k("year", F.year("commit_date")),
                    _k("week_number", dates.iso_week("commit_date"))]
    return _stats(active(commits), keys, M.REPO_WEEKLY, M.TEAM, repositories)


def _month_keys(with_numbers: bool = True) -> list:
    keys = [_k("month_start_date", dates.month_start("commit_date")),
            _k("year_month", dates.year_month("commit_date"))]
    if with_numbers:
        keys += [_k("year", F.year("commit_date")), _k("month", F.month("commit_date"))]
    return keys


def monthly_stats_by_repo(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V3 ``mv_monthly_stats_by_repo``: V1 metrics plus per-author averages."""
    return _stats(active(commits), _REPO + _month_keys(), M.REPO_MONTHLY, M.TEAM, repositories)


def contributor_stats(commits: DataFrame) -> DataFrame:
    """V4 ``v_contributor_stats``: one row per (email, name) pair."""
    keys = [_k("author_email"), _k("author_name")]
    return _stats(active(commits), keys, M.CONTRIBUTOR, M.TEAM)


def ai_tools_stats(commits: DataFrame) -> DataFrame:
    """V5 ``v_ai_tools_stats``: the combined tool string is the key (never exploded)."""
    return _stats(with_tools(commits), [_k("ai_tools")], M.AI_TOOLS, M.TEAM)


def ai_tools_by_repo(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V6 ``v_ai_tools_by_repo``: keyed by repository name and tool string."""
    keys = [_k("repository_id"), _k("repository_name"), _k("ai_tools")]
    out = _stats(with_tools(commits), keys, M.AI_TOOLS_BY_REPO, M.TEAM, repositories)
    return out.drop("repository_id")


# -------------------------------------------------------- category views --
def category_stats(commits: DataFrame, category_weights: DataFrame | None = None) -> DataFrame:
    """V7 ``v_category_stats`` (J2: optional ``category_weight`` after the category)."""
    return _stats(categorized(commits), [_k("category")], M.CATEGORY, M.TEAM, category_weights=category_weights)


def category_by_repo(commits: DataFrame, repositories: DataFrame,
                     category_weights: DataFrame | None = None) -> DataFrame:
    """V8 ``v_category_by_repo``."""
    return _stats(categorized(commits), _REPO + [_k("category")], M.CATEGORY_BY_REPO, M.TEAM, repositories, category_weights=category_weights)


def monthly_category_stats(commits: DataFrame, repositories: DataFrame,
                           category_weights: DataFrame | None = None) -> DataFrame:
    """V9 ``mv_monthly_category_stats``."""
    keys = _REPO + _month_keys(with_numbers=False) + [_k("category")]
    return _stats(categorized(commits), keys, M.CATEGORY_BY_REPO, M.TEAM, repositories, category_weights=category_weights)


# ---------------------------------------------------------- author views --
_AUTHOR = [_k("author_email"), _k("author_name")]


def daily_stats_by_author(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V10 ``v_daily_stats_by_author``."""
    keys = _AUTHOR + _REPO + [_k("commit_date", dates.day("commit_date"))]
    return _stats(active(commits), keys, M.AUTHOR_DAILY, M.AUTHOR, repositories)


def weekly_stats_by_author(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V11 ``v_weekly_stats_by_author``."""
    keys = _AUTHOR + _REPO + [_k("week_start_date", dates.week_start("commit_date")),
                              _k("year", F.year("commit_date")),
                              _k("week_number", dates.iso_week("commit_date"))]
    return _stats(active(commits), keys, M.AUTHOR_WEEKLY, M.AUTHOR, repositories)


def monthly_stats_by_author(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """V12 ``mv_monthly_stats_by_author`` (no per-author averages, unlike V3)."""
    keys = _AUTHOR + _REPO + _month_keys()
    return _stats(active(commits), keys, M.AUTHOR_DAILY, M.AUTHOR, repositories)


def _raw_category_rows(commits: DataFrame):
    """Group on the raw category; the label is applied after grouping, so a real
    ``UNCATEGORIZED`` category and NULL stay two rows with the same label."""
    return active(commits), {"category": F.coalesce(F.col("category"), F.lit(UNCATEGORIZED))}


def category_stats_by_author(commits: DataFrame, category_weights: DataFrame | None = None) -> DataFrame:
    """V13 ``v_category_stats_by_author``."""
    rows, label = _raw_category_rows(commits)
    return _stats(rows, _AUTHOR + [_k("category")], M.AUTHOR_CATEGORY, M.AUTHOR, relabel=label, category_weights=category_weights)


def category_by_author_and_repo(commits: DataFrame, repositories: DataFrame,
                                category_weights: DataFrame | None = None) -> DataFrame:
    """V14 ``v_category_by_author_and_repo``."""
    rows, label = _raw_category_rows(commits)
    keys = _AUTHOR + _REPO + [_k("category")]
    return _stats(rows, keys, M.AUTHOR_CATEGORY_BY_REPO, M.AUTHOR, repositories, relabel=label, category_weights=category_weights)


def monthly_category_stats_by_author(commits: DataFrame, repositories: DataFrame,
                                     category_weights: DataFrame | None = None) -> DataFrame:
    """V15 ``mv_monthly_category_stats_by_author``."""
    rows, label = _raw_category_rows(commits)
    keys = _AUTHOR + _REPO + _month_keys(with_numbers=False) + [_k("category")]
    return _stats(rows, keys, M.AUTHOR_CATEGORY_BY_REPO, M.AUTHOR, repositories, relabel=label, category_weights=category_weights)


# ----------------------------------------------------------- L1 ordering --
# The declared order of each view (column, descending?).
DECLARED_ORDER = {
    "commit_details": [],
    "personal_commit_details": [("commit_date", True)],
    "reverted_commits": [("commit_date", True)],
    "uncategorized_commits": [("commit_date", True)],
    "daily_stats_by_repo": [("commit_date", True), ("repository_name", False)],
    "weekly_stats_by_repo": [("week_start_date", True), ("repository_name", False)],
    "monthly_stats_by_repo": [],
    "contributor_stats": [("total_commits", True)],
    "ai_tools_stats": [("total_commits", True)],
    "ai_tools_by_repo": [("repository_name", False), ("total_commits", True)],
    "category_stats": [("total_commits", True)],
    "category_by_repo": [("repository_name", False), ("total_commits", True)],
    "monthly_category_stats": [("repository_name", False), ("month_start_date", True), ("total_commits", True)],
    "daily_stats_by_author": [("author_email", False), ("commit_date", True), ("repository_name", False)],
    "weekly_stats_by_author": [("author_email", False), ("week_start_date", True), ("repository_name", False)],
    "monthly_stats_by_author": [],
    "category_stats_by_author": [("author_email", False), ("total_commits", True)],
    "category_by_author_and_repo": [("author_email", False), ("repository_name", False), ("total_commits", True)],
    "monthly_category_stats_by_author": [("author_email", False), ("repository_name", False),
                                         ("month_start_date", True), ("total_commits", True)],
}


def presented(view: str, df: DataFrame) -> DataFrame:
    """L1: a view in its declared order (a final global sort; apply last).

    Views themselves stay unsorted so that filters and aggregates compose;
    the sort is range-partitioned by Spark, not gathered into one task.
    """
    keys = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in DECLARED_ORDER[view]]
    return df.orderBy(*keys) if keys else df
