"""Published and dashboard queries over the views.

Every query takes its parameters as arguments - repository, author, date
windows and an explicit ``as_of`` date (the wall clock is never read).  Where
the reference leaves an average unrounded (``AVG`` over a view column), the
engine rounds it half-up to ``AVG_SCALE`` decimals in exact integer arithmetic
so that results are stable across engines.

Sorting is presentation only (``orderBy`` at the very end); top-k queries carry
a total tie-break so that ``limit`` is deterministic.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.numeric import ratio
from ..operators import views as V
from ..operators.ranking import descending_level, row_number_by_levels, text_level

AVG_SCALE = 4


def _d(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat()[:10]
    return F.to_date(F.lit(value))


def _cents(c: str, scale: int = 2) -> Column:
    """A double that holds an exact ``scale``-decimal value, as an integer."""
    return F.round(F.col(c) * (10 ** scale)).cast("long")


# ---------------------------------------------------------------- Q1 / Q15 -
def repository_monthly_trend(commits: DataFrame, repositories: DataFrame, repository: str) -> DataFrame:
    """Q1: V3 of one repository, newest month first."""
    v3 = V.monthly_stats_by_repo(V.of_repository(commits, repositories, repository), repositories)
    return (v3.orderBy(F.col("month_start_date").desc())
            .select("year_month", "total_commits", "total_lines_changed", "unique_authors",
                    "avg_lines_changed_per_commit", "avg_commits_per_author"))


def weighted_vs_raw_lines(commits: DataFrame, repositories: DataFrame, repository: str) -> DataFrame:
    """Q15: raw against weighted lines by month for one repository."""
    v3 = V.monthly_stats_by_repo(V.of_repository(commits, repositories, repository), repositories)
    return (v3.orderBy(F.col("year_month").desc())
            .select("repository_name", "year_month", "total_lines_changed", "weighted_lines_changed"))


# ---------------------------------------------------------------- Q2 / L2 --
def top_contributors(commits: DataFrame, k: int = 10) -> DataFrame:
    """Q2: V4 by commits, ties broken on email then name, first ``k``."""
    v4 = V.contributor_stats(commits)
    return (v4.orderBy(F.col("total_commits").desc(), "author_email", "author_name").limit(k)
            .select("author_name", "author_email", "total_commits", "repositories_contributed",
                    "total_lines_changed", "avg_lines_changed_per_commit"))


# ---------------------------------------------------------------- Q3 / P9 --
def trailing_days(col: str, as_of, days: int) -> Column:
    """``col >= as_of - days``."""
    return F.col(col) >= F.date_sub(_d(as_of), days)


def trailing_months(col: str, as_of, months: int) -> Column:
    return F.col(col) >= F.add_months(_d(as_of), -months)


def daily_activity(commits: DataFrame, repositories: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Q3: V1 over the last ``days`` days before ``as_of``."""
    v1 = V.daily_stats_by_repo(commits, repositories).where(trailing_days("commit_date", as_of, days))
    return (v1.orderBy(F.col("commit_date").desc(), "repository_name")
            .select("commit_date", "repository_name", "total_commits", "total_lines_changed", "unique_authors"))


# --------------------------------------------------------------------- Q4 --
def compare_repositories(commits: DataFrame, repositories: DataFrame, as_of=None,
                         from_date=None, months: int = 6) -> DataFrame:
    """Q4: V3 re-aggregated per repository from ``from_date`` (or the last ``months``)."""
    v3 = V.monthly_stats_by_repo(commits, repositories)
    start = _d(from_date) if from_date is not None else F.add_months(_d(as_of), -months)
    g = (v3.where(F.col("month_start_date") >= start)
         .groupBy("repository_name")
         .agg(F.sum("total_commits").alias("commits"),
              F.sum("total_lines_changed").alias("lines_changed"),
              F.countDistinct("year_month").alias("months_active"),
              F.sum("unique_authors").alias("_sa"), F.count(F.lit(1)).alias("_n")))
    return (g.select("repository_name", "commits", "lines_changed", "months_active",
                     ratio("_sa", "_n", AVG_SCALE).alias("avg_authors_per_month"),
                     ratio("lines_changed", "commits", 2).alias("avg_lines_per_commit"))
            .orderBy(F.col("commits").desc()))


# ----------------------------------------------------------------- Q5 / Q6 -
def _period_averages(commits, repositories, repository, before, after):
    if repository is not None:
        commits = V.of_repository(commits, repositories, repository)
    v3 = V.monthly_stats_by_repo(commits, repositories)
    m = F.col("month_start_date")
    period = (F.when(m.between(_d(before[0]), _d(before[1])), F.lit("before"))
              .when(m.between(_d(after[0]), _d(after[1])), F.lit("after")))
    return (v3.select(period.alias("period"), _cents("avg_lines_changed_per_commit").alias("_lpc"),
                      "total_commits", "unique_authors", "total_lines_added", "total_lines_deleted")
            .where(F.col("period").isNotNull())
            .groupBy("period")
            .agg(F.sum("_lpc").alias("_slpc"), F.sum("total_commits").alias("_sc"),
                 F.sum("unique_authors").alias("_sa"), F.count(F.lit(1)).alias("_n"),
                 F.sum("total_lines_added").alias("lines_added"),
                 F.sum("total_lines_deleted").alias("lines_deleted")))


def before_after(commits: DataFrame, repositories: DataFrame, before, after,
                 repository: str | None = None) -> DataFrame:
    """Q5: monthly means in two date ranges, one pass with a period label."""
    g = _period_averages(commits, repositories, repository, before, after)
    return g.select("period",
                    ratio("_slpc", "_n * 100", AVG_SCALE).alias("avg_lines_per_commit"),
                    ratio("_sc", "_n", AVG_SCALE).alias("avg_commits_per_month"),
                    ratio("_sa", "_n", AVG_SCALE).alias("avg_authors"))


def _pct_change(after: str, before: str) -> Column:
    """round((after - before) / before * 100, 1) half away from zero; NULL if before is 0.

    Operands are integers scaled by the same factor, so the ratio is exact.
    """
    num = f"(({after}) - ({before})) * 100"
    den = f"NULLIF({before}, 0)"
    mag = f"((2 * abs({num}) * 10 + {den}) div (2 * {den}))"
    return F.expr(f"CAST(CASE WHEN {num} < 0 THEN -{mag} ELSE {mag} END AS DOUBLE) / 10")


def before_after_change(commits: DataFrame, repositories: DataFrame, before, after,
                        repository: str | None = None) -> DataFrame:
    """Q6: percent change of the Q5 means (NULL when the before value is 0),
    plus lines added/deleted per period.  One row."""
    g = _period_averages(commits, repositories, repository, before, after)
    # Means as integers scaled by 10^6 (the lines mean carries cents already).
    p = 10 ** 6
    g = g.select("period", "lines_added", "lines_deleted",
                 F.expr(f"(_slpc * {p // 100}) div _n").alias("_lpc6"),
                 F.expr(f"(_sc * {p}) div _n").alias("_c6"),
                 F.expr(f"(_sa * {p}) div _n").alias("_a6"))
    wide = g.agg(*[F.max(F.when(F.col("period") == per, F.col(c))).alias(f"{c}_{per}")
                   for per in ("before", "after")
                   for c in ("_lpc6", "_c6", "_a6", "lines_added", "lines_deleted")])
    return wide.select(
        _pct_change("_lpc6_after", "_lpc6_before").alias("lines_per_commit_change_pct"),
        _pct_change("_c6_after", "_c6_before").alias("commits_change_pct"),
        _pct_change("_a6_after", "_a6_before").alias("authors_change_pct"),
        F.col("lines_added_before"), F.col("lines_added_after"),
        F.col("lines_deleted_before"), F.col("lines_deleted_after"))


# ----------------------------------------------------------------- Q7 / Q8 -
def weight_efficiency_over_time(commits: DataFrame, repositories: DataFrame, from_date) -> DataFrame:
    """Q7."""
    v3 = V.monthly_stats_by_repo(commits, repositories).where(F.col("month_start_date") >= _d(from_date))
    return (v3.orderBy("repository_name", F.col("year_month").desc())
            .select("repository_name", "year_month", "total_commits", "effective_commits", "avg_weight",
                    "weight_efficiency_pct", "total_lines_changed", "weighted_lines_changed"))


def discounted_repositories(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """Q8: repositories whose mean monthly efficiency is below 100."""
    v3 = V.monthly_stats_by_repo(commits, repositories)
    g = (v3.groupBy("repository_name")
         .agg(F.sum("total_commits").alias("total_commits"),
              F.sum(_cents("effective_commits")).alias("_ec"),
              F.sum(_cents("weight_efficiency_pct", 1)).alias("_we"),
              F.count(F.lit(1)).alias("_n"))
         .where(F.col("_we") < F.col("_n") * 1000))
    return (g.select("repository_name", "total_commits",
                     (F.col("_ec").cast("double") / 100).alias("effective_commits"),
                     ratio("_we", "_n * 10", 1).alias("avg_efficiency_pct"),
                     ((F.col("total_commits") * 100 - F.col("_ec")).cast("double") / 100).alias("discounted_commits"))
            .orderBy(F.col("discounted_commits").desc()))


# --------------------------------------------------------------- Q9 / P8 ---
def personal_commits(commits: DataFrame, repositories: DataFrame, author_email: str,
                     repository: str | None = None, since=None, category: str | None = None,
                     limit: int | None = 50) -> DataFrame:
    """One author's commits, newest first, optional repository/date/category."""
    p2 = V.personal_commit_details(commits, repositories).where(F.col("author_email") == author_email)
    if repository is not None:
        p2 = p2.where(F.col("repository_name") == repository)
    if since is not None:
        p2 = p2.where(F.col("commit_date") >= _d(since))
    if category is not None:
        p2 = p2.where(F.col("category") == category)
    out = p2.orderBy(F.col("commit_date").desc(), "hash")
    if limit is not None:
        out = out.limit(limit)
    return out.select("commit_date", "repository_name", "hash", "subject", "lines_changed", "weight",
                      "category", "ai_tools")


def personal_monthly(commits: DataFrame, repositories: DataFrame, author_email: str) -> DataFrame:
    """Q9 (a): V12 for one author."""
    v12 = V.monthly_stats_by_author(commits, repositories).where(F.col("author_email") == author_email)
    return (v12.orderBy(F.col("month_start_date").desc())
            .select("year_month", "repository_name", "author_name", "total_commits", "total_lines_changed",
                    "effective_commits", "avg_weight", "weight_efficiency_pct"))


def personal_daily(commits: DataFrame, repositories: DataFrame, author_email: str, as_of,
                   days: int = 30) -> DataFrame:
    """Q9 (b): V10 for one author over the last ``days`` days."""
    v10 = (V.daily_stats_by_author(commits, repositories)
           .where((F.col("author_email") == author_email) & trailing_days("commit_date", as_of, days)))
    return (v10.orderBy(F.col("commit_date").desc())
            .select("commit_date", "repository_name", "author_name", "total_commits", "total_lines_changed",
                    "weighted_lines_changed"))


def personal_categories(commits: DataFrame, author_email: str) -> DataFrame:
    """Q9 (c): V13 for one author (the column is ``repositories_count``)."""
    v13 = V.category_stats_by_author(commits).where(F.col("author_email") == author_email)
    return (v13.orderBy(F.col("total_commits").desc())
            .select("author_name", "category", "total_commits", "effective_commits", "weighted_lines_changed",
                    "weight_efficiency_pct", "repositories_count"))


def personal_category_trend(commits: DataFrame, repositories: DataFrame, author_email: str,
                            k: int = 20) -> DataFrame:
    """Q9 (d): V15 for one author, newest 20 with a total tie-break."""
    v15 = V.monthly_category_stats_by_author(commits, repositories).where(F.col("author_email") == author_email)
    return (v15.orderBy(F.col("month_start_date").desc(), F.col("total_commits").desc(),
                        "repository_name", "author_name", "category").limit(k)
            .select("year_month", "repository_name", "author_name", "category", "total_commits",
                    "weighted_lines_changed", "avg_lines_per_commit"))


# ------------------------------------------------------------ Q10 - Q14 ---
def ai_coverage(commits: DataFrame) -> DataFrame:
    """Q10: categorised and AI-scored commits, mean confidence (all weights)."""
    g = commits.agg(F.count_if(F.col("category").isNotNull()).alias("categorized"),
                    F.count_if(F.col("ai_confidence").isNotNull()).alias("ai_categorized"),
                    F.sum(F.col("ai_confidence").cast("long")).alias("_sc"),
                    F.count("ai_confidence").alias("_nc"))
    return g.select("categorized", "ai_categorized", ratio("_sc", "_nc", 1).alias("avg_confidence"))


def category_coverage(commits: DataFrame) -> DataFrame:
    """Q11."""
    g = commits.agg(F.count(F.lit(1)).alias("total_commits"), F.count("category").alias("categorized"))
    return g.select("total_commits", "categorized",
                    ratio("categorized * 100", "total_commits", 1).alias("category_pct"))


def revert_rate(commits: DataFrame) -> DataFrame:
    """Q12."""
    g = commits.agg(F.count_if(F.col("weight") == 0).alias("reverted"), F.count(F.lit(1)).alias("total"))
    return g.select("reverted", "total", ratio("reverted * 100", "total", 1).alias("revert_pct"))


def with_vs_without_tools(commits: DataFrame) -> DataFrame:
    """Q13: includes weight 0, as the published SQL reads the table directly."""
    usage = F.when(F.col("ai_tools").isNotNull(), F.lit("With AI Tools")).otherwise(F.lit("Without AI Tools"))
    lines = F.col("lines_added").cast("long") + F.col("lines_deleted").cast("long")
    g = (commits.groupBy(usage.alias("tool_usage"))
         .agg(F.count(F.lit(1)).alias("commits"), F.sum(lines).alias("_sl"),
              F.sum(lines * F.col("weight").cast("long")).alias("_slw")))
    return g.select("tool_usage", "commits", ratio("_sl", "commits", 1).alias("avg_lines_per_commit"),
                    F.expr("(2 * _slw + 100) div 200").alias("total_weighted_lines"))


def monthly_ai_adoption(commits: DataFrame) -> DataFrame:
    """Q14: per ``YYYY-MM``, all weights."""
    g = (commits.groupBy(dates.year_month("commit_date").alias("month"))
         .agg(F.count_if(F.col("ai_tools").isNotNull()).alias("with_ai"), F.count(F.lit(1)).alias("total")))
    return (g.select("month", "with_ai", "total", ratio("with_ai * 100", "total", 1).alias("ai_usage_pct"))
            .orderBy(F.col("month").desc()))


# ------------------------------------------------------------ Q16 - Q20 ---
def _scope(commits: DataFrame, include_reverted: bool) -> DataFrame:
    return commits if include_reverted else V.active(commits)


def repository_overview(commits: DataFrame, repositories: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q16: every repository with commit count, latest date and contributors (0 if none)."""
    g = (_scope(commits, include_reverted).groupBy("repository_id")
         .agg(F.count(F.lit(1)).alias("_n"), F.max("commit_date").alias("latest_commit_date"),
              F.countDistinct("author_email").alias("_c")))
    repos = repositories.select(F.col("id"), F.col("name"), F.col("description"))
    j = repos.join(g, repos.id == g.repository_id, "left")
    return j.select("id", "name", "description",
                    F.coalesce(F.col("_n"), F.lit(0)).alias("total_commits"),
                    "latest_commit_date",
                    F.coalesce(F.col("_c"), F.lit(0)).alias("contributors"))


def global_monthly_trend(commits: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q17: month over all repositories; authors are recounted, never summed."""
    c = _scope(commits, include_reverted)
    lines = F.col("lines_added").cast("long") + F.col("lines_deleted").cast("long")
    g = (c.groupBy(dates.month_start("commit_date").alias("month_start_date"),
                   dates.year_month("commit_date").alias("year_month"))
         .agg(F.count(F.lit(1)).alias("total_commits"),
              F.countDistinct("author_email").alias("unique_authors"),
              F.countDistinct("repository_id").alias("active_repositories"),
              F.sum(lines).alias("total_lines_changed"),
              F.sum(lines * F.col("weight").cast("long")).alias("_slw"),
              F.sum(F.col("weight").cast("long")).alias("_sw")))
    return g.select("month_start_date", "year_month", "total_commits", "unique_authors",
                    "active_repositories", "total_lines_changed",
                    (F.col("_slw").cast("double") / 100).alias("weighted_lines_changed"),
                    (F.col("_sw").cast("double") / 100).alias("effective_commits"))


def overview_totals(commits: DataFrame, repositories: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q18: repositories, commits, contributors, active repositories (one row).

    Repository rows and commit rows go through one global aggregate, so no
    join of two single-row results is needed.
    """
    rows = repositories.select(F.lit(1).alias("_is_repo"), F.lit(None).cast("string").alias("author_email"),
                               F.lit(None).cast("int").alias("repository_id"))
    rows = rows.unionByName(_scope(commits, include_reverted)
                            .select(F.lit(0).alias("_is_repo"), "author_email", "repository_id"))
    return rows.agg(F.sum("_is_repo").cast("long").alias("repositories"),
                    F.count_if(F.col("_is_repo") == 0).alias("commits"),
                    F.countDistinct("author_email").alias("contributors"),
                    F.countDistinct("repository_id").alias("active_repositories"))


TREND_WINDOWS = [("3m", 3), ("6m", 6), ("12m", 12), ("24m", 24), ("all", None)]


def trend_cards(commits: DataFrame, as_of, include_reverted: bool = False) -> DataFrame:
    """Q19: mean commits/month, lines/commit and contributors/month per window.

    One conditional aggregate over the monthly trend computes every window;
    ``stack`` turns the columns into one row per window.
    """
    q17 = global_monthly_trend(commits, include_reverted)
    aggs = []
    for label, months in TREND_WINDOWS:
        inside = (F.lit(True) if months is None
                  else F.col("month_start_date") >= F.add_months(F.trunc(_d(as_of), "month"), -(months - 1)))
        aggs += [F.count_if(inside).alias(f"m_{label}"),
                 F.sum(F.when(inside, F.col("total_commits"))).alias(f"c_{label}"),
                 F.sum(F.when(inside, F.col("total_lines_changed"))).alias(f"l_{label}"),
                 F.sum(F.when(inside, F.col("unique_authors"))).alias(f"a_{label}")]
    wide = q17.agg(*aggs)
    parts = ", ".join(f"'{label}', m_{label}, c_{label}, l_{label}, a_{label}" for label, _ in TREND_WINDOWS)
    long = wide.selectExpr(f"stack({len(TREND_WINDOWS)}, {parts}) AS (trend_window, months, _c, _l, _a)")
    return long.select("trend_window", "months",
                       ratio("_c", "months", 2).alias("avg_commits_per_month"),
                       ratio("_l", "_c", 2).alias("avg_lines_per_commit"),
                       ratio("_a", "months", 2).alias("avg_contributors_per_month"))


def commits_per_committer(commits: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q20: each month's commits divided by its distinct authors, 1 dp."""
    q17 = global_monthly_trend(commits, include_reverted)
    return q17.select("year_month", "total_commits", "unique_authors",
                      ratio("total_commits", "unique_authors", 1).alias("commits_per_author"))


# ------------------------------------------------------------ Q21 - Q24 ---
def category_trend(commits: DataFrame, repositories: DataFrame, as_of, months: int = 12,
                   repository: str | None = None) -> DataFrame:
    """Q21: categories per month over the last ``months`` months.

    With a repository: V9 rows of that repository.  Without: summed over all
    repositories straight from the commits (authors recounted).
    """
    start = F.add_months(F.trunc(_d(as_of), "month"), -(months - 1))
    if repository is not None:
        v9 = V.monthly_category_stats(V.of_repository(commits, repositories, repository), repositories)
        return (v9.where(F.col("month_start_date") >= start)
                .select("month_start_date", "year_month", "category", "total_commits", "unique_authors",
                        "weighted_lines_changed", "effective_commits"))
    c = V.categorized(commits).where(F.col("commit_date") >= start.cast("timestamp"))
    lines = F.col("lines_added").cast("long") + F.col("lines_deleted").cast("long")
    g = (c.groupBy(dates.month_start("commit_date").alias("month_start_date"),
                   dates.year_month("commit_date").alias("year_month"), "category")
         .agg(F.count(F.lit(1)).alias("total_commits"), F.countDistinct("author_email").alias("unique_authors"),
              F.sum(lines * F.col("weight").cast("long")).alias("_slw"),
              F.sum(F.col("weight").cast("long")).alias("_sw")))
    return g.select("month_start_date", "year_month", "category", "total_commits", "unique_authors",
                    (F.col("_slw").cast("double") / 100).alias("weighted_lines_changed"),
                    (F.col("_sw").cast("double") / 100).alias("effective_commits"))


def category_list(commits: DataFrame, repositories: DataFrame | None = None,
                  repository: str | None = None) -> DataFrame:
    """Q22: V7 for all repositories, or V8 of one repository, by commits."""
    if repository is None:
        return V.category_stats(commits).orderBy(F.col("total_commits").desc(), "category")
    v8 = V.category_by_repo(V.of_repository(commits, repositories, repository), repositories)
    return v8.orderBy(F.col("total_commits").desc(), "category")


def category_share(commits: DataFrame, monthly: bool = True) -> DataFrame:
    """Q23: each category's percent of commits and of weighted lines.

    Monthly: the month totals come from a window over the small per-(month,
    category) aggregate, partitioned by month.  Overall: the two totals are a
    one-row subquery over the same aggregate, so no window spans all categories.
    """
    c = V.categorized(commits)
    lines_w = (F.col("lines_added").cast("long") + F.col("lines_deleted").cast("long")) * F.col("weight").cast("long")
    keys = ([dates.month_start("commit_date").alias("month_start_date"),
             dates.year_month("commit_date").alias("year_month")] if monthly else [])
    g = c.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("total_commits"),
                                         F.sum(lines_w).alias("_slw"))
    if monthly:
        w = Window.partitionBy("month_start_date")
        g = g.withColumn("_tn", F.sum("total_commits").over(w)).withColumn("_tw", F.sum("_slw").over(w))
    else:
        total = g.agg(F.struct(F.sum("total_commits").alias("n"), F.sum("_slw").alias("w"))).scalar()
        g = g.withColumn("_tn", total["n"]).withColumn("_tw", total["w"])
    out_keys = ["month_start_date", "year_month"] if monthly else []
    return g.select(*out_keys, "category", "total_commits",
                    (F.col("_slw").cast("double") / 100).alias("weighted_lines_changed"),
                    ratio("total_commits * 100", "_tn", 1).alias("commit_share_pct"),
                    ratio("_slw * 100", "_tw", 1).alias("weighted_lines_share_pct"))


def vocabulary_lists(commits: DataFrame) -> DataFrame:
    """Q28 as lists for prompts: ``(repository_id, categories)`` sorted.

    Built from the per-(repository, category) aggregate, so a list holds one
    entry per distinct category of a repository, never one per commit.
    """
    g = (commits.where(F.col("category").isNotNull()).groupBy("repository_id", "category")
         .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    return g.groupBy("repository_id").agg(F.sort_array(F.collect_list("category")).alias("categories"))


def category_repository_matrix(commits: DataFrame, repositories: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q24: category x repository commit counts, a row per cell that has commits.

    With ``columns`` (repository names) the cells become those columns, one
    conditional sum each over the small aggregate; the schema never depends on the data.
    """
    c = V.categorized(commits).groupBy("category", "repository_id").agg(F.count(F.lit(1)).alias("total_commits"))
    c = c.join(V.repo_names(repositories), "repository_id", "inner").select("category", "repository_name", "total_commits")
    if columns is None:
        return c
    cells = [F.coalesce(F.sum(F.when(F.col("repository_name") == n, F.col("total_commits"))), F.lit(0)).alias(n)
             for n in columns]
    return c.groupBy("category").agg(*cells)


# ------------------------------------------------------------ Q25 - Q27 ---
def activity_by_weekday_hour(commits: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q25: commits per ISO weekday (1 = Monday) and hour of day."""
    c = _scope(commits, include_reverted)
    return (c.groupBy(dates.iso_weekday("commit_date").alias("iso_weekday"),
                      F.hour("commit_date").alias("hour_of_day"))
            .agg(F.count(F.lit(1)).alias("total_commits")))


def calendar_heatmap(commits: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Q26: commits per day from the first to the last day, empty days as 0.

    The day axis is generated from one (min, max) row, so its size is the date
    span, not the data size; it is joined to the per-day counts.
    """
    c = _scope(commits, include_reverted).select(dates.day("commit_date").alias("day"))
    per_day = c.groupBy("day").agg(F.count(F.lit(1)).alias("total_commits"))
    axis = per_day.agg(F.min("day").alias("_lo"), F.max("day").alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi")).alias("day"))
    return (axis.join(per_day, "day", "left")
            .select("day", F.coalesce(F.col("total_commits"), F.lit(0)).alias("total_commits")))


def newest(df: DataFrame, k: int = 20) -> DataFrame:
    """L2 / Q27: newest ``k`` rows of a list view, ties broken on repository and hash."""
    return df.orderBy(F.col("commit_date").desc(), "repository_name", "hash").limit(k)


# ------------------------------------------------------------ Q28 / Q29 ---
def category_vocabulary(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """Q28: per repository, categories used more than once (long form, sorted)."""
    g = (commits.where(F.col("category").isNotNull())
         .groupBy("repository_id", "category").agg(F.count(F.lit(1)).alias("usage_count"))
         .where(F.col("usage_count") > 1))
    return (g.join(V.repo_names(repositories), "repository_id", "inner")
            .select("repository_id", "repository_name", "category", "usage_count")
            .orderBy("repository_name", "category"))


def category_usage_seed(commits: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Q29: seed rows for a category table; names already present are kept as they are."""
    g = (commits.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("name"))
         .agg(F.count(F.lit(1)).alias("usage_count")))
    if existing is not None:
        g = g.join(existing.select("name"), "name", "left_anti")
    return g.select("name", F.lit("Extracted from existing commits").alias("description"), "usage_count")


# ------------------------------------------------------------- W1 - W3 ----
def contributor_ranking(commits: DataFrame, podium: int | None = None) -> DataFrame:
    """Rank of every contributor by commits (ties: email, name); ``podium`` keeps the top."""
    v4 = V.contributor_stats(commits).select("author_email", "author_name", "total_commits",
                                             "total_lines_changed")
    order = [F.col("total_commits").desc(), F.col("author_email"), F.col("author_name")]
    if podium is not None:
        top = v4.orderBy(*order).limit(podium)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    total = F.col("total_commits")
    return row_number_by_levels(v4, [descending_level(total), -total, text_level(F.col("author_email"))], order, "rank")


def month_over_month(commits: DataFrame, repositories: DataFrame) -> DataFrame:
    """Direction of each repository's monthly commits against the previous month."""
    v3 = V.monthly_stats_by_repo(commits, repositories).select(
        "repository_id", "repository_name", "month_start_date", "year_month", "total_commits")
    w = Window.partitionBy("repository_id").orderBy("month_start_date")
    prev = F.lag("total_commits").over(w)
    return v3.select("repository_name", "year_month", "total_commits", prev.alias("previous_commits"),
                     F.when(prev.isNull(), F.lit(None).cast("string"))
                     .when(F.col("total_commits") > prev, F.lit("up"))
                     .when(F.col("total_commits") < prev, F.lit("down"))
                     .otherwise(F.lit("flat")).alias("direction"))


def repository_share(commits: DataFrame, repositories: DataFrame, include_reverted: bool = False) -> DataFrame:
    """Each repository's share of all commits.

    The total is a one-row subquery over the per-repository aggregate.
    """
    g = (_scope(commits, include_reverted).groupBy("repository_id")
         .agg(F.count(F.lit(1)).alias("total_commits"))
         .join(V.repo_names(repositories), "repository_id", "inner"))
    g = g.withColumn("_all", g.agg(F.sum("total_commits")).scalar())
    return g.select("repository_name", "total_commits",
                    ratio("total_commits * 100", "_all", 1).alias("share_pct"))


# ------------------------------------------------------------- P11 / P12 --
def keyword_match(subject_col: str, *patterns: str) -> Column:
    """Case-insensitive ``ILIKE`` on any of the patterns."""
    cond = None
    for p in patterns:
        c = F.col(subject_col).ilike(p)
        cond = c if cond is None else (cond | c)
    return cond


def recategorize(commits: DataFrame, category: str, *patterns: str) -> DataFrame:
    """Set ``category`` where the subject matches and no category is set."""
    hit = F.col("category").isNull() & F.coalesce(keyword_match("subject", *patterns), F.lit(False))
    return commits.withColumn("category", F.when(hit, F.lit(category)).otherwise(F.col("category")))
