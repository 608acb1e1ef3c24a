"""View arithmetic and grouping rules on small hand-made frames."""
import datetime as dt

from pyspark.sql import functions as F

from commitlens import schema as S
from commitlens.operators import views as V

REPOS = [(1, "repo", "/r", None, None, None, None)]


def commits_df(spark, rows):
    """rows: (hash, date, added, deleted, files, weight, category, email, name, tools)"""
    full = []
    for i, (h, d, a, dl, f, w, cat, email, name, tools) in enumerate(rows):
        full.append((i + 1, 1, h, d, name, email, f"subject {h}", a, dl, f, None, cat, w, tools, None, None, None))
    return spark.createDataFrame(full, S.COMMITS_SCHEMA)


def repos_df(spark):
    return spark.createDataFrame(REPOS, S.REPOSITORIES_SCHEMA)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_weight_arithmetic(spark):
    rows = [("a", ts("2024-01-01 10:00"), 100, 50, 5, 100, "TEST_WEIGHT_CATEGORY", "t@x", "T", None),
            ("b", ts("2024-01-02 10:00"), 100, 50, 5, 50, "TEST_WEIGHT_CATEGORY", "t@x", "T", None),
            ("c", ts("2024-01-03 10:00"), 100, 50, 5, 0, "TEST_WEIGHT_CATEGORY", "t@x", "T", None)]
    c = commits_df(spark, rows)
    m = V.monthly_stats_by_repo(c, repos_df(spark)).first()
    assert (m["total_commits"], m["effective_commits"], m["avg_weight"], m["weight_efficiency_pct"]) == (2, 1.5, 75.0, 75.0)
    assert m["weighted_lines_changed"] == 225.0
    cat = V.category_stats(c).first()
    assert (cat["total_commits"], cat["effective_commits"], cat["avg_weight"]) == (2, 1.5, 75.0)
    assert V.reverted_commits(c, repos_df(spark)).count() == 1
    assert V.commit_details(c, repos_df(spark)).count() == 3


def test_uncategorized_label_keeps_two_rows(spark):
    rows = [("a", ts("2024-01-01 10:00"), 1, 1, 1, 100, None, "t@x", "T", None),
            ("b", ts("2024-01-01 10:00"), 1, 1, 1, 100, "UNCATEGORIZED", "t@x", "T", None)]
    out = V.category_stats_by_author(commits_df(spark, rows)).collect()
    assert sorted(r["category"] for r in out) == ["UNCATEGORIZED", "UNCATEGORIZED"]


def test_author_pair_grouping(spark):
    rows = [("a", ts("2024-01-01 10:00"), 1, 1, 1, 100, None, "t@x", "T", None),
            ("b", ts("2024-01-01 10:00"), 1, 1, 1, 100, None, "t@x", "T Jr", None)]
    c = commits_df(spark, rows)
    assert V.contributor_stats(c).count() == 2
    assert V.daily_stats_by_repo(c, repos_df(spark)).first()["unique_authors"] == 1


def test_week_straddling_new_year(spark):
    rows = [("a", ts("2020-12-31 10:00"), 1, 1, 1, 100, None, "t@x", "T", None),
            ("b", ts("2021-01-03 10:00"), 1, 1, 1, 100, None, "t@x", "T", None)]
    out = V.weekly_stats_by_repo(commits_df(spark, rows), repos_df(spark)).orderBy("year").collect()
    assert [(r["week_start_date"], r["year"], r["week_number"]) for r in out] == [
        (dt.date(2020, 12, 28), 2020, 53), (dt.date(2020, 12, 28), 2021, 53)]


def test_rounding_is_exact_on_large_groups(spark):
    # 50 lines over 10001 commits = 0.0049995...: one rounding gives 0.00, a scale-6
    # intermediate would give 0.01.
    n = 10001
    df = (spark.range(n).select(
        (F.col("id") + 1).alias("id"), F.lit(1).alias("repository_id"), F.col("id").cast("string").alias("hash"),
        F.lit(ts("2024-01-01 00:00")).alias("commit_date"), F.lit("T").alias("author_name"),
        F.lit("t@x").alias("author_email"), F.lit("s").alias("subject"),
        F.when(F.col("id") < 50, 1).otherwise(0).alias("lines_added"), F.lit(0).alias("lines_deleted"),
        F.lit(0).alias("files_changed"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("string").alias("category"), F.lit(100).alias("weight"),
        F.lit(None).cast("string").alias("ai_tools"), F.lit(None).cast("smallint").alias("ai_confidence"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("int").alias("business_impact")))
    m = V.monthly_stats_by_repo(df, repos_df(spark)).first()
    assert m["avg_lines_added_per_commit"] == 0.0
    assert m["avg_lines_changed_per_commit"] == 0.0


def test_half_up(spark):
    rows = [("a", ts("2024-01-01 10:00"), 1, 0, 1, 100, None, "t@x", "T", None),
            ("b", ts("2024-01-01 11:00"), 2, 0, 1, 100, None, "t@x", "T", None),
            ("c", ts("2024-01-01 12:00"), 2, 0, 1, 100, None, "t@x", "T", None),
            ("d", ts("2024-01-01 13:00"), 2, 0, 1, 45, None, "t@x", "T", None)]
    m = V.daily_stats_by_repo(commits_df(spark, rows), repos_df(spark)).first()
    assert m["avg_lines_added_per_commit"] == 1.75
    assert m["avg_weight"] == 86.3          # 345 / 4 = 86.25 -> 86.3 (half up)


def test_activity_days_floor(spark):
    rows = [("a", ts("2024-01-01 10:00"), 1, 0, 1, 100, None, "t@x", "T", None),
            ("b", ts("2024-01-03 09:59"), 1, 0, 1, 100, None, "t@x", "T", None)]
    assert V.contributor_stats(commits_df(spark, rows)).first()["activity_days"] == 1


def test_declared_order(spark):
    rows = [("a", ts("2024-01-01 10:00"), 1, 0, 1, 100, None, "b@x", "B", None),
            ("b", ts("2024-01-02 10:00"), 1, 0, 1, 100, None, "a@x", "A", None),
            ("c", ts("2024-01-03 10:00"), 1, 0, 1, 100, None, "a@x", "A", None)]
    c = commits_df(spark, rows)
    out = V.presented("daily_stats_by_author", V.daily_stats_by_author(c, repos_df(spark))).collect()
    assert [(r["author_email"], r["commit_date"].day) for r in out] == [("a@x", 3), ("a@x", 2), ("b@x", 1)]
