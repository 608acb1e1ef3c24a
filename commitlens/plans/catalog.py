"""Registry of queries: name -> (Spark builder, DuckDB oracle SQL or None).

Names follow ``<survey id>_<short name>``.  Every builder takes
``(spark, sf_dir)``, reads the driver tables under ``sf_dir`` and returns a
DataFrame.  Builders are lazy but for those of ``load_scenarios``, which write and read files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import views as V
from ..session import configure
from . import oracle
from .oracle_views import VIEW_SQL
from .tables import commits, repositories

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run
    return deco


def _cr(spark, sf_dir):
    return commits(spark, sf_dir), repositories(spark, sf_dir)


def _view(name: str, key: str, fn, needs_repos: bool):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, r = _cr(spark, sf_dir)
        return fn(c, r) if needs_repos else fn(c)
    build.__name__ = name
    build.__doc__ = fn.__doc__
    register(name, oracle.with_commits(VIEW_SQL[key]))(build)


for _name, _key, _fn, _repos in [
    ("p1_commit_details", "p1", V.commit_details, True),
    ("p2_personal_commit_details", "p2", V.personal_commit_details, True),
    ("p3_reverted_commits", "p3", V.reverted_commits, True),
    ("p4_uncategorized_commits", "p4", V.uncategorized_commits, True),
    ("v1_daily_stats_by_repo", "v1", V.daily_stats_by_repo, True),
    ("v2_weekly_stats_by_repo", "v2", V.weekly_stats_by_repo, True),
    ("v3_monthly_stats_by_repo", "v3", V.monthly_stats_by_repo, True),
    ("v4_contributor_stats", "v4", V.contributor_stats, False),
    ("v5_ai_tools_stats", "v5", V.ai_tools_stats, False),
    ("v6_ai_tools_by_repo", "v6", V.ai_tools_by_repo, True),
    ("v7_category_stats", "v7", V.category_stats, False),
    ("v8_category_by_repo", "v8", V.category_by_repo, True),
    ("v9_monthly_category_stats", "v9", V.monthly_category_stats, True),
    ("v10_daily_stats_by_author", "v10", V.daily_stats_by_author, True),
    ("v11_weekly_stats_by_author", "v11", V.weekly_stats_by_author, True),
    ("v12_monthly_stats_by_author", "v12", V.monthly_stats_by_author, True),
    ("v13_category_stats_by_author", "v13", V.category_stats_by_author, False),
    ("v14_category_by_author_and_repo", "v14", V.category_by_author_and_repo, True),
    ("v15_monthly_category_stats_by_author", "v15", V.monthly_category_stats_by_author, True),
]:
    _view(_name, _key, _fn, _repos)


# ------------------------------------------------------------- queries ----
from . import oracle_queries as OQ  # noqa: E402
from . import queries as Q  # noqa: E402

# Parameters of the registered queries (a repository, an author, a date).
PARAMS = {"repository": OQ.REPO, "author": OQ.AUTHOR, "as_of": OQ.AS_OF,
          "before": ("1997-01-01", "1997-12-31"), "after": ("1998-01-01", "1998-12-31")}


def _q(name: str, fn):
    """Register ``fn(commits, repositories)`` with the oracle SQL of the same name."""
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, r = _cr(spark, sf_dir)
        return fn(c, r)
    build.__name__ = name
    register(name, OQ.SQL.get(name))(build)


P = PARAMS
for _name, _fn in [
    ("q1_repository_monthly_trend", lambda c, r: Q.repository_monthly_trend(c, r, P["repository"])),
    ("q2_top_contributors", lambda c, r: Q.top_contributors(c, 10)),
    ("q3_daily_activity", lambda c, r: Q.daily_activity(c, r, P["as_of"], 30)),
    ("q4_compare_repositories", lambda c, r: Q.compare_repositories(c, r, from_date="1998-01-01")),
    ("q5_before_after", lambda c, r: Q.before_after(c, r, P["before"], P["after"])),
    ("q6_before_after_change", lambda c, r: Q.before_after_change(c, r, P["before"], P["after"])),
    ("q7_weight_efficiency_over_time", lambda c, r: Q.weight_efficiency_over_time(c, r, "1995-01-01")),
    ("q8_discounted_repositories", lambda c, r: Q.discounted_repositories(c, r)),
    ("p8_personal_commits", lambda c, r: Q.personal_commits(c, r, P["author"], limit=50)),
    ("q9a_personal_monthly", lambda c, r: Q.personal_monthly(c, r, P["author"])),
    ("q9b_personal_daily", lambda c, r: Q.personal_daily(c, r, P["author"], P["as_of"], 90)),
    ("q9c_personal_categories", lambda c, r: Q.personal_categories(c, P["author"])),
    ("q9d_personal_category_trend", lambda c, r: Q.personal_category_trend(c, r, P["author"], 20)),
    ("q10_ai_coverage", lambda c, r: Q.ai_coverage(c)),
    ("q11_category_coverage", lambda c, r: Q.category_coverage(c)),
    ("q12_revert_rate", lambda c, r: Q.revert_rate(c)),
    ("q13_with_vs_without_tools", lambda c, r: Q.with_vs_without_tools(c)),
    ("q14_monthly_ai_adoption", lambda c, r: Q.monthly_ai_adoption(c)),
    ("q15_weighted_vs_raw_lines", lambda c, r: Q.weighted_vs_raw_lines(c, r, P["repository"])),
    ("q16_repository_overview", lambda c, r: Q.repository_overview(c, r)),
    ("q17_global_monthly_trend", lambda c, r: Q.global_monthly_trend(c)),
    ("q18_overview_totals", lambda c, r: Q.overview_totals(c, r)),
    ("q19_trend_cards", lambda c, r: Q.trend_cards(c, P["as_of"])),
    ("q20_commits_per_committer", lambda c, r: Q.commits_per_committer(c)),
    ("q21_category_trend", lambda c, r: Q.category_trend(c, r, P["as_of"], 12)),
    ("q21_category_trend_repo", lambda c, r: Q.category_trend(c, r, P["as_of"], 12, P["repository"])),
    ("q22_category_list", lambda c, r: Q.category_list(c)),
    ("q22_category_list_repo", lambda c, r: Q.category_list(c, r, P["repository"])),
    ("q23_category_share_monthly", lambda c, r: Q.category_share(c, monthly=True)),
    ("q23_category_share_overall", lambda c, r: Q.category_share(c, monthly=False)),
    ("q24_category_repository_matrix", lambda c, r: Q.category_repository_matrix(c, r)),
    ("q25_activity_by_weekday_hour", lambda c, r: Q.activity_by_weekday_hour(c)),
    ("q26_calendar_heatmap", lambda c, r: Q.calendar_heatmap(c)),
    ("q27_newest_reverted", lambda c, r: Q.newest(V.reverted_commits(c, r), 20)),
    ("q27_newest_uncategorized", lambda c, r: Q.newest(V.uncategorized_commits(c, r), 20)),
    ("q28_category_vocabulary", lambda c, r: Q.category_vocabulary(c, r)),
    ("q29_category_usage_seed", lambda c, r: Q.category_usage_seed(c)),
    ("w1_contributor_ranking", lambda c, r: Q.contributor_ranking(c)),
    ("w1_contributor_podium", lambda c, r: Q.contributor_ranking(c, podium=3)),
    ("w2_month_over_month", lambda c, r: Q.month_over_month(c, r)),
    ("w3_repository_share", lambda c, r: Q.repository_share(c, r)),
    ("p12_recategorize", lambda c, r: Q.recategorize(c, "HOTFIX", "%hotfix%", "% fix %")
     .select("repository_id", "hash", "category")),
]:
    _q(_name, _fn)


# ------------------------------------------------------------ operators ---
from . import load_scenarios as LS  # noqa: E402
from . import oracle_ops as OO  # noqa: E402
from . import scenarios as SC  # noqa: E402
from ..operators import weights as _W  # noqa: E402


def _op(name: str, fn):
    """Register ``fn(spark, sf_dir)`` with the oracle SQL of the same name."""
    register(name, OO.SQL.get(name))(fn)


for _name, _fn in [
    ("t1_category_rules", SC.category_rules),
    ("t4_category_quality_audit", SC.category_quality_audit),
    ("t5_ai_tools_from_body", SC.tool_rules),
    ("t6_tool_names", SC.tool_names),
    ("t7_reference_rules", SC.reference_rules),
    ("t8_repository_name_from_url", SC.repository_names_from_urls),
    ("t9_git_dates", SC.git_dates),
    ("t10_diff_truncation", SC.diff_truncation),
    ("j3_revert_matches", SC.revert_matches),
    ("u1_zeroed_keys", SC.zeroed_keys),
    ("o2_revert_weighting", SC.weights_after),
    ("o2_revert_weighting_documented", lambda s, d: SC.weights_after(s, d, _W.DOCUMENTED)),
    ("p14_weighting_one_repository", SC.weights_one_repository),
    ("o3_weighting_plan", SC.weighting_plan),
    ("o4_weighting_summary", SC.weighting_summary),
    ("o4_weighting_warnings", SC.weighting_warnings),
    ("o4_reverts_without_number", SC.reverts_without_number),
    ("w4_last_write_wins", SC.export_latest),
    ("w4_new_key_twice", SC.new_key_twice),
    ("s1_export_rows", LS.export_document_rows),
    ("s2_git_log", LS.git_log_rows),
    ("s5_ingest", LS.ingested_table),
    ("s6_duplicate_documents", LS.duplicate_documents),
    ("s9_snapshot", LS.snapshot_rows),
    ("o5_pipeline", LS.pipeline_statistics),
    ("s4_upsert_commits", SC.upserted),
    ("s12_load_statistics", SC.load_stats),
    ("s13_constraint_audit", SC.audit),
    ("s6_load_repositories", SC.repositories_loaded),
    ("s7_delete_repository", SC.after_cleanup),
    ("s8_deletion_preview", SC.cleanup_preview),
    ("j5_orphan_commits", SC.orphan_commits),
    ("s11_export_summary", SC.export_summary),
    ("q25_event_activity_by_weekday_hour", SC.event_activity),
    ("s3_export_rows", SC.export_rows),
    ("t11_prompt_text", SC.prompts),
    ("t11_prompt_with_diff", SC.prompts_with_diff),
    ("x1_enrichment", SC.model_enriched),
    ("t12_response_parsing", SC.parsed_responses),
    ("t13_enrichment_merge", SC.enriched),
]:
    _op(_name, _fn)


def _j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = commits(spark, sf_dir)
    return V.category_stats(c, SC.category_weights(c))


_op("j2_category_stats_weighted", _j2)


def _l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, r = _cr(spark, sf_dir)
    return V.presented("daily_stats_by_author", V.daily_stats_by_author(c, r))


register("l1_presented_daily_stats_by_author",
         oracle.with_commits(VIEW_SQL["v10"] + "\nORDER BY c.author_email, CAST(c.commit_date AS DATE) DESC, r.name"))(_l1)
