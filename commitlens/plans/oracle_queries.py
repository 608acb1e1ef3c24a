"""DuckDB twins of the published and dashboard queries.

Each entry is complete SQL (adapter + weighting CTEs included).  Parameters
are the ones the catalog registers (see ``catalog.PARAMS``).
"""

from __future__ import annotations

from .oracle import r, with_commits
from .oracle_views import VIEW_SQL

REPO = "NATION_7"
AUTHOR = "author7@example.com"
AS_OF = "2001-08-01"


def _v(*names: str) -> str:
    return ",\n".join(f"{n} AS (\n{VIEW_SQL[n]})" for n in names)


def _cents(c: str, scale: int = 2) -> str:
    return f"CAST(round({c} * {10 ** scale}) AS BIGINT)"


def pct(after: str, before: str) -> str:
    num = f"(({after}) - ({before})) * 100"
    den = f"NULLIF({before}, 0)"
    mag = f"((2 * abs({num}) * 10 + {den}) // (2 * {den}))"
    return f"CAST(CASE WHEN {num} < 0 THEN -{mag} ELSE {mag} END AS DOUBLE) / 10"


_PERIOD = ("CASE WHEN month_start_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' THEN 'before'"
           " WHEN month_start_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'after' END")
_PER = f"""per AS (
  SELECT period, SUM({_cents('avg_lines_changed_per_commit')}) AS slpc, SUM(total_commits) AS sc,
         SUM(unique_authors) AS sa, COUNT(*) AS n,
         CAST(SUM(total_lines_added) AS BIGINT) AS lines_added,
         CAST(SUM(total_lines_deleted) AS BIGINT) AS lines_deleted
  FROM (SELECT {_PERIOD} AS period, * FROM v3) WHERE period IS NOT NULL GROUP BY period)"""

LINES = "(CAST(c.lines_added AS BIGINT) + CAST(c.lines_deleted AS BIGINT))"
TREND_WINDOWS = [("3m", 3), ("6m", 6), ("12m", 12), ("24m", 24), ("all", None)]


def _trend_cards() -> str:
    parts = []
    for label, months in TREND_WINDOWS:
        cond = ("TRUE" if months is None else
                f"month_start_date >= date_trunc('month', DATE '{AS_OF}') - INTERVAL {months - 1} MONTH")
        parts.append(f"""SELECT '{label}' AS trend_window, COUNT(*) FILTER (WHERE {cond}) AS months,
    SUM(total_commits) FILTER (WHERE {cond}) AS c, SUM(total_lines_changed) FILTER (WHERE {cond}) AS l,
    SUM(unique_authors) FILTER (WHERE {cond}) AS a FROM q17""")
    return "\nUNION ALL\n".join(parts)


Q17 = f"""q17 AS (
  SELECT CAST(date_trunc('month', c.commit_date) AS DATE) AS month_start_date,
         strftime(c.commit_date, '%Y-%m') AS year_month,
         COUNT(*) AS total_commits, COUNT(DISTINCT c.author_email) AS unique_authors,
         COUNT(DISTINCT c.repository_id) AS active_repositories,
         CAST(SUM({LINES}) AS BIGINT) AS total_lines_changed,
         CAST(SUM({LINES} * c.weight) AS DOUBLE) / 100 AS weighted_lines_changed,
         CAST(SUM(CAST(c.weight AS BIGINT)) AS DOUBLE) / 100 AS effective_commits
  FROM commits c WHERE c.weight > 0
  GROUP BY date_trunc('month', c.commit_date), strftime(c.commit_date, '%Y-%m'))"""

CANDIDATE_NOTE = "category candidate before validation"

SQL = {
    "q1_repository_monthly_trend": with_commits(
        f"""SELECT year_month, total_commits, total_lines_changed, unique_authors,
  avg_lines_changed_per_commit, avg_commits_per_author FROM v3 WHERE repository_name = '{REPO}'""", _v("v3")),
    "q2_top_contributors": with_commits(
        """SELECT author_name, author_email, total_commits, repositories_contributed, total_lines_changed,
  avg_lines_changed_per_commit FROM v4 ORDER BY total_commits DESC, author_email, author_name LIMIT 10""",
        _v("v4")),
    "q3_daily_activity": with_commits(
        f"""SELECT commit_date, repository_name, total_commits, total_lines_changed, unique_authors
FROM v1 WHERE commit_date >= DATE '{AS_OF}' - INTERVAL 30 DAY""", _v("v1")),
    "q4_compare_repositories": with_commits(
        f"""SELECT repository_name, CAST(SUM(total_commits) AS BIGINT) AS commits,
  CAST(SUM(total_lines_changed) AS BIGINT) AS lines_changed, COUNT(DISTINCT year_month) AS months_active,
  {r('SUM(unique_authors)', 'COUNT(*)', 4)} AS avg_authors_per_month,
  {r('SUM(total_lines_changed)', 'SUM(total_commits)', 2)} AS avg_lines_per_commit
FROM v3 WHERE month_start_date >= DATE '1998-01-01' GROUP BY repository_name""", _v("v3")),
    "q5_before_after": with_commits(
        f"""SELECT period, {r('slpc', 'n * 100', 4)} AS avg_lines_per_commit,
  {r('sc', 'n', 4)} AS avg_commits_per_month, {r('sa', 'n', 4)} AS avg_authors FROM per""",
        _v("v3") + "," + _PER),
    "q6_before_after_change": with_commits(
        f"""SELECT {pct('lpc_a', 'lpc_b')} AS lines_per_commit_change_pct,
  {pct('c_a', 'c_b')} AS commits_change_pct, {pct('a_a', 'a_b')} AS authors_change_pct,
  la_b AS lines_added_before, la_a AS lines_added_after, ld_b AS lines_deleted_before, ld_a AS lines_deleted_after
FROM (SELECT
  MAX(CASE WHEN period = 'before' THEN (slpc * 10000) // n END) AS lpc_b,
  MAX(CASE WHEN period = 'after' THEN (slpc * 10000) // n END) AS lpc_a,
  MAX(CASE WHEN period = 'before' THEN (sc * 1000000) // n END) AS c_b,
  MAX(CASE WHEN period = 'after' THEN (sc * 1000000) // n END) AS c_a,
  MAX(CASE WHEN period = 'before' THEN (sa * 1000000) // n END) AS a_b,
  MAX(CASE WHEN period = 'after' THEN (sa * 1000000) // n END) AS a_a,
  MAX(CASE WHEN period = 'before' THEN lines_added END) AS la_b,
  MAX(CASE WHEN period = 'after' THEN lines_added END) AS la_a,
  MAX(CASE WHEN period = 'before' THEN lines_deleted END) AS ld_b,
  MAX(CASE WHEN period = 'after' THEN lines_deleted END) AS ld_a
  FROM per)""", _v("v3") + "," + _PER),
    "q7_weight_efficiency_over_time": with_commits(
        """SELECT repository_name, year_month, total_commits, effective_commits, avg_weight,
  weight_efficiency_pct, total_lines_changed, weighted_lines_changed FROM v3
WHERE month_start_date >= DATE '1995-01-01'""", _v("v3")),
    "q8_discounted_repositories": with_commits(
        f"""SELECT repository_name, CAST(SUM(total_commits) AS BIGINT) AS total_commits,
  CAST(SUM({_cents('effective_commits')}) AS DOUBLE) / 100 AS effective_commits,
  {r(f"SUM({_cents('weight_efficiency_pct', 1)})", 'COUNT(*) * 10', 1)} AS avg_efficiency_pct,
  CAST(SUM(total_commits) * 100 - SUM({_cents('effective_commits')}) AS DOUBLE) / 100 AS discounted_commits
FROM v3 GROUP BY repository_name
HAVING SUM({_cents('weight_efficiency_pct', 1)}) < COUNT(*) * 1000""", _v("v3")),
    "p8_personal_commits": with_commits(
        f"""SELECT commit_date, repository_name, hash, subject, lines_changed, weight, category, ai_tools
FROM p2 WHERE author_email = '{AUTHOR}' ORDER BY commit_date DESC, hash LIMIT 50""", _v("p2")),
    "q9a_personal_monthly": with_commits(
        f"""SELECT year_month, repository_name, author_name, total_commits, total_lines_changed, effective_commits,
  avg_weight, weight_efficiency_pct FROM v12 WHERE author_email = '{AUTHOR}'""", _v("v12")),
    "q9b_personal_daily": with_commits(
        f"""SELECT commit_date, repository_name, author_name, total_commits, total_lines_changed,
  weighted_lines_changed FROM v10
WHERE author_email = '{AUTHOR}' AND commit_date >= DATE '{AS_OF}' - INTERVAL 90 DAY""", _v("v10")),
    "q9c_personal_categories": with_commits(
        f"""SELECT author_name, category, total_commits, effective_commits, weighted_lines_changed,
  weight_efficiency_pct, repositories_count FROM v13 WHERE author_email = '{AUTHOR}'""", _v("v13")),
    "q9d_personal_category_trend": with_commits(
        f"""SELECT year_month, repository_name, author_name, category, total_commits, weighted_lines_changed,
  avg_lines_per_commit FROM v15 WHERE author_email = '{AUTHOR}'
ORDER BY month_start_date DESC, total_commits DESC, repository_name, author_name, category LIMIT 20""",
        _v("v15")),
    "q10_ai_coverage": with_commits(
        f"""SELECT COUNT(*) FILTER (WHERE category IS NOT NULL) AS categorized,
  COUNT(*) FILTER (WHERE ai_confidence IS NOT NULL) AS ai_categorized,
  {r('SUM(CAST(ai_confidence AS BIGINT))', 'COUNT(ai_confidence)', 1)} AS avg_confidence FROM commits"""),
    "q11_category_coverage": with_commits(
        f"""SELECT COUNT(*) AS total_commits, COUNT(category) AS categorized,
  {r('COUNT(category) * 100', 'COUNT(*)', 1)} AS category_pct FROM commits"""),
    "q12_revert_rate": with_commits(
        f"""SELECT COUNT(CASE WHEN weight = 0 THEN 1 END) AS reverted, COUNT(*) AS total,
  {r('COUNT(CASE WHEN weight = 0 THEN 1 END) * 100', 'COUNT(*)', 1)} AS revert_pct FROM commits"""),
    "q13_with_vs_without_tools": with_commits(
        f"""SELECT CASE WHEN c.ai_tools IS NOT NULL THEN 'With AI Tools' ELSE 'Without AI Tools' END AS tool_usage,
  COUNT(*) AS commits, {r(f'SUM({LINES})', 'COUNT(*)', 1)} AS avg_lines_per_commit,
  CAST((2 * SUM({LINES} * c.weight) + 100) // 200 AS BIGINT) AS total_weighted_lines
FROM commits c GROUP BY 1"""),
    "q14_monthly_ai_adoption": with_commits(
        f"""SELECT strftime(commit_date, '%Y-%m') AS month, COUNT(*) FILTER (WHERE ai_tools IS NOT NULL) AS with_ai,
  COUNT(*) AS total, {r('COUNT(*) FILTER (WHERE ai_tools IS NOT NULL) * 100', 'COUNT(*)', 1)} AS ai_usage_pct
FROM commits GROUP BY 1"""),
    "q15_weighted_vs_raw_lines": with_commits(
        f"""SELECT repository_name, year_month, total_lines_changed, weighted_lines_changed FROM v3
WHERE repository_name = '{REPO}'""", _v("v3")),
    "q16_repository_overview": with_commits(
        """SELECT r.id, r.name, r.description, COALESCE(g.n, 0) AS total_commits, g.latest AS latest_commit_date,
  COALESCE(g.a, 0) AS contributors
FROM repositories r LEFT JOIN (
  SELECT repository_id, COUNT(*) AS n, MAX(commit_date) AS latest, COUNT(DISTINCT author_email) AS a
  FROM commits WHERE weight > 0 GROUP BY repository_id) g ON g.repository_id = r.id"""),
    "q17_global_monthly_trend": with_commits("SELECT * FROM q17", Q17),
    "q18_overview_totals": with_commits(
        """SELECT (SELECT COUNT(*) FROM repositories) AS repositories, COUNT(*) AS commits,
  COUNT(DISTINCT author_email) AS contributors, COUNT(DISTINCT repository_id) AS active_repositories
FROM commits WHERE weight > 0"""),
    "q19_trend_cards": with_commits(
        f"""SELECT trend_window, months, {r('c', 'months', 2)} AS avg_commits_per_month,
  {r('l', 'c', 2)} AS avg_lines_per_commit, {r('a', 'months', 2)} AS avg_contributors_per_month
FROM ({_trend_cards()})""", Q17),
    "q20_commits_per_committer": with_commits(
        f"""SELECT year_month, total_commits, unique_authors,
  {r('total_commits', 'unique_authors', 1)} AS commits_per_author FROM q17""", Q17),
    "q21_category_trend": with_commits(
        f"""SELECT CAST(date_trunc('month', c.commit_date) AS DATE) AS month_start_date,
  strftime(c.commit_date, '%Y-%m') AS year_month, c.category, COUNT(*) AS total_commits,
  COUNT(DISTINCT c.author_email) AS unique_authors,
  CAST(SUM({LINES} * c.weight) AS DOUBLE) / 100 AS weighted_lines_changed,
  CAST(SUM(CAST(c.weight AS BIGINT)) AS DOUBLE) / 100 AS effective_commits
FROM commits c
WHERE c.category IS NOT NULL AND c.weight > 0
  AND c.commit_date >= CAST(date_trunc('month', DATE '{AS_OF}') - INTERVAL 11 MONTH AS TIMESTAMP)
GROUP BY 1, 2, 3"""),
    "q21_category_trend_repo": with_commits(
        f"""SELECT month_start_date, year_month, category, total_commits, unique_authors, weighted_lines_changed,
  effective_commits FROM v9 WHERE repository_name = '{REPO}'
  AND month_start_date >= CAST(date_trunc('month', DATE '{AS_OF}') - INTERVAL 11 MONTH AS DATE)""", _v("v9")),
    "q22_category_list": with_commits("SELECT * FROM v7", _v("v7")),
    "q22_category_list_repo": with_commits(f"SELECT * FROM v8 WHERE repository_name = '{REPO}'", _v("v8")),
    "q23_category_share_monthly": with_commits(
        f"""SELECT month_start_date, year_month, category, total_commits,
  CAST(slw AS DOUBLE) / 100 AS weighted_lines_changed,
  {r('total_commits * 100', 'SUM(total_commits) OVER (PARTITION BY month_start_date)', 1)} AS commit_share_pct,
  {r('slw * 100', 'SUM(slw) OVER (PARTITION BY month_start_date)', 1)} AS weighted_lines_share_pct
FROM (SELECT CAST(date_trunc('month', c.commit_date) AS DATE) AS month_start_date,
        strftime(c.commit_date, '%Y-%m') AS year_month, c.category, COUNT(*) AS total_commits,
        SUM({LINES} * c.weight) AS slw
      FROM commits c WHERE c.category IS NOT NULL AND c.weight > 0 GROUP BY 1, 2, 3)"""),
    "q23_category_share_overall": with_commits(
        f"""SELECT category, total_commits, CAST(slw AS DOUBLE) / 100 AS weighted_lines_changed,
  {r('total_commits * 100', 'SUM(total_commits) OVER ()', 1)} AS commit_share_pct,
  {r('slw * 100', 'SUM(slw) OVER ()', 1)} AS weighted_lines_share_pct
FROM (SELECT c.category, COUNT(*) AS total_commits, SUM({LINES} * c.weight) AS slw
      FROM commits c WHERE c.category IS NOT NULL AND c.weight > 0 GROUP BY 1)"""),
    "q24_category_repository_matrix": with_commits(
        """SELECT c.category, r.name AS repository_name, COUNT(*) AS total_commits FROM commits c
        JOIN repositories r ON c.repository_id = r.id WHERE c.category IS NOT NULL AND c.weight > 0 GROUP BY 1, 2"""),
    "q25_activity_by_weekday_hour": with_commits(
        """SELECT CAST(isodow(commit_date) AS INTEGER) AS iso_weekday, CAST(hour(commit_date) AS INTEGER) AS hour_of_day,
  COUNT(*) AS total_commits FROM commits WHERE weight > 0 GROUP BY 1, 2"""),
    "q26_calendar_heatmap": with_commits(
        """SELECT CAST(d.day AS DATE) AS day, COALESCE(p.n, 0) AS total_commits
FROM (SELECT UNNEST(generate_series(MIN(CAST(commit_date AS DATE)), MAX(CAST(commit_date AS DATE)), INTERVAL 1 DAY)) AS day
      FROM commits WHERE weight > 0) d
LEFT JOIN (SELECT CAST(commit_date AS DATE) AS day, COUNT(*) AS n FROM commits WHERE weight > 0 GROUP BY 1) p
  ON p.day = CAST(d.day AS DATE)"""),
    "q27_newest_reverted": with_commits(
        "SELECT * FROM p3 ORDER BY commit_date DESC, repository_name, hash LIMIT 20", _v("p3")),
    "q27_newest_uncategorized": with_commits(
        "SELECT * FROM p4 ORDER BY commit_date DESC, repository_name, hash LIMIT 20", _v("p4")),
    "q28_category_vocabulary": with_commits(
        """SELECT c.repository_id, r.name AS repository_name, c.category, COUNT(*) AS usage_count
FROM commits c JOIN repositories r ON c.repository_id = r.id
WHERE c.category IS NOT NULL GROUP BY c.repository_id, r.name, c.category HAVING COUNT(*) > 1"""),
    "q29_category_usage_seed": with_commits(
        """SELECT category AS name, 'Extracted from existing commits' AS description, COUNT(*) AS usage_count
FROM commits WHERE category IS NOT NULL GROUP BY category"""),
    "w1_contributor_ranking": with_commits(
        """SELECT author_email, author_name, total_commits, total_lines_changed,
  ROW_NUMBER() OVER (ORDER BY total_commits DESC, author_email, author_name) AS rank FROM v4""", _v("v4")),
    "w1_contributor_podium": with_commits(
        """SELECT * FROM (SELECT author_email, author_name, total_commits, total_lines_changed,
  ROW_NUMBER() OVER (ORDER BY total_commits DESC, author_email, author_name) AS rank FROM v4) WHERE rank <= 3""",
        _v("v4")),
    "w2_month_over_month": with_commits(
        """SELECT repository_name, year_month, total_commits, prev AS previous_commits,
  CASE WHEN prev IS NULL THEN NULL WHEN total_commits > prev THEN 'up' WHEN total_commits < prev THEN 'down'
       ELSE 'flat' END AS direction
FROM (SELECT *, LAG(total_commits) OVER (PARTITION BY repository_id ORDER BY month_start_date) AS prev FROM v3)""",
        _v("v3")),
    "w3_repository_share": with_commits(
        f"""SELECT r.name AS repository_name, g.n AS total_commits,
  {r('g.n * 100', 'SUM(g.n) OVER ()', 1)} AS share_pct
FROM (SELECT repository_id, COUNT(*) AS n FROM commits WHERE weight > 0 GROUP BY repository_id) g
JOIN repositories r ON r.id = g.repository_id"""),
    "p12_recategorize": with_commits(
        """SELECT repository_id, hash, CASE WHEN category IS NULL AND (subject ILIKE '%hotfix%' OR subject ILIKE '% fix %')
  THEN 'HOTFIX' ELSE category END AS category FROM commits"""),
}
