"""DuckDB twins of the views (V1-V15, P1-P4), one SQL text per view.

``VIEW_SQL[name]`` is a SELECT over the CTE ``commits`` (alias ``c``) and
``repositories`` (alias ``r``); wrap it with ``oracle.with_commits``.
"""

from __future__ import annotations

from .oracle import h, r

A = "CAST(c.lines_added AS BIGINT)"
D = "CAST(c.lines_deleted AS BIGINT)"
F_ = "CAST(c.files_changed AS BIGINT)"
W = "CAST(c.weight AS BIGINT)"

# Metric SQL, team flavour (PostgreSQL SUM(int) is bigint, COUNT is bigint).
TEAM = {
    "total_commits": "COUNT(*)",
    "unique_authors": "COUNT(DISTINCT c.author_email)",
    "repositories": "COUNT(DISTINCT c.repository_id)",
    "repositories_contributed": "COUNT(DISTINCT c.repository_id)",
    "total_lines_added": f"CAST(SUM({A}) AS BIGINT)",
    "total_lines_deleted": f"CAST(SUM({D}) AS BIGINT)",
    "total_lines_changed": f"CAST(SUM({A} + {D}) AS BIGINT)",
    "total_files_changed": f"CAST(SUM({F_}) AS BIGINT)",
    "weighted_lines_added": h(f"SUM({A} * {W})"),
    "weighted_lines_deleted": h(f"SUM({D} * {W})"),
    "weighted_lines_changed": h(f"SUM(({A} + {D}) * {W})"),
    "weighted_files_changed": h(f"SUM({F_} * {W})"),
    "effective_commits": h(f"SUM({W})"),
    "avg_weight": r(f"SUM({W})", "COUNT(*)", 1),
    "weight_efficiency_pct": r(f"SUM({W})", "COUNT(*)", 1),
    "avg_lines_changed_per_commit": r(f"SUM({A} + {D})", "COUNT(*)", 2),
    "avg_lines_added_per_commit": r(f"SUM({A})", "COUNT(*)", 2),
    "avg_lines_deleted_per_commit": r(f"SUM({D})", "COUNT(*)", 2),
    "avg_files_changed_per_commit": r(f"SUM({F_})", "COUNT(*)", 2),
    "avg_lines_per_commit_1": r(f"SUM({A} + {D})", "COUNT(*)", 1),
    "avg_lines_per_commit_2": r(f"SUM({A} + {D})", "COUNT(*)", 2),
    "avg_lines_added_per_author": r(f"SUM({A})", "COUNT(DISTINCT c.author_email)", 2),
    "avg_lines_deleted_per_author": r(f"SUM({D})", "COUNT(DISTINCT c.author_email)", 2),
    "avg_lines_changed_per_author": r(f"SUM({A} + {D})", "COUNT(DISTINCT c.author_email)", 2),
    "avg_commits_per_author": r("COUNT(*)", "COUNT(DISTINCT c.author_email)", 2),
    "first_commit_date": "MIN(c.commit_date)",
    "last_commit_date": "MAX(c.commit_date)",
    "first_commit": "MIN(c.commit_date)",
    "latest_commit": "MAX(c.commit_date)",
    "first_usage": "MIN(c.commit_date)",
    "latest_usage": "MAX(c.commit_date)",
    "activity_days": "CAST((epoch_us(MAX(c.commit_date)) - epoch_us(MIN(c.commit_date))) // 86400000000 AS INTEGER)",
}
# Author flavour: the reference casts counts and file sums to int.
AUTHOR = dict(TEAM)
AUTHOR.update({
    "total_commits": "CAST(COUNT(*) AS INTEGER)",
    "total_files_changed": f"CAST(SUM({F_}) AS INTEGER)",
    "repositories_count": "CAST(COUNT(DISTINCT c.repository_id) AS INTEGER)",
})


def _m(flavor: dict, names: str) -> str:
    out = []
    for n in names.split():
        alias = n[:-2] if n.startswith("avg_lines_per_commit_") else n
        out.append(f"{flavor[n]} AS {alias}")
    return ",\n  ".join(out)


_TOT = "total_lines_added total_lines_deleted total_lines_changed"
_WGT = "weighted_lines_added weighted_lines_deleted weighted_lines_changed"
_EFF = "effective_commits avg_weight weight_efficiency_pct"
_AVG = "avg_lines_changed_per_commit avg_lines_added_per_commit avg_lines_deleted_per_commit"

REPO_DAILY = (f"total_commits unique_authors {_TOT} total_files_changed {_WGT} weighted_files_changed"
              f" {_EFF} {_AVG} avg_files_changed_per_commit")
REPO_WEEKLY = REPO_DAILY.replace(" avg_files_changed_per_commit", "")
REPO_MONTHLY = (REPO_DAILY + " avg_lines_added_per_author avg_lines_deleted_per_author"
                " avg_lines_changed_per_author avg_commits_per_author")
AUTHOR_DAILY = (f"total_commits {_EFF} {_TOT} {_WGT} total_files_changed weighted_files_changed"
                f" {_AVG} avg_files_changed_per_commit")
AUTHOR_WEEKLY = AUTHOR_DAILY.replace(" avg_files_changed_per_commit", "")

JOIN = "FROM commits c JOIN repositories r ON c.repository_id = r.id"
MONTH = ("CAST(date_trunc('month', c.commit_date) AS DATE) AS month_start_date,"
         " strftime(c.commit_date, '%Y-%m') AS year_month")
MONTH_G = "date_trunc('month', c.commit_date), strftime(c.commit_date, '%Y-%m')"
WEEK = ("CAST(date_trunc('week', c.commit_date) AS DATE) AS week_start_date,"
        " CAST(year(c.commit_date) AS INTEGER) AS year, CAST(weekofyear(c.commit_date) AS INTEGER) AS week_number")
WEEK_G = "date_trunc('week', c.commit_date), year(c.commit_date), weekofyear(c.commit_date)"
YM_NUM = "CAST(year(c.commit_date) AS INTEGER) AS year, CAST(month(c.commit_date) AS INTEGER) AS month"
YM_NUM_G = "year(c.commit_date), month(c.commit_date)"

VIEW_SQL = {
    "p1": f"""SELECT c.id, c.hash, c.commit_date, c.author_name, c.author_email, c.subject,
  c.lines_added, c.lines_deleted, c.files_changed, c.lines_added + c.lines_deleted AS lines_changed,
  c.weight, c.ai_tools, c.category, r.id AS repository_id, r.name AS repository_name, r.url AS repository_url
{JOIN}""",
    "p2": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name,
  r.url AS repository_url, c.id AS commit_id, c.hash, c.commit_date, c.subject,
  CAST(c.lines_added AS INTEGER) AS lines_added, CAST(c.lines_deleted AS INTEGER) AS lines_deleted,
  CAST(c.lines_added + c.lines_deleted AS INTEGER) AS lines_changed,
  CAST(c.files_changed AS INTEGER) AS files_changed, CAST(c.weight AS INTEGER) AS weight,
  COALESCE(c.category, 'UNCATEGORIZED') AS category, CAST(c.ai_confidence AS SMALLINT) AS ai_confidence,
  c.ai_tools, c.created_at
{JOIN}""",
    "p3": f"""SELECT r.name AS repository_name, c.hash, c.commit_date, c.author_name, c.subject,
  c.lines_added, c.lines_deleted, c.weight
{JOIN} WHERE c.weight = 0""",
    "p4": f"""SELECT r.name AS repository_name, c.hash, c.commit_date, c.author_name, c.subject,
  c.category IS NULL AS missing_category
{JOIN} WHERE c.category IS NULL""",
    "v1": f"""SELECT r.id AS repository_id, r.name AS repository_name, CAST(c.commit_date AS DATE) AS commit_date,
  {_m(TEAM, REPO_DAILY)}
{JOIN} WHERE c.weight > 0
GROUP BY r.id, r.name, CAST(c.commit_date AS DATE)""",
    "v2": f"""SELECT r.id AS repository_id, r.name AS repository_name, {WEEK},
  {_m(TEAM, REPO_WEEKLY)}
{JOIN} WHERE c.weight > 0
GROUP BY r.id, r.name, {WEEK_G}""",
    "v3": f"""SELECT r.id AS repository_id, r.name AS repository_name, {MONTH}, {YM_NUM},
  {_m(TEAM, REPO_MONTHLY)}
{JOIN} WHERE c.weight > 0
GROUP BY r.id, r.name, {MONTH_G}, {YM_NUM_G}""",
    "v4": f"""SELECT c.author_email, c.author_name,
  {_m(TEAM, "repositories_contributed total_commits " + _TOT + " total_files_changed " + _WGT + " " + _EFF
          + " " + _AVG + " first_commit_date last_commit_date activity_days")}
FROM commits c WHERE c.weight > 0
GROUP BY c.author_email, c.author_name""",
    "v5": f"""SELECT c.ai_tools,
  {_m(TEAM, "total_commits unique_authors repositories " + _TOT + " weighted_lines_changed " + _EFF
          + " avg_lines_per_commit_2 first_usage latest_usage")}
FROM commits c WHERE c.ai_tools IS NOT NULL AND c.weight > 0
GROUP BY c.ai_tools""",
    "v6": f"""SELECT r.name AS repository_name, c.ai_tools,
  {_m(TEAM, "total_commits unique_authors total_lines_changed weighted_lines_changed " + _EFF
          + " avg_lines_per_commit_2")}
{JOIN} WHERE c.ai_tools IS NOT NULL AND c.weight > 0
GROUP BY r.name, c.ai_tools""",
    "v7": f"""SELECT c.category,
  {_m(TEAM, "total_commits unique_authors repositories " + _TOT + " " + _WGT + " " + _EFF
          + " avg_lines_per_commit_1 first_commit latest_commit")}
FROM commits c WHERE c.category IS NOT NULL AND c.weight > 0
GROUP BY c.category""",
    "v8": f"""SELECT r.id AS repository_id, r.name AS repository_name, c.category,
  {_m(TEAM, "total_commits unique_authors " + _TOT + " " + _WGT + " " + _EFF + " avg_lines_per_commit_1")}
{JOIN} WHERE c.category IS NOT NULL AND c.weight > 0
GROUP BY r.id, r.name, c.category""",
    "v9": f"""SELECT r.id AS repository_id, r.name AS repository_name, {MONTH}, c.category,
  {_m(TEAM, "total_commits unique_authors " + _TOT + " " + _WGT + " " + _EFF + " avg_lines_per_commit_1")}
{JOIN} WHERE c.category IS NOT NULL AND c.weight > 0
GROUP BY r.id, r.name, {MONTH_G}, c.category""",
    "v10": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name,
  CAST(c.commit_date AS DATE) AS commit_date,
  {_m(AUTHOR, AUTHOR_DAILY)}
{JOIN} WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, r.id, r.name, CAST(c.commit_date AS DATE)""",
    "v11": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name, {WEEK},
  {_m(AUTHOR, AUTHOR_WEEKLY)}
{JOIN} WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, r.id, r.name, {WEEK_G}""",
    "v12": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name,
  {MONTH}, {YM_NUM},
  {_m(AUTHOR, AUTHOR_DAILY)}
{JOIN} WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, r.id, r.name, {MONTH_G}, {YM_NUM_G}""",
    "v13": f"""SELECT c.author_email, c.author_name, COALESCE(c.category, 'UNCATEGORIZED') AS category,
  {_m(AUTHOR, "total_commits " + _EFF + " " + _TOT + " " + _WGT
          + " repositories_count first_commit_date last_commit_date avg_lines_per_commit_1")}
FROM commits c WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, c.category""",
    "v14": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name,
  COALESCE(c.category, 'UNCATEGORIZED') AS category,
  {_m(AUTHOR, "total_commits " + _EFF + " " + _TOT + " " + _WGT + " avg_lines_per_commit_1")}
{JOIN} WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, r.id, r.name, c.category""",
    "v15": f"""SELECT c.author_email, c.author_name, r.id AS repository_id, r.name AS repository_name,
  {MONTH}, COALESCE(c.category, 'UNCATEGORIZED') AS category,
  {_m(AUTHOR, "total_commits " + _EFF + " " + _TOT + " " + _WGT + " avg_lines_per_commit_1")}
{JOIN} WHERE c.weight > 0
GROUP BY c.author_email, c.author_name, r.id, r.name, {MONTH_G}, c.category""",
}
