"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code, directly from the reference's SQL
views, in plain SQL over the driver's pre-registered tables.  The adapter, the
text rules and revert weighting are repeated as CTEs; revert matching here is
the literal rule (``contains`` over every commit of the repository), not the
token join the engine uses, so the two implementations check each other.

Rounding: ratios are written in integer half-up form and cast to DOUBLE, the
same exact values the engine produces.
"""

from __future__ import annotations

WS = r"[\t\n\x0B\f\r ]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\t\n\x0B\f\r \x00]+|[\t\n\x0B\f\r \x00]+$', '', 'g')"


def r(num: str, den: str, scale: int) -> str:
    """round(num/den, scale) half-up for non-negative operands, as DOUBLE."""
    p = 10 ** scale
    d = f"NULLIF({den}, 0)"
    return f"CAST((2 * ({num}) * {p} + {d}) // (2 * {d}) AS DOUBLE) / {p}"


def h(total: str) -> str:
    """SUM(x * w / 100.0) as DOUBLE."""
    return f"CAST({total} AS DOUBLE) / 100"


def valid(c: str) -> str:
    return (f"({c} IS NOT NULL AND length({c}) BETWEEN 2 AND 50"
            rf" AND NOT regexp_matches({c}, '(?m)^[0-9]+$')"
            rf" AND NOT regexp_matches({c}, '(?m)^[0-9]+\.[0-9]+')"
            rf" AND NOT regexp_matches({c}, '(?m)^#')"
            f" AND 2 * (length({c}) - length(regexp_replace({c}, '[0-9]', '', 'g'))) <= length({c})"
            f" AND regexp_matches({c}, '[A-Za-z]'))")


def candidate_sql(s: str) -> str:
    before = f"upper({strip(f'split_part({s}, {chr(39)} | {chr(39)}, 1)')})"
    bracket = r"'(?m)^\[([^\]]+)\]'"
    first = f"regexp_split_to_array({s}, '{WS}+')[1]"
    return (f"(CASE WHEN {s} IS NULL OR {strip(s)} = '' THEN NULL"
            f" WHEN contains({s}, ' | ') AND {before} <> '' THEN {before}"
            f" WHEN regexp_matches({s}, {bracket}) THEN upper({strip(f'regexp_extract({s}, {bracket}, 1)')})"
            f" WHEN {first} = upper({first}) AND length({first}) >= 2"
            f" AND {first} NOT IN ('MERGE', 'FIX', 'ADD', 'UPDATE', 'REMOVE', 'DELETE') THEN {first} END)")


def category_sql(s: str) -> str:
    cand = candidate_sql(s)
    return f"(CASE WHEN {valid(cand)} THEN {cand} END)"


def reason_sql(c: str) -> str:
    digits = f"(length({c}) - length(regexp_replace({c}, '[0-9]', '', 'g')))"
    return (f"(CASE WHEN {c} IS NULL OR length({c}) = 0 THEN 'nil or empty'"
            f" WHEN length({c}) > 50 THEN 'too long (>50 chars)'"
            f" WHEN length({c}) < 2 THEN 'too short (<2 chars)'"
            rf" WHEN regexp_matches({c}, '(?m)^[0-9]+$') THEN 'purely numeric'"
            rf" WHEN regexp_matches({c}, '(?m)^[0-9]+\.[0-9]+') THEN 'looks like version number'"
            rf" WHEN regexp_matches({c}, '(?m)^#[0-9]+$') THEN 'looks like issue number'"
            rf" WHEN regexp_matches({c}, '(?m)^#') THEN 'starts with # symbol'"
            f" WHEN 2 * {digits} > length({c}) THEN 'too many digits (>50%)'"
            f" WHEN NOT regexp_matches({c}, '[A-Za-z]') THEN 'contains no letters'"
            " ELSE 'valid' END)")


def tools_sql(b: str) -> str:
    marker = rf"'(?i)\*{{0,2}}{WS}*AI{WS}+tools?{WS}*:{WS}*([^\n*]+)'"
    listed = strip(f"regexp_extract({b}, {marker}, 1)")
    parts = (f"list_filter(list_transform(regexp_split_to_array({listed}, '{WS}+(?:and|&){WS}+|,{WS}*'),"
             f" lambda x: {strip('x')}), lambda x: x <> '')")
    norm = (f"list_transform({parts}, lambda t: CASE"
            " WHEN regexp_matches(upper(t), 'CLAUDE.*CODE') THEN 'CLAUDE CODE'"
            " WHEN regexp_matches(upper(t), 'COPILOT') THEN 'GITHUB COPILOT'"
            " WHEN regexp_matches(upper(t), 'CURSOR') THEN 'CURSOR'"
            " WHEN regexp_matches(upper(t), 'CLAUDE') THEN 'CLAUDE'"
            " ELSE upper(t) END)")
    dedup = f"list_filter({norm}, lambda x, i: list_position({norm}, x) = i)"
    return (f"(CASE WHEN {b} IS NOT NULL AND {strip(b)} <> '' AND len({dedup}) > 0"
            f" THEN array_to_string({dedup}, ', ') END)")


REVERT = r"(regexp_matches({s}, '(?i)\brevert\b') AND NOT regexp_matches({s}, '(?i)\bunrevert\b'))"


def is_revert(s: str) -> str:
    return REVERT.format(s=s)


_SUBJECT = """CASE o.o_orderkey % 10
      WHEN 0 THEN c.c_mktsegment || ' | update order (!' || CAST(o.o_orderkey AS VARCHAR) || ')'
      WHEN 1 THEN '[' || c.c_mktsegment || '] update (#' || CAST(o.o_orderkey AS VARCHAR) || ')'
      WHEN 2 THEN c.c_mktsegment || ' rework'
      WHEN 3 THEN 'Fix rounding (#' || CAST(o.o_orderkey AS VARCHAR) || ')'
      WHEN 4 THEN 'Revert "' || c.c_mktsegment || ' | update order (!' || CAST(o.o_orderkey - 4 AS VARCHAR)
                  || ')" (!' || CAST(o.o_orderkey AS VARCHAR) || ')'
      WHEN 5 THEN 'Unrevert !' || CAST(o.o_orderkey - 5 AS VARCHAR) || ' and fix (!' || CAST(o.o_orderkey AS VARCHAR) || ')'
      WHEN 6 THEN '2.58.0 release'
      WHEN 7 THEN '#' || CAST(o.o_orderkey AS VARCHAR) || ' hotfix'
      WHEN 8 THEN 'MERGE branch'
      ELSE 'I18N labels' END"""

_BODY = """CASE o.o_orderpriority
      WHEN '1-URGENT' THEN '**AI tool: Claude Code and Copilot**'
      WHEN '2-HIGH' THEN 'AI tools: Cursor, GitHub Copilot'
      WHEN '4-NOT SPECIFIED' THEN 'ai tool: windsurf & Cursor'
      WHEN '5-LOW' THEN 'no marker' END"""

MESSAGES_CTE = f"""
repositories AS (
  SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name, '/repos/' || n_name AS url,
         CAST(NULL AS VARCHAR) AS description
  FROM nation),
li AS (
  SELECT l_orderkey,
         SUM(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS added,
         SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS deleted,
         COUNT(*) AS files
  FROM lineitem GROUP BY l_orderkey),
messages AS (
  SELECT o.o_orderkey AS id,
         CAST(FLOOR(o.o_orderkey / 100) AS BIGINT) % 25 AS repository_id_big,
         md5(CAST(o.o_orderkey AS VARCHAR)) AS hash,
         CAST(o.o_orderdate AS TIMESTAMP) AS commit_date,
         'Author ' || CAST(o.o_custkey % 40 AS VARCHAR)
           || CASE WHEN o.o_custkey % 200 >= 160 THEN ' Jr' ELSE '' END AS author_name,
         'author' || CAST(o.o_custkey % 40 AS VARCHAR) || '@example.com' AS author_email,
         {_SUBJECT} AS subject,
         {_BODY} AS body,
         CAST(COALESCE(li.added, 0) AS INTEGER) AS lines_added,
         CAST(COALESCE(li.deleted, 0) AS INTEGER) AS lines_deleted,
         CAST(COALESCE(li.files, 0) AS INTEGER) AS files_changed,
         CAST(o.o_orderdate AS TIMESTAMP) AS created_at,
         CASE WHEN o.o_orderstatus = 'P' THEN CAST(40 + o.o_orderkey % 61 AS INTEGER) ELSE 100 END AS weight,
         CASE WHEN o.o_orderstatus = 'P' THEN CAST(50 + o.o_orderkey % 51 AS SMALLINT) END AS ai_confidence,
         CAST(NULL AS VARCHAR) AS description,
         CASE WHEN o.o_orderstatus = 'P' THEN CAST(40 + o.o_orderkey % 61 AS INTEGER) END AS business_impact
  FROM orders o
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON c.c_custkey = o.o_custkey),
loaded AS (
  SELECT id, CAST(repository_id_big AS INTEGER) AS repository_id, hash, commit_date, author_name,
         author_email, subject, lines_added, lines_deleted, files_changed, created_at,
         {category_sql('subject')} AS category,
         weight,
         {tools_sql('body')} AS ai_tools,
         ai_confidence, description, business_impact
  FROM messages)"""

WEIGHTING_CTE = rf"""
needles AS (
  SELECT DISTINCT repository_id, revert_hash, token FROM (
    SELECT repository_id, hash AS revert_hash,
           UNNEST(regexp_extract_all(subject, '\(([!#][0-9]+)\)', 1)) AS token
    FROM loaded WHERE {is_revert('subject')})),
pairs AS (
  SELECT n.repository_id, n.revert_hash, n.token, o.hash AS original_hash
  FROM needles n JOIN loaded o
    ON o.repository_id = n.repository_id AND o.hash <> n.revert_hash AND contains(o.subject, n.token)),
zeroed AS (
  SELECT repository_id, revert_hash AS hash FROM pairs
  UNION SELECT repository_id, original_hash AS hash FROM pairs),
commits AS (
  SELECT l.id, l.repository_id, l.hash, l.commit_date, l.author_name, l.author_email, l.subject,
         l.lines_added, l.lines_deleted, l.files_changed, l.created_at, l.category,
         CASE WHEN z.hash IS NOT NULL THEN 0 ELSE l.weight END AS weight,
         l.ai_tools, l.ai_confidence, l.description, l.business_impact
  FROM loaded l LEFT JOIN zeroed z ON z.repository_id = l.repository_id AND z.hash = l.hash)"""


def with_commits(body: str, extra_ctes: str = "") -> str:
    """``WITH`` adapter + weighting (+ extra CTEs) followed by ``body``.

    ``body`` may use ``repositories``, ``loaded`` (before weighting),
    ``pairs``, ``zeroed`` and ``commits`` (after weighting).
    """
    ctes = MESSAGES_CTE + "," + WEIGHTING_CTE
    if extra_ctes:
        ctes += "," + extra_ctes
    return f"WITH {ctes}\n{body}"


def with_loaded(body: str, extra_ctes: str = "") -> str:
    """``WITH`` adapter only (no weighting): ``messages``, ``loaded``, ``repositories``."""
    ctes = MESSAGES_CTE
    if extra_ctes:
        ctes += "," + extra_ctes
    return f"WITH {ctes}\n{body}"
