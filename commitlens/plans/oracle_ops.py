"""DuckDB twins of the operator scenarios (``plans.scenarios``)."""

from __future__ import annotations

from . import scenarios as SC
from .oracle import (WS, candidate_sql, category_sql, is_revert, reason_sql, strip, tools_sql, valid,
                     with_commits, with_loaded)
from .oracle_views import TEAM, _m
from ..operators import enrich as _EN


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CAND = "cand"

TOOL_MARKER = rf"'(?i)\*{{0,2}}{WS}*AI{WS}+tools?{WS}*:{WS}*([^\n*]+)'"
TOOL_SPLIT = f"'{WS}+(?:and|&){WS}+|,{WS}*'"
GIT_DATE = r"'^([0-9]{4}-[0-9]{2}-[0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) ([+-][0-9]{2})([0-9]{2})$'"

TABLE_UNTIL = f"TIMESTAMP '{SC.TABLE_UNTIL} 00:00:00'"
EXPORT_FROM = f"TIMESTAMP '{SC.EXPORT_FROM} 00:00:00'"

# Export rows of the incremental-load scenario, both versions, with _pos.
VERSIONS = f"""
exported AS (SELECT *, commit_date < {TABLE_UNTIL} AS again FROM loaded WHERE commit_date >= {EXPORT_FROM}),
versions AS (
  SELECT repository_id, hash, commit_date, author_name, author_email,
         CASE WHEN again THEN subject || ' v2' ELSE subject END AS subject,
         CASE WHEN again THEN 999999 ELSE lines_added END AS lines_added, lines_deleted, files_changed,
         CASE WHEN again THEN NULL ELSE category END AS category,
         CASE WHEN again THEN 70 ELSE weight END AS weight,
         CASE WHEN again THEN NULL ELSE ai_tools END AS ai_tools,
         CASE WHEN again THEN CAST(77 AS SMALLINT) ELSE ai_confidence END AS ai_confidence,
         CASE WHEN again THEN 're-extracted' ELSE description END AS description,
         CASE WHEN again THEN 70 ELSE business_impact END AS business_impact, 1 AS _pos
  FROM exported
  UNION ALL
  SELECT repository_id, hash, commit_date, author_name, author_email, subject, lines_added, lines_deleted,
         files_changed, category, weight, ai_tools, ai_confidence, description, business_impact, 0 AS _pos
  FROM exported WHERE again),
latest AS (
  SELECT * EXCLUDE (_pos, rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY repository_id, hash ORDER BY _pos DESC) AS rn FROM versions)
  WHERE rn = 1),
target AS (SELECT * FROM loaded WHERE commit_date < {TABLE_UNTIL}),
merged AS (
  SELECT CASE WHEN t.hash IS NOT NULL THEN t.id
              ELSE (SELECT MAX(id) FROM target)
                   + ROW_NUMBER() OVER (PARTITION BY t.hash IS NULL ORDER BY s.repository_id, s.hash) END AS id,
         COALESCE(t.repository_id, s.repository_id) AS repository_id, COALESCE(t.hash, s.hash) AS hash,
         CASE WHEN t.hash IS NOT NULL THEN t.commit_date ELSE s.commit_date END AS commit_date,
         CASE WHEN t.hash IS NOT NULL THEN t.author_name ELSE s.author_name END AS author_name,
         CASE WHEN t.hash IS NOT NULL THEN t.author_email ELSE s.author_email END AS author_email,
         CASE WHEN s.hash IS NOT NULL THEN s.subject ELSE t.subject END AS subject,
         CASE WHEN t.hash IS NOT NULL THEN t.lines_added ELSE s.lines_added END AS lines_added,
         CASE WHEN t.hash IS NOT NULL THEN t.lines_deleted ELSE s.lines_deleted END AS lines_deleted,
         CASE WHEN t.hash IS NOT NULL THEN t.files_changed ELSE s.files_changed END AS files_changed,
         t.created_at AS created_at,
         CASE WHEN s.hash IS NOT NULL THEN s.category ELSE t.category END AS category,
         CASE WHEN s.hash IS NOT NULL THEN s.weight ELSE t.weight END AS weight,
         CASE WHEN s.hash IS NOT NULL THEN s.ai_tools ELSE t.ai_tools END AS ai_tools,
         CASE WHEN s.hash IS NOT NULL THEN s.ai_confidence ELSE t.ai_confidence END AS ai_confidence,
         CASE WHEN s.hash IS NOT NULL THEN s.description ELSE t.description END AS description,
         CASE WHEN s.hash IS NOT NULL THEN s.business_impact ELSE t.business_impact END AS business_impact,
         CASE WHEN t.hash IS NOT NULL AND s.hash IS NOT NULL THEN 'updated'
              WHEN s.hash IS NOT NULL THEN 'inserted' ELSE 'kept' END AS load_action
  FROM target t FULL OUTER JOIN latest s ON t.repository_id = s.repository_id AND t.hash = s.hash)"""


def _response(alias: str = "") -> str:
    p = alias
    k = f"{p}id"
    cat = (f"CASE {k} % 5 WHEN 0 THEN 'billing' WHEN 1 THEN 'Api Gateway' WHEN 2 THEN '2.58.0'"
           f" WHEN 3 THEN '#123' ELSE 'INFRA' END")
    return (f"(CASE WHEN {k} % 7 = 0 THEN 'NOTE: none' || chr(10) ELSE 'CATEGORY: ' || {cat} || chr(10) END"
            f" || CASE WHEN {k} % 11 = 0 THEN '' ELSE"
            f" CASE WHEN {k} % 17 = 0 THEN 'confidence: ' ELSE 'CONFIDENCE: ' END"
            f" || CAST({k} % 150 AS VARCHAR) || chr(10) END"
            f" || CASE WHEN {k} % 13 = 0 THEN '' ELSE 'business_impact: ' || CAST({k} % 120 AS VARCHAR) || chr(10) END"
            f" || 'REASON: matches ' || {p}subject || chr(10)"
            f" || 'DESCRIPTION: Touches ' || CAST({p}files_changed AS VARCHAR) || ' files.' || chr(10)"
            " || 'Second line.')")


RE_CATEGORY = rf"'(?im)CATEGORY:{WS}*([A-Z0-9#][A-Z0-9._\t\n\x0B\f\r #-]*?)(?:\n|$)'"
RE_CONFIDENCE = f"'CONFIDENCE:{WS}*([0-9]+)'"
RE_IMPACT = f"'(?i)BUSINESS_IMPACT:{WS}*([0-9]+)'"
RE_REASON = f"'(?ims)REASON:{WS}*(.+?)(?:\\n|DESCRIPTION:|$)'"
RE_DESCRIPTION = f"'(?ims)DESCRIPTION:{WS}*(.+?)(?:\\n\\n|$)'"


def _score(digits: str, default: int) -> str:
    d = f"regexp_replace({digits}, '^0+([0-9])', '\\1')"
    return (f"(CASE WHEN {digits} = '' THEN {default} WHEN length({d}) > 9 THEN 100"
            f" ELSE least(greatest(TRY_CAST({d} AS INTEGER), 0), 100) END)")


PARSED = f"""
answers AS (SELECT repository_id, hash, {_response()} AS r FROM loaded WHERE files_changed > 0),
cats AS (SELECT *, upper({strip(f"regexp_extract(r, {RE_CATEGORY}, 1)")}) AS cat,
                regexp_matches(r, {RE_CATEGORY}) AS found FROM answers),
errs AS (SELECT *, CASE WHEN r IS NULL OR NOT found THEN 'Could not extract category from LLM response'
                        WHEN NOT {valid('cat')} THEN 'Invalid category generated by LLM: ''' || cat || ''' (failed validation)'
                   END AS error FROM cats),
parsed AS (
  SELECT repository_id, hash,
         CASE WHEN error IS NULL THEN cat END AS category,
         CASE WHEN error IS NULL THEN {_score(f"regexp_extract(r, {RE_CONFIDENCE}, 1)", 50)} END AS confidence,
         CASE WHEN error IS NULL THEN {_score(f"regexp_extract(r, {RE_IMPACT}, 1)", 100)} END AS business_impact,
         CASE WHEN error IS NULL THEN
              CASE WHEN regexp_matches(r, {RE_REASON}) THEN {strip(f"regexp_extract(r, {RE_REASON}, 1)")}
                   ELSE 'No reason provided' END END AS reason,
         CASE WHEN error IS NULL AND regexp_matches(r, {RE_DESCRIPTION})
              THEN {strip(f"regexp_extract(r, {RE_DESCRIPTION}, 1)")} END AS description,
         error
  FROM errs)"""

ORIG_REFS = "regexp_extract_all(o.subject, '([!#][0-9]+)', 1)"

NL = "chr(10)"
PROMPT = (f"{_lit(_EN.PROMPT_INTRO)} || {NL} || {NL} || 'COMMIT DETAILS:' || {NL} || '- Subject: \"' || c.subject"
          f" || '\"' || {NL} || '- Hash: ' || c.hash || {NL} || {NL} || {_lit(_EN.FILES_MISSING)} || {NL} || {NL}"
          f" || {_lit(_EN.DIFF_MISSING)} || {NL} || {NL}"
          f" || CASE WHEN len(v.categories) > 0 THEN {_lit(_EN.CATEGORIES_HEADER)} || {NL}"
          f" || array_to_string(v.categories, ', ') ELSE {_lit(_EN.CATEGORIES_MISSING)} END"
          f" || {NL} || {NL} || {_lit(_EN.PROMPT_INSTRUCTIONS)}")

# The two loads of ``plans.load_scenarios``: old documents, then new lines.
LOADS = f"""
old_repos AS (SELECT id, name, url, ROW_NUMBER() OVER (ORDER BY name) AS rid FROM repositories
              WHERE id IN (SELECT repository_id FROM target)),
new_repos AS (SELECT id, name, url, (SELECT COUNT(*) FROM old_repos) + ROW_NUMBER() OVER (ORDER BY name) AS rid FROM repositories
              WHERE id IN (SELECT repository_id FROM latest) AND id NOT IN (SELECT id FROM old_repos)),
repo_ids AS (SELECT * FROM old_repos UNION ALL SELECT * FROM new_repos),
numbered AS (
  SELECT m.*, r.name AS repository, r.rid,
         CASE WHEN load_action <> 'inserted' THEN ROW_NUMBER() OVER (PARTITION BY load_action = 'inserted' ORDER BY r.rid, hash)
              ELSE (SELECT COUNT(*) FROM target) + ROW_NUMBER() OVER (PARTITION BY load_action = 'inserted' ORDER BY r.rid, hash) END AS new_id
  FROM merged m JOIN repo_ids r ON r.id = m.repository_id),
load_needles AS (
  SELECT DISTINCT repository_id, hash AS revert_hash, UNNEST(regexp_extract_all(subject, '\\(([!#][0-9]+)\\)', 1)) AS token
  FROM merged WHERE {is_revert('subject')}),
load_pairs AS (
  SELECT n.repository_id, n.revert_hash, o.hash AS original_hash FROM load_needles n JOIN merged o
    ON o.repository_id = n.repository_id AND o.hash <> n.revert_hash AND contains(o.subject, n.token)),
load_zeroed AS (SELECT repository_id, revert_hash AS hash FROM load_pairs UNION SELECT repository_id, original_hash FROM load_pairs),
table_rows AS (
  SELECT CAST(n.new_id AS BIGINT) AS id, n.repository, n.hash, n.commit_date, n.author_name, n.author_email, n.subject,
         n.lines_added, n.lines_deleted, n.files_changed,
         CASE WHEN load_action = 'inserted' THEN TIMESTAMP '{SC.EXTRACTED_AT}' ELSE TIMESTAMP '2000-01-03 00:00:00' END AS created_at,
         n.category, CASE WHEN z.hash IS NOT NULL THEN 0 ELSE n.weight END AS weight, n.ai_tools, n.ai_confidence, n.description,
         n.business_impact
  FROM numbered n LEFT JOIN load_zeroed z ON z.repository_id = n.repository_id AND z.hash = n.hash)"""

SQL = {
    "s1_export_rows": with_loaded(
        """SELECT r.name AS repository, r.url AS repository_path, r.description AS repository_description,
  '2000-01-02T00:00:00+00:00' AS extraction_date, TIMESTAMP '2000-01-02 00:00:00' AS extracted_at, c.hash, c.commit_date,
  c.author_name, c.author_email, c.subject, c.weight, c.ai_tools, c.category, CAST(c.ai_confidence AS INTEGER) AS ai_confidence,
  c.business_impact, c.description, c.lines_added, c.lines_deleted, c.files_changed, COALESCE(f.files, '') AS files
FROM loaded c JOIN repositories r ON r.id = c.repository_id
LEFT JOIN (SELECT l_orderkey, string_agg('parts/' || CAST(l_partkey AS VARCHAR) || '.txt:' || CASE WHEN l_returnflag = 'R'
             THEN '0:' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':0' END, ','
             ORDER BY l_linenumber, 'parts/' || CAST(l_partkey AS VARCHAR) || '.txt', CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END,
             l_quantity) AS files FROM lineitem GROUP BY 1) f ON f.l_orderkey = c.id"""),
    "s2_git_log": with_loaded(
        f"""SELECT FALSE AS rejected, m.hash || substr(m.hash, 1, 8) AS hash, m.commit_date - INTERVAL 1 HOUR AS commit_date, m.author_name,
  m.author_email, m.subject,
  COALESCE(m.body, '') || CASE WHEN m.id % 11 = 0 THEN chr(10) || 'COMMIT|' || CAST(m.id AS VARCHAR) || '|is planned' || chr(10)
    || 'COMMIT|' || chr(10) || 'end' ELSE '' END AS body,
  CAST(m.lines_added + CASE WHEN m.id % 17 = 0 THEN 9999999999 ELSE 0 END AS BIGINT) AS lines_added,
  CAST(m.lines_deleted + CASE WHEN m.id % 17 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lines_deleted,
  CAST(CASE WHEN m.id % 17 = 0 THEN 2 ELSE 1 END AS INTEGER) AS files_changed, l.category, l.ai_tools
FROM messages m JOIN loaded l ON l.id = m.id
UNION ALL
SELECT TRUE, NULL, NULL, NULL, NULL, 'stray ' || CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL
FROM messages WHERE id % 100 = 0"""),
    "s5_ingest": with_loaded("SELECT * FROM table_rows", VERSIONS + "," + LOADS),
    "o5_pipeline": with_loaded(
        """SELECT 1 AS load, (SELECT COUNT(*) FROM old_repos) AS repos_created, CAST(0 AS BIGINT) AS repos_updated,
  (SELECT COUNT(*) FROM target) AS commits_inserted, CAST(0 AS BIGINT) AS commits_updated, CAST(0 AS BIGINT) AS errors,
  (SELECT COUNT(*) FROM target) AS total_commits, CAST(0 AS INTEGER) AS failed_files
UNION ALL
SELECT 2, (SELECT COUNT(*) FROM new_repos), (SELECT COUNT(*) FROM old_repos WHERE id IN (SELECT repository_id FROM latest)),
  COUNT(*) FILTER (WHERE load_action = 'inserted'), COUNT(*) FILTER (WHERE load_action = 'updated'), 0,
  COUNT(*) FILTER (WHERE repository_id IN (SELECT repository_id FROM latest)), 0
FROM merged""", VERSIONS + "," + LOADS),
    "s9_snapshot": with_loaded(
        """SELECT repository AS repository_name, CAST(date_trunc('month', commit_date) AS DATE) AS month_start_date,
  COUNT(*) AS total_commits, COUNT(DISTINCT author_email) AS unique_authors,
  CAST(SUM(lines_added + lines_deleted) AS BIGINT) AS total_lines_changed,
  CAST(SUM((lines_added + lines_deleted) * weight) AS DOUBLE) / 100 AS weighted_lines_changed,
  CAST(SUM(weight) AS DOUBLE) / 100 AS effective_commits
FROM table_rows WHERE weight > 0 GROUP BY 1, 2""", VERSIONS + "," + LOADS),
    "s6_duplicate_documents": with_loaded(
        f"""SELECT CAST(CASE WHEN t.id IS NOT NULL THEN t.id
              ELSE (SELECT MAX(id) FROM repositories) + ROW_NUMBER() OVER (PARTITION BY t.id IS NULL ORDER BY s.name) END AS INTEGER) AS id,
  COALESCE(t.name, s.name) AS name, CASE WHEN s.name IS NOT NULL THEN s.url ELSE t.url END AS url,
  CASE WHEN s.name IS NOT NULL THEN s.description ELSE t.description END AS description, s.seen AS last_extracted_at,
  CASE WHEN t.name IS NOT NULL THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '{SC.EXTRACTED_AT}' END AS created_at,
  CASE WHEN t.name IS NOT NULL AND s.name IS NOT NULL THEN TIMESTAMP '{SC.EXTRACTED_AT}' END AS updated_at,
  CASE WHEN t.name IS NOT NULL AND s.name IS NOT NULL THEN 'updated' WHEN s.name IS NOT NULL THEN 'created' ELSE 'kept' END AS load_action
FROM repositories t FULL OUTER JOIN (
  SELECT name, url, description, seen FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY seen DESC, url DESC, description DESC) AS rn FROM (
      SELECT CASE WHEN o.o_orderkey % 2 = 0 THEN n.n_name ELSE 'segment-' || lower(c.c_mktsegment) END AS name,
             '/srv/' || lpad(CAST(o.o_orderkey AS VARCHAR), 12, '0') AS url, 'by ' || CAST(o.o_custkey AS VARCHAR) AS description,
             CAST(o.o_orderdate AS TIMESTAMP) AS seen
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey))
  WHERE rn = 1) s ON s.name = t.name"""),
    "t11_prompt_with_diff": """WITH d AS (SELECT doc_id, text, lang, source, encode(text) AS raw FROM documents),
known AS (SELECT source, array_to_string(list_sort(list(DISTINCT upper(lang)) FILTER (WHERE lang IS NOT NULL)), ', ') AS names FROM d GROUP BY source),
b AS (SELECT *, octet_length(raw) > 10240 AS truncated,
  CASE WHEN substr(hex(raw[10241:10241]), 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 10240 WHEN substr(hex(raw[10240:10240]), 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 10239
       WHEN substr(hex(raw[10239:10239]), 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 10238 ELSE 10237 END AS cut FROM d),
p AS (SELECT doc_id, truncated,
  (SELECT intro FROM intro) || 'COMMIT DETAILS:' || chr(10) || '- Subject: "Change ' || CAST(doc_id AS VARCHAR) || '"' || chr(10) || '- Hash: ' || md5(CAST(doc_id AS VARCHAR))
  || chr(10) || chr(10) || 'MODIFIED FILES:' || chr(10) || '- ' || lang || '/' || b.source || '.txt' || chr(10) || '- README' || chr(10) || chr(10)
  || 'DIFF (changes made)' || CASE WHEN truncated THEN ' [TRUNCATED TO 10KB]' ELSE '' END || ':' || chr(10) || '```' || chr(10)
  || CASE WHEN truncated THEN decode(raw[1:cut]) ELSE text END || chr(10) || '```' || chr(10) || chr(10)
  || 'EXISTING CATEGORIES (prefer these):' || chr(10) || names || chr(10) || chr(10) || 'Name the category.' AS prompt
  FROM b LEFT JOIN known USING (source))
SELECT doc_id, truncated, CAST(octet_length(encode(prompt)) AS INTEGER) AS prompt_bytes, md5(prompt) AS prompt_md5 FROM p""".replace(
        "(SELECT intro FROM intro)", "'You sort commits into categories and describe them. Read the commit below.' || chr(10) || chr(10)"),
    "x1_enrichment": with_loaded(
        """SELECT repository_id, hash, COALESCE(category, CASE WHEN ok THEN 'AREA ' || CAST(n % 5 AS VARCHAR) END) AS category,
  CAST(CASE WHEN ok THEN n % 90 ELSE weight END AS INTEGER) AS weight,
  CASE WHEN ok THEN CAST(least(n % 120, 100) AS SMALLINT) WHEN files_changed > 0 THEN NULL ELSE ai_confidence END AS ai_confidence,
  CASE WHEN ok THEN CAST(n % 90 AS INTEGER) WHEN files_changed > 0 THEN NULL ELSE business_impact END AS business_impact,
  CASE WHEN ok THEN 'Answer ' || CAST(n AS VARCHAR) || '.' WHEN files_changed > 0 THEN NULL ELSE description END AS description
FROM (SELECT *, files_changed > 0 AND n % 7 > 1 AS ok FROM (SELECT *, CAST('0x' || substr(hash, 1, 4) AS INTEGER) AS n FROM loaded))"""),
    "w4_new_key_twice": with_loaded(
        """SELECT repository_id, hash, commit_date, author_name, author_email, lines_added, lines_deleted, files_changed,
  subject || ' v2' AS subject, 70 AS weight, CAST(NULL AS VARCHAR) AS category, CAST(77 AS SMALLINT) AS ai_confidence,
  70 AS business_impact, 're-extracted' AS description, CAST(NULL AS VARCHAR) AS ai_tools FROM loaded"""),
    "o4_reverts_without_number": with_loaded(
        f"""SELECT repository_id, hash, subject FROM (
  SELECT repository_id, hash, CASE WHEN id % 13 = 0 THEN 'revert ' || COALESCE(category, 'work') ELSE subject END AS subject FROM loaded)
WHERE {is_revert('subject')} AND NOT regexp_matches(subject, '\\([!#][0-9]+\\)')"""),
    "q25_event_activity_by_weekday_hour": """SELECT CAST(isodow(ts) AS INTEGER) AS iso_weekday,
  CAST(hour(ts) AS INTEGER) AS hour_of_day, COUNT(*) AS total_commits FROM events GROUP BY 1, 2""",
    "s3_export_rows": with_loaded(
        f"""SELECT r.name AS repository, r.url AS repository_path, r.description AS repository_description,
  '{SC.EXTRACTED_AT}' AS extraction_date, c.hash, strftime(c.commit_date, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS date,
  c.author_name, c.author_email, c.subject, c.weight, c.ai_tools, c.category,
  CAST(c.ai_confidence AS INTEGER) AS ai_confidence, c.business_impact, c.description,
  c.lines_added, c.lines_deleted, c.files_changed
FROM loaded c JOIN repositories r ON r.id = c.repository_id"""),
    "t11_prompt_text": with_loaded(
        f"""SELECT c.repository_id, c.hash, {PROMPT} AS prompt
FROM loaded c LEFT JOIN (
  SELECT repository_id, list(category ORDER BY category) AS categories FROM (
    SELECT repository_id, category FROM loaded WHERE category IS NOT NULL
    GROUP BY repository_id, category HAVING COUNT(*) > 1) GROUP BY repository_id) v
  ON v.repository_id = c.repository_id"""),
    "t1_category_rules": with_loaded(
        f"""SELECT id, subject, {_CAND} AS candidate, {valid(_CAND)} AS is_valid, {reason_sql(_CAND)} AS reason,
  {category_sql('subject')} AS category
FROM (SELECT id, subject, {candidate_sql('subject')} AS {_CAND} FROM messages)"""),
    "t4_category_quality_audit": with_loaded(
        f"""SELECT {reason_sql(_CAND)} AS reason, COUNT(*) AS commits
FROM (SELECT {candidate_sql('subject')} AS {_CAND} FROM messages) GROUP BY 1"""),
    "t5_ai_tools_from_body": with_loaded(f"SELECT id, body, {tools_sql('body')} AS ai_tools FROM messages"),
    "t6_tool_names": with_loaded(
        f"""SELECT tool, CASE WHEN regexp_matches(upper(tool), 'CLAUDE.*CODE') THEN 'CLAUDE CODE'
  WHEN regexp_matches(upper(tool), 'COPILOT') THEN 'GITHUB COPILOT'
  WHEN regexp_matches(upper(tool), 'CURSOR') THEN 'CURSOR'
  WHEN regexp_matches(upper(tool), 'CLAUDE') THEN 'CLAUDE' ELSE upper(tool) END AS tool_name,
  COUNT(*) AS occurrences
FROM (SELECT {strip('raw')} AS tool FROM (
        SELECT UNNEST(regexp_split_to_array({strip(f"regexp_extract(body, {TOOL_MARKER}, 1)")}, {TOOL_SPLIT})) AS raw
        FROM messages))
WHERE tool <> '' GROUP BY tool"""),
    "t7_reference_rules": with_loaded(
        f"""SELECT id, subject, COALESCE({is_revert('subject')}, FALSE) AS is_revert,
  array_to_string(list_filter(refs, lambda x, i: list_position(refs, x) = i), ',') AS "references"
FROM (SELECT id, subject, list_concat(regexp_extract_all(subject, '\\((![0-9]+)\\)', 1),
                                      regexp_extract_all(subject, '\\((#[0-9]+)\\)', 1)) AS refs FROM messages)"""),
    "t8_repository_name_from_url": f"""SELECT page_id, form, location,
  regexp_replace(string_split(regexp_replace({strip('location')}, '/+$', ''), '/')[-1], '\\.git$', '') AS name
FROM (SELECT page_id, 0 AS form, url AS location FROM pages
      UNION ALL SELECT page_id, 1, url || '.git' FROM pages
      UNION ALL SELECT page_id, 2, url || '.git/' FROM pages)""",
    "t9_git_dates": f"""SELECT id, git_date, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 1 HOUR AS commit_date,
  regexp_replace(git_date, {GIT_DATE}, '\\1T\\2\\3:\\4') AS iso_date
FROM (SELECT o_orderkey AS id, o_orderdate, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +0100' AS git_date
      FROM orders)""",
    "t10_diff_truncation": """SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS diff_bytes,
  CAST(least(octet_length(encode(text)), 10240) AS INTEGER) AS kept_bytes,
  octet_length(encode(text)) > 10240 AS truncated, md5(encode(text)[1:10240]) AS kept_md5
FROM documents""",
    "j3_revert_matches": with_commits("SELECT repository_id, revert_hash, token, original_hash FROM pairs"),
    "u1_zeroed_keys": with_commits("SELECT repository_id, hash FROM zeroed"),
    "o2_revert_weighting": with_commits("SELECT repository_id, hash, weight FROM commits"),
    "o2_revert_weighting_documented": with_commits(
        f"""SELECT l.repository_id, l.hash, CASE WHEN z.hash IS NOT NULL THEN 0 ELSE l.weight END AS weight
FROM loaded l LEFT JOIN zeroed_doc z ON z.repository_id = l.repository_id AND z.hash = l.hash""",
        f"""pairs_doc AS (
  SELECT n.repository_id, n.revert_hash, o.hash AS original_hash FROM needles n JOIN loaded o
    ON o.repository_id = n.repository_id AND o.hash <> n.revert_hash
   AND list_contains({ORIG_REFS}, n.token) AND NOT regexp_matches(o.subject, '(?i)\\bunrevert\\b')),
zeroed_doc AS (SELECT repository_id, revert_hash AS hash FROM pairs_doc
               UNION SELECT repository_id, original_hash FROM pairs_doc)"""),
    "p14_weighting_one_repository": with_commits(
        f"""SELECT l.repository_id, l.hash, CASE WHEN z.hash IS NOT NULL THEN 0 ELSE l.weight END AS weight
FROM loaded l LEFT JOIN (
  SELECT repository_id, hash FROM zeroed
  WHERE repository_id IN (SELECT id FROM repositories WHERE name = '{SC.CLEANED_REPOSITORY}')) z
  ON z.repository_id = l.repository_id AND z.hash = l.hash"""),
    "o3_weighting_plan": with_commits(
        """SELECT l.repository_id, l.hash, l.weight AS old_weight, 0 AS new_weight,
  CASE WHEN rv.hash IS NOT NULL THEN 'Revert commit' ELSE 'Reverted by ' || substr(og.by_hash, 1, 8) END AS reason
FROM loaded l
LEFT JOIN (SELECT DISTINCT repository_id, revert_hash AS hash FROM pairs) rv
  ON rv.repository_id = l.repository_id AND rv.hash = l.hash
LEFT JOIN (SELECT repository_id, original_hash AS hash, MIN(revert_hash) AS by_hash FROM pairs GROUP BY 1, 2) og
  ON og.repository_id = l.repository_id AND og.hash = l.hash
WHERE (rv.hash IS NOT NULL OR og.hash IS NOT NULL) AND l.weight <> 0"""),
    "o4_weighting_summary": with_commits(
        f"""SELECT (SELECT COUNT(*) FROM loaded) AS commits_processed,
  (SELECT COUNT(*) FROM loaded WHERE {is_revert('subject')}) AS reverts_found,
  (SELECT COUNT(*) FROM loaded l JOIN zeroed z ON z.repository_id = l.repository_id AND z.hash = l.hash
   WHERE l.weight <> 0) AS commits_zeroed"""),
    "o4_weighting_warnings": with_commits(
        """SELECT n.repository_id, n.revert_hash, n.token FROM needles n
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repository_id = n.repository_id
                  AND p.revert_hash = n.revert_hash AND p.token = n.token)"""),
    "w4_last_write_wins": with_loaded("SELECT * FROM latest", VERSIONS),
    "s4_upsert_commits": with_loaded(
        """SELECT id, repository_id, hash, commit_date, author_name, author_email, subject, lines_added,
  lines_deleted, files_changed, created_at, category, weight, ai_tools, ai_confidence, description,
  business_impact, load_action FROM merged""", VERSIONS),
    "s12_load_statistics": with_loaded(
        """SELECT COUNT(*) FILTER (WHERE load_action = 'inserted') AS commits_inserted,
  COUNT(*) FILTER (WHERE load_action = 'updated') AS commits_updated, COUNT(*) AS total_commits FROM merged""",
        VERSIONS),
    "s13_constraint_audit": with_loaded(
        """SELECT rule, violations FROM (
  SELECT 'hash_not_null' AS rule, COUNT(*) FILTER (WHERE hash IS NULL) AS violations FROM merged
  UNION ALL SELECT 'hash_length_40', COUNT(*) FILTER (WHERE length(hash) > 40) FROM merged
  UNION ALL SELECT 'commit_date_not_null', COUNT(*) FILTER (WHERE commit_date IS NULL) FROM merged
  UNION ALL SELECT 'author_name_not_null', COUNT(*) FILTER (WHERE author_name IS NULL) FROM merged
  UNION ALL SELECT 'author_name_length_255', COUNT(*) FILTER (WHERE length(author_name) > 255) FROM merged
  UNION ALL SELECT 'author_email_not_null', COUNT(*) FILTER (WHERE author_email IS NULL) FROM merged
  UNION ALL SELECT 'author_email_length_255', COUNT(*) FILTER (WHERE length(author_email) > 255) FROM merged
  UNION ALL SELECT 'subject_not_null', COUNT(*) FILTER (WHERE subject IS NULL) FROM merged
  UNION ALL SELECT 'lines_not_null', COUNT(*) FILTER (WHERE lines_added IS NULL OR lines_deleted IS NULL
                                                       OR files_changed IS NULL) FROM merged
  UNION ALL SELECT 'category_length_100', COUNT(*) FILTER (WHERE length(category) > 100) FROM merged
  UNION ALL SELECT 'ai_tools_length_255', COUNT(*) FILTER (WHERE length(ai_tools) > 255) FROM merged
  UNION ALL SELECT 'weight_range', COUNT(*) FILTER (WHERE weight IS NULL OR weight < 0 OR weight > 100) FROM merged
  UNION ALL SELECT 'ai_confidence_range', COUNT(*) FILTER (WHERE ai_confidence < 0 OR ai_confidence > 100) FROM merged
  UNION ALL SELECT 'business_impact_range', COUNT(*) FILTER (WHERE business_impact < 0 OR business_impact > 100)
            FROM merged
  UNION ALL SELECT 'unique_repository_hash', CAST(COALESCE(SUM(n - 1), 0) AS BIGINT)
            FROM (SELECT COUNT(*) AS n FROM merged GROUP BY repository_id, hash HAVING COUNT(*) > 1)
  UNION ALL SELECT 'orphan_commits', COUNT(*) FROM merged m
            WHERE NOT EXISTS (SELECT 1 FROM repositories r WHERE r.id = m.repository_id))""", VERSIONS),
    "s6_load_repositories": with_loaded(
        f"""SELECT CAST(CASE WHEN t.id IS NOT NULL THEN t.id
              ELSE (SELECT MAX(id) FROM repositories)
                   + ROW_NUMBER() OVER (PARTITION BY t.id IS NULL ORDER BY s.name) END AS INTEGER) AS id,
  COALESCE(t.name, s.name) AS name,
  CASE WHEN s.name IS NOT NULL THEN s.url ELSE t.url END AS url,
  CASE WHEN s.name IS NOT NULL THEN s.description ELSE t.description END AS description,
  CASE WHEN s.name IS NOT NULL THEN TIMESTAMP '{SC.EXTRACTED_AT}' END AS last_extracted_at,
  CASE WHEN t.name IS NOT NULL THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '{SC.EXTRACTED_AT}' END AS created_at,
  CASE WHEN t.name IS NOT NULL AND s.name IS NOT NULL THEN TIMESTAMP '{SC.EXTRACTED_AT}' END AS updated_at,
  CASE WHEN t.name IS NOT NULL AND s.name IS NOT NULL THEN 'updated'
       WHEN s.name IS NOT NULL THEN 'created' ELSE 'kept' END AS load_action
FROM repositories t FULL OUTER JOIN (
  SELECT DISTINCT name, '/srv/git/' || name AS url, 'Repository ' || name AS description FROM (
    SELECT DISTINCT r.name FROM loaded l JOIN repositories r ON r.id = l.repository_id
    WHERE l.commit_date >= {EXPORT_FROM}
    UNION ALL
    SELECT DISTINCT 'segment-' || lower(c.c_mktsegment) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    WHERE CAST(o.o_orderdate AS TIMESTAMP) >= {EXPORT_FROM})) s ON t.name = s.name"""),
    "s7_delete_repository": with_commits(
        f"""SELECT r.id, r.name, CAST(NULL AS TIMESTAMP) AS last_extracted_at, COALESCE(g.n, 0) AS commits
FROM repositories r LEFT JOIN (
  SELECT repository_id, COUNT(*) AS n FROM commits
  WHERE repository_id NOT IN (SELECT id FROM repositories WHERE name = '{SC.CLEANED_REPOSITORY}')
  GROUP BY repository_id) g ON g.repository_id = r.id"""),
    "s8_deletion_preview": with_commits(
        f"""SELECT r.id, r.name, r.url, CAST(NULL AS TIMESTAMP) AS last_extracted_at,
  (SELECT COUNT(*) FROM commits c WHERE c.repository_id = r.id) AS commits_to_delete
FROM repositories r WHERE r.name = '{SC.CLEANED_REPOSITORY}'"""),
    "j5_orphan_commits": with_commits(
        f"""SELECT c.repository_id, c.hash FROM commits c
WHERE NOT EXISTS (SELECT 1 FROM repositories r WHERE r.id = c.repository_id AND r.name <> '{SC.CLEANED_REPOSITORY}')"""),
    "s11_export_summary": with_loaded(
        """SELECT r.name AS repository, COUNT(*) AS total_commits,
  CAST(SUM(CAST(c.lines_added AS BIGINT)) AS BIGINT) AS total_lines_added,
  CAST(SUM(CAST(c.lines_deleted AS BIGINT)) AS BIGINT) AS total_lines_deleted,
  CAST(SUM(CAST(c.files_changed AS BIGINT)) AS BIGINT) AS total_files_changed,
  COUNT(DISTINCT c.author_email) AS unique_authors
FROM loaded c JOIN repositories r ON r.id = c.repository_id GROUP BY r.name"""),
    "t12_response_parsing": with_loaded(
        "SELECT repository_id, hash, category, confidence, business_impact, reason, description, error FROM parsed",
        PARSED),
    "t13_enrichment_merge": with_loaded(
        """SELECT l.id, l.repository_id, l.hash, l.commit_date, l.author_name, l.author_email, l.subject,
  l.lines_added, l.lines_deleted, l.files_changed, l.created_at,
  COALESCE(l.category, CASE WHEN p.error IS NULL THEN p.category END) AS category,
  CAST(CASE WHEN p.hash IS NOT NULL AND p.error IS NULL THEN COALESCE(p.business_impact, 100) ELSE l.weight END AS INTEGER) AS weight,
  l.ai_tools,
  CASE WHEN p.hash IS NULL THEN l.ai_confidence WHEN p.error IS NULL THEN CAST(p.confidence AS SMALLINT) END AS ai_confidence,
  CASE WHEN p.hash IS NULL THEN l.description WHEN p.error IS NULL THEN p.description END AS description,
  CASE WHEN p.hash IS NULL THEN l.business_impact WHEN p.error IS NULL THEN p.business_impact END AS business_impact
FROM loaded l LEFT JOIN parsed p
  ON p.repository_id = l.repository_id AND p.hash = l.hash""", PARSED),
    "j2_category_stats_weighted": with_commits(
        f"""SELECT c.category, cw.weight AS category_weight,
  {_m(TEAM, "total_commits unique_authors repositories total_lines_added total_lines_deleted total_lines_changed"
          " weighted_lines_added weighted_lines_deleted weighted_lines_changed effective_commits avg_weight"
          " weight_efficiency_pct avg_lines_per_commit_1 first_commit latest_commit")}
FROM commits c LEFT JOIN cw ON c.category = cw.name
WHERE c.category IS NOT NULL AND c.weight > 0
GROUP BY c.category, cw.weight""",
        """cw AS (SELECT category AS name, CAST(50 + COUNT(*) % 51 AS INTEGER) AS weight FROM commits
        WHERE category IS NOT NULL AND length(category) % 2 = 0 GROUP BY category)"""),
}
