"""Commit-text operators as Column -> Column functions (no Python UDF).

Each function builds one Catalyst expression tree, so a projection that uses
several of them stays inside one whole-stage-codegen span next to the scan.

Regex notes.  The rules were written for a Ruby regex engine, whose ``^``/``$``
anchor at every line and whose ``\\s`` includes the vertical tab.  Java needs
``(?m)`` for the anchors and ``(?d)`` so that only ``\\n`` ends a line; the
whitespace class is spelled out so that Spark (Java) and the SQL oracle (RE2)
agree on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------
# Whitespace of the original rules: tab, newline, vertical tab, form feed,
# carriage return, space (plus NUL for strip()).
WS = r"[\t\n\x0B\f\r ]"
STRIP_CHARS = "\t\n\x0b\f\r \x00"
# All-caps first words that are verbs, not categories.
IGNORED_FIRST_WORDS = ["MERGE", "FIX", "ADD", "UPDATE", "REMOVE", "DELETE"]
CATEGORY_MIN_LEN = 2
CATEGORY_MAX_LEN = 50
# Tool-name rules, tried in this order on the upper-cased name; the first
# pattern that matches anywhere gives the name, otherwise the upper-cased text.
TOOL_NAME_RULES = [
    ("CLAUDE.*CODE", "CLAUDE CODE"),
    ("GITHUB.*COPILOT", "GITHUB COPILOT"),
    ("GH.*COPILOT", "GITHUB COPILOT"),
    ("COPILOT", "GITHUB COPILOT"),
    ("CURSOR", "CURSOR"),
    ("CLAUDE", "CLAUDE"),
]
AI_TOOLS_MARKER = r"(?i)\*{0,2}" + WS + r"*AI" + WS + r"+tools?" + WS + r"*:" + WS + r"*([^\n*]+)"
TOOL_SPLIT = WS + r"+(?:and|&)" + WS + r"+|," + WS + r"*"
REVERT_WORD = r"(?i)\brevert\b"
UNREVERT_WORD = r"(?i)\bunrevert\b"
# Category rejection reasons, in the order the rules are tried.
REASON_EMPTY = "nil or empty"
REASON_TOO_LONG = "too long (>50 chars)"
REASON_TOO_SHORT = "too short (<2 chars)"
REASON_NUMERIC = "purely numeric"
REASON_VERSION = "looks like version number"
REASON_ISSUE = "looks like issue number"
REASON_HASH = "starts with # symbol"
REASON_DIGITS = "too many digits (>50%)"
REASON_NO_LETTER = "contains no letters"
REASON_VALID = "valid"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body(value)``.

    Inside CASE WHEN branches Spark re-evaluates a repeated sub-expression; a
    one-element ``transform`` binds it to a lambda variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c) -> Column:
    """Trim whitespace and NUL on both ends (``trim`` alone only removes blanks)."""
    return F.btrim(_col(c), F.lit(STRIP_CHARS))


# --------------------------------------------------------------- T2 / T3 ---
def _digit_count(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, "[0-9]", ""))


def _numeric_rules(c: Column):
    """(predicate, reason) pairs of the numeric guard, in rule order."""
    return [
        (c.rlike(r"(?md)^[0-9]+$"), REASON_NUMERIC),
        (c.rlike(r"(?md)^[0-9]+\.[0-9]+"), REASON_VERSION),
        (c.rlike(r"(?md)^#[0-9]+$"), REASON_ISSUE),
        (c.rlike(r"(?md)^#"), REASON_HASH),
        (_digit_count(c) * 2 > F.length(c), REASON_DIGITS),
    ]


def category_rejection_reason(c, prevent_numeric: bool = True) -> Column:
    """The first rule a category candidate fails, or ``'valid'``."""
    c = _col(c)
    n = F.length(c)
    chain = (F.when(c.isNull() | (n == 0), F.lit(REASON_EMPTY))
             .when(n > CATEGORY_MAX_LEN, F.lit(REASON_TOO_LONG))
             .when(n < CATEGORY_MIN_LEN, F.lit(REASON_TOO_SHORT)))
    if prevent_numeric:
        for predicate, reason in _numeric_rules(c):
            chain = chain.when(predicate, F.lit(reason))
    return (chain.when(~c.rlike("[A-Za-z]"), F.lit(REASON_NO_LETTER))
            .otherwise(F.lit(REASON_VALID)))


def is_valid_category(c, prevent_numeric: bool = True) -> Column:
    """True when the candidate passes every rule (never NULL)."""
    c = _col(c)
    n = F.length(c)
    ok = c.isNotNull() & (n >= CATEGORY_MIN_LEN) & (n <= CATEGORY_MAX_LEN)
    if prevent_numeric:
        for predicate, _ in _numeric_rules(c):
            ok = ok & ~predicate
    ok = ok & c.rlike("[A-Za-z]")
    return F.coalesce(ok, F.lit(False))


# -------------------------------------------------------------------- T1 ---
BRACKET = r"(?md)^\[([^\]]+)\]"


def _candidate_from(s: Column, before_pipe: Column, bracket: Column, first_word: Column) -> Column:
    """Pick the candidate from the three pre-computed pieces (rule order)."""
    word_ok = (first_word == F.upper(first_word)) & (F.length(first_word) >= 2) \
        & ~first_word.isin(*IGNORED_FIRST_WORDS)
    return (F.when(s.isNull() | (strip(s) == ""), F.lit(None).cast("string"))
            .when(s.contains(" | ") & (before_pipe != ""), before_pipe)
            .when(bracket != "", F.upper(strip(bracket)))
            .when(word_ok, first_word))


def _pieces(s: Column):
    return (F.upper(strip(F.substring_index(s, " | ", 1))),   # text before the first ' | '
            F.regexp_extract(s, BRACKET, 1),                  # '' when there is no [NAME]
            F.split(s, WS + "+", 2).getItem(0))               # first blank-separated word


def category_candidate(subject) -> Column:
    """The category a subject proposes before validation (NULL when none).

    First rule that applies: text before the first ``' | '`` (stripped,
    upper-cased, skipped when empty); a leading ``[NAME]`` (stripped,
    upper-cased); the first blank-separated word when it is already upper
    case, at least 2 characters and not an ignored verb.
    """
    s = _col(subject)
    bp, br, fw = _pieces(s)
    return let(F.struct(bp.alias("bp"), br.alias("br"), fw.alias("fw")),
               lambda p: _candidate_from(s, p["bp"], p["br"], p["fw"]))


def add_category_candidate(df: DataFrame, subject: str = "subject", out: str = "candidate") -> DataFrame:
    """The candidate as projections: each piece is computed once per row."""
    bp, br, fw = _pieces(F.col(subject))
    df = df.withColumns({"_bp": bp, "_br": br, "_fw": fw})
    return df.withColumn(out, _candidate_from(F.col(subject), F.col("_bp"), F.col("_br"), F.col("_fw"))) \
             .drop("_bp", "_br", "_fw")


def category_from_subject(subject, prevent_numeric: bool = True) -> Column:
    """Business category from a commit subject, or NULL.

    The candidate (``category_candidate``) is validated once (T2): a rejected
    candidate does not fall through to the next rule.
    """
    return let(category_candidate(subject), lambda c: F.when(is_valid_category(c, prevent_numeric), c))


def add_category(df: DataFrame, subject: str = "subject", out: str = "category",
                 prevent_numeric: bool = True) -> DataFrame:
    """T1 as projections: the candidate is computed once, then validated.

    The category leaves through a one-element ``explode``: a later filter on it
    (``category IS NOT NULL``) then tests the computed value instead of being
    pushed below with the whole derivation substituted into its condition,
    which would compute the category twice per row.
    """
    tmp = f"_{out}_candidate"
    df = add_category_candidate(df, subject, tmp)
    value = F.when(is_valid_category(tmp, prevent_numeric), F.col(tmp))
    cols = [c for c in df.columns if c != tmp]
    return df.select(*cols, F.explode(F.array(value)).alias(out))


# --------------------------------------------------------------- T5 / T6 ---
def normalize_tool_name(tool) -> Column:
    """Upper-case a tool name and map known spellings to one name."""
    u = F.upper(_col(tool))
    chain = None
    for pattern, name in TOOL_NAME_RULES:
        chain = (F.when(u.rlike(pattern), F.lit(name)) if chain is None
                 else chain.when(u.rlike(pattern), F.lit(name)))
    return chain.otherwise(u)


def ai_tools_from_body(body) -> Column:
    """T5: ``'A, B'`` list of tools named after the first ``AI tool(s):`` marker.

    The list is split on `` and `` / `` & `` (lower-case ``and`` only) and on
    commas; names are stripped, normalised (T6) and de-duplicated keeping the
    first occurrence.  NULL when the body is empty or names no tool.
    """
    b = _col(body)
    return F.when(b.isNotNull() & (strip(b) != ""),
                  let(tool_list(b), lambda t: F.when(F.size(t) > 0, F.array_join(t, ", "))))


def tool_list(body) -> Column:
    """The distinct normalised tool names after the first marker (array, maybe empty)."""
    listed = strip(F.regexp_extract(_col(body), AI_TOOLS_MARKER, 1))
    parts = F.filter(F.transform(F.split(listed, TOOL_SPLIT), strip), lambda x: x != "")
    return F.array_distinct(F.transform(parts, normalize_tool_name))


def add_ai_tools(df: DataFrame, body: str = "body", out: str = "ai_tools") -> DataFrame:
    """T5 as two projections: the tool list is computed once, then joined."""
    tmp = f"_{out}_list"
    b = F.col(body)
    df = df.withColumn(tmp, F.when(b.isNotNull() & (strip(b) != ""), tool_list(b)))
    # Emitted through a one-element explode, like the category (see add_category).
    value = F.when(F.size(tmp) > 0, F.array_join(tmp, ", "))
    cols = [c for c in df.columns if c != tmp]
    return df.select(*cols, F.explode(F.array(value)).alias(out))


# --------------------------------------------------------------- T7 / P13 --
def is_revert(subject) -> Column:
    """``Revert`` as a whole word, any case, and no ``Unrevert``."""
    s = _col(subject)
    return F.coalesce(s.rlike(REVERT_WORD) & ~s.rlike(UNREVERT_WORD), F.lit(False))


def is_unrevert(subject) -> Column:
    return F.coalesce(_col(subject).rlike(UNREVERT_WORD), F.lit(False))


def pr_references(subject) -> Column:
    """``(!n)`` references, then ``(#n)`` references, distinct, with their sign."""
    s = _col(subject)
    bang = F.regexp_extract_all(s, F.lit(r"\((![0-9]+)\)"), 1)
    hashes = F.regexp_extract_all(s, F.lit(r"\((#[0-9]+)\)"), 1)
    return F.array_distinct(F.concat(bang, hashes))


def reference_runs(subject) -> Column:
    """Every maximal sign-plus-digits run (``!123``, ``#45``) anywhere in the text."""
    return F.regexp_extract_all(_col(subject), F.lit(r"([!#][0-9]+)"), 1)


def reference_prefixes(subject, lengths: Column) -> Column:
    """Distinct prefixes (sign + at least one digit) of every reference run, of the given lengths.

    A needle ``!104`` occurs in a subject exactly when it is a prefix of one of
    the subject's runs, so joining needles on the prefixes as long as a needle is the substring
    match of the original rule as an equi-join.
    """
    runs = reference_runs(subject)
    prefixes = F.transform(runs, lambda r: F.transform(
        F.filter(lengths, lambda n: n <= F.length(r)), lambda n: r.substr(F.lit(1), n)))
    return F.array_distinct(F.flatten(prefixes))


# -------------------------------------------------------------- T8 - T10 ---
def repository_name_from_url(url) -> Column:
    """Last path segment without a trailing ``.git`` (URL or directory path)."""
    u = F.regexp_replace(strip(url), "/+$", "")
    last = F.element_at(F.split(u, "/"), -1)
    return F.regexp_replace(last, r"\.git$", "")


def parse_git_date(text) -> Column:
    """``2024-11-12 10:30:00 +0100`` (or ISO-8601) -> timestamp; NULL when unparseable."""
    t = strip(text)
    # a pattern that does not fit costs an exception per row, so the T picks it
    return F.when(F.contains(F.upper(t), F.lit("T")), F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    )).otherwise(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss Z")))


GIT_DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) ([0-9]{2}:[0-9]{2}:[0-9]{2}) ([+-][0-9]{2})([0-9]{2})$"


def iso_date_text(text) -> Column:
    """T9 text form: ``2024-11-12T10:30:00+01:00`` (offset kept) when the git
    date parses, otherwise the input unchanged."""
    t = strip(text)
    iso = F.regexp_replace(t, GIT_DATE, "$1T$2$3:$4")
    return F.when(parse_git_date(text).isNotNull() & t.rlike(GIT_DATE), iso).otherwise(_col(text))


def truncate_diff(diff, max_bytes: int):
    """(first ``max_bytes`` bytes of the diff as binary, truncated flag)."""
    raw = F.encode(_col(diff), "UTF-8")
    return F.substring(raw, 1, max_bytes), F.octet_length(raw) > max_bytes


def truncate_diff_text(diff, max_bytes: int) -> Column:
    """T10 as text: the longest prefix of whole characters within ``max_bytes`` bytes of UTF-8.

    The cut moves back over at most three bytes, to where a character begins.
    """
    raw = F.encode(_col(diff), "UTF-8")
    # the byte behind the cut: a continuation byte (10xxxxxx) tells that the cut is inside a character
    inside = lambda back: F.hex(F.substring(raw, max_bytes + 1 - back, 1)).rlike("^[89AB]")
    back = F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), F.lit(max_bytes) - back), "UTF-8")
    return F.when(F.octet_length(raw) <= max_bytes, _col(diff)).otherwise(cut)
