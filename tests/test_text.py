"""Example tables for the text operators (cases from the reference's specs)."""
from pyspark.sql import functions as F

from commitlens.functions import text
from conftest import one_col


def apply(spark, fn, values, dtype="string"):
    df = one_col(spark, values, dtype=dtype).withColumn("_i", F.monotonically_increasing_id())
    return [r["y"] for r in df.select("_i", fn(F.col("x")).alias("y")).orderBy("_i").collect()]


def test_ai_tools_examples(spark):
    cases = {
        "**AI tool: Claude Code**": "CLAUDE CODE",
        "**AI tools: Claude Code and Copilot**": "CLAUDE CODE, GITHUB COPILOT",
        "AI tools: Cursor, GitHub Copilot": "CURSOR, GITHUB COPILOT",
        "Some body without marker": None,
        "": None,
        None: None,
        "ai tool: windsurf & Cursor": "WINDSURF, CURSOR",
        "AI Tools: Claude": "CLAUDE",
        "AI tool: Cursor\nAI tool: Copilot": "CURSOR",
        "AI   tool  :   Claude Code   and   Cursor": "CLAUDE CODE, CURSOR",
        "AI tools: Copilot, copilot, GH Copilot": "GITHUB COPILOT",
        "AI tools: Cursor AND Claude": "CURSOR",  # one name: the split is case-sensitive
        "AI tools: Foo AND Bar": "FOO AND BAR",
        "Fix\n\n**AI tool: SomeNewTool**\nmore": "SOMENEWTOOL",
    }
    got = apply(spark, text.ai_tools_from_body, list(cases))
    assert got == list(cases.values())


def test_tool_name_normalisation(spark):
    cases = {"Copilot": "GITHUB COPILOT", "GitHub Copilot": "GITHUB COPILOT", "claude code": "CLAUDE CODE",
             "Claude": "CLAUDE", "cursor ai": "CURSOR", "SomeNewTool": "SOMENEWTOOL"}
    assert apply(spark, text.normalize_tool_name, list(cases)) == list(cases.values())


def test_category_from_subject(spark):
    cases = {
        "BILLING | Fix invoice rounding": "BILLING",
        "cs | lower case pipe": "CS",
        "[API] Add endpoint": "API",
        "[ api gateway ] spaces": "API GATEWAY",
        "INFRA upgrade nodes": "INFRA",
        "Fix typo": None,
        "FIX typo": None,
        "MERGE branch main": None,
        "2.58.0 release": None,
        "#5930 hotfix": None,
        "I18N labels": "I18N",
        'Revert "CS | Move HTML content (!10463)" (!10662)': 'REVERT "CS',
        " | empty before pipe": None,
        "[] not a bracket": None,
        "[ ] blank bracket": None,
        "A lone letter": None,
        "": None,
        None: None,
        "2023 | year as category": None,
        "12345ABC | digits": None,
        "E-COMMERCE checkout": "E-COMMERCE",
    }
    assert apply(spark, text.category_from_subject, list(cases)) == list(cases.values())


def test_category_guard_off(spark):
    got = apply(spark, lambda c: text.category_from_subject(c, prevent_numeric=False),
                ["12345ABC | digits", "2023 | year"])
    assert got == ["12345ABC", None]


def test_validator_accepts_and_rejects(spark):
    accepted = ["BILLING", "API GATEWAY", "E-COMMERCE", "I18N", "A" * 50, "2FA", "ABC123", "A/B TESTING"]
    rejected = [None, "", "   ", "A", "A" * 51, "2.26.0", "#5930", "2023", "#TAG", "12345ABC", "2023-12-25"]
    assert apply(spark, text.is_valid_category, accepted) == [True] * len(accepted)
    assert apply(spark, text.is_valid_category, rejected) == [False] * len(rejected)


def test_rejection_reasons(spark):
    cases = {
        None: "nil or empty", "": "nil or empty", "A" * 51: "too long (>50 chars)", "A": "too short (<2 chars)",
        "2023": "purely numeric", "2.58.0": "looks like version number", "#6802": "looks like issue number",
        "#TAG": "starts with # symbol", "12345ABC": "too many digits (>50%)", "--": "contains no letters",
        "BILLING": "valid",
    }
    assert apply(spark, text.category_rejection_reason, list(cases)) == list(cases.values())


def test_revert_predicate_and_references(spark):
    subjects = ['Revert "CS | Move HTML content (!10463)" (!10662)', "Unrevert !10463 and fix error (!10660)",
                "revert: (#123) and (!5)", "Reverts stuff (!1)", "No refs here", "Fix (#12) (!7) (#12)"]
    assert apply(spark, text.is_revert, subjects) == [True, False, True, False, False, False]
    refs = apply(spark, lambda c: F.array_join(text.pr_references(c), ","), subjects)
    assert refs == ["!10463,!10662", "!10660", "!5,#123", "!1", "", "!7,#12"]


def test_reference_prefixes(spark):
    got = apply(spark, lambda c: F.array_join(F.array_sort(text.reference_prefixes(c, F.array(*map(F.lit, (2, 3, 4))))), ","), ["x !104 y #12", "none"])
    assert got == ["!1,!10,!104,#1,#12", ""]


def test_repository_name_from_url(spark):
    cases = {"git@github.com:org/backend-api.git": "backend-api", "https://host/org/web.git/": "web",
             "/srv/repos/mater": "mater", "/srv/repos/mater/": "mater"}
    assert apply(spark, text.repository_name_from_url, list(cases)) == list(cases.values())


def test_git_dates(spark):
    import datetime as dt
    got = apply(spark, text.parse_git_date, ["2024-11-12 10:30:00 +0100", "not a date", "2024-06-01T10:00:00+00:00"])
    assert got == [dt.datetime(2024, 11, 12, 9, 30), None, dt.datetime(2024, 6, 1, 10, 0)]
    iso = apply(spark, text.iso_date_text, ["2024-11-12 10:30:00 +0100", "not a date"])
    assert iso == ["2024-11-12T10:30:00+01:00", "not a date"]


def test_diff_truncation(spark):
    big = "é" * 7500  # 15,000 bytes
    df = one_col(spark, [big, "small"])
    kept, flag = text.truncate_diff("x", 10_240)
    rows = df.select(F.octet_length(kept).alias("n"), flag.alias("t")).collect()
    assert [(r["n"], r["t"]) for r in rows] == [(10240, True), (5, False)]
