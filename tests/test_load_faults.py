"""Loads that repeat repositories and keys, git logs with hostile lines, failed model calls."""
from commitlens.operators import enrich, table as TB
from commitlens.sources import gitlog


def test_one_repository_per_name(spark):
    target = spark.createDataFrame([], "id int, name string, url string, description string, last_extracted_at timestamp, created_at timestamp, updated_at timestamp")
    incoming = spark.createDataFrame([("r", "u", "old", 1), ("r", "u", "new", 2)], "name string, url string, description string, at int")
    incoming = incoming.selectExpr("name", "url", "description", "timestamp_seconds(at) as extracted_at")
    rows = TB.load_repositories(target, incoming, "2026-01-01 00:00:00").collect()
    assert [(r.id, r.name, r.description) for r in rows] == [(1, "r", "new")]


def test_new_key_twice_keeps_first_and_updates_last(spark):
    rows = spark.createDataFrame(
        [(1, "h", "first", "a@x", 10, "2026-01-01", "f1", 5), (1, "h", "last", "b@x", 20, "2026-02-01", "f2", 0)],
        "repository_id int, hash string, subject string, author_email string, lines_added int, extraction_date string, _file string, _pos long")
    got = TB.fold_versions(rows, TB.COMMIT_KEY, ["extraction_date", "_file", "_pos"]).collect()
    assert [(r.subject, r.author_email, r.lines_added) for r in got] == [("last", "a@x", 10)]


def test_git_log_keeps_long_counts_and_survives_a_body_mark(spark):
    good = "COMMIT|" + "a" * 40 + "|2026-01-01 00:00:00 +0000|n|e|s|BODY||BODYEND|\n1234567890\t9876543210\tf.txt\n-\t-\tb.bin\n"
    rows = spark.createDataFrame([(good,), ("broken line",)], "value string")
    got = {r.hash: r for r in gitlog.parse_records(rows).collect()}
    assert (got["a" * 40].lines_added, got["a" * 40].lines_deleted, got["a" * 40].files_changed) == (1234567890, 9876543210, 1)
    assert got["broken line"]._corrupt


def test_failed_call_clears_model_fields(spark):
    commits = spark.createDataFrame(
        [(1, "h", None, 7, 60, "old", 60), (1, "k", "X", 7, 60, "old", 60)],
        "repository_id int, hash string, category string, ai_confidence smallint, business_impact int, description string, weight int")
    results = spark.createDataFrame(
        [(1, "h", "C", 9, 10, "d", "boom")],
        "repository_id int, hash string, category string, confidence int, business_impact int, description string, error string")
    got = {r.hash: r for r in enrich.merge_enrichment(commits, results).collect()}
    assert (got["h"].category, got["h"].ai_confidence, got["h"].business_impact, got["h"].description) == (None, None, None, None)
    assert (got["k"].ai_confidence, got["k"].description) == (7, "old")
