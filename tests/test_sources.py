"""Export documents, git log dumps and the repository list."""
import json

from commitlens.sources import config as CF
from commitlens.sources import exports as X
from commitlens.sources import gitlog as G

DOC = {
    "repository": "harbour", "repository_path": "/srv/git/harbour",
    "extraction_date": "2025-02-03T06:30:00+00:00",
    "summary": {"total_commits": 2},
    "commits": [
        {"hash": "a" * 40, "date": "2025-01-07T21:15:00+00:00", "author_name": "Mia Kern",
         "author_email": "mia@kern.example", "subject": "DOCK | cranes", "lines_added": 12, "lines_deleted": 7,
         "files_changed": 1, "files": [{"filename": "crane.py", "added": 12, "deleted": 7}]},
        {"hash": "b" * 40, "date": "2025-01-19T04:45:00+00:00", "author_name": "Mia Kern",
         "author_email": "mia@kern.example", "subject": "DOCK | ropes", "lines_added": 3, "lines_deleted": 0,
         "files_changed": 2, "weight": 40},
    ],
}


def test_read_export_documents(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps(DOC, indent=2))
    (tmp_path / "missing.json").write_text(json.dumps({"repository": "x"}, indent=2))
    (tmp_path / "broken.json").write_text("{not json")
    docs = X.read_export_documents(spark, str(tmp_path))
    commits = X.export_commits(docs).orderBy("_pos").collect()
    assert [c["hash"][0] for c in commits] == ["a", "b"]
    assert [c["weight"] for c in commits] == [100, 40]
    assert commits[0]["commit_date"].isoformat() == "2025-01-07T21:15:00"
    bad = {r["_file"].rsplit("/", 1)[-1]: r for r in X.invalid_documents(docs).collect()}
    assert set(bad) == {"missing.json", "broken.json"}
    assert bad["missing.json"]["missing_keys"] == ["commits"]
    repos = X.export_repositories(docs).collect()
    assert [(r["name"], r["url"]) for r in repos] == [("harbour", "/srv/git/harbour")]


LOG = (
    "COMMIT|" + "1" * 40 + "|2025-01-05 07:20:00 +0000|Jon Falk|jon@falk.example|Lay out the yard|BODY||BODYEND|\n"
    "8\t0\tyard.md\n\n"
    "COMMIT|" + "2" * 40 + "|2025-01-06 09:40:00 +0200|Jon Falk|jon@falk.example|FLEET | Count | berths|BODY|"
    "per pier|and per quay\n**AI tool: Claude Code and Copilot**\nBODYEND|\n"
    "6\t2\tberths.py\n-\t-\tmap.png\n\n"
    "COMMIT|" + "3" * 40 + "|2025-01-08 23:05:00 +0000|Jon Falk|jon@falk.example|"
    'Revert "FLEET | Paint hulls (!77)" (!91)|BODY||BODYEND|\n'
    "5\t0\thulls.py\n0\t4\tberths.py\n\n"
    "COMMIT|" + "4" * 40 + "|last spring|Jon Falk|jon@falk.example|Merge the north pier|BODY||BODYEND|\n"
)


def test_read_git_log(spark, tmp_path):
    p = tmp_path / "repo.log"
    p.write_text(LOG)
    rows = {r["hash"][0]: r for r in G.read_git_log(spark, str(p), "demo").collect()}
    assert len(rows) == 4
    assert (rows["1"]["lines_added"], rows["1"]["files_changed"]) == (8, 1)
    two = rows["2"]
    assert two["subject"] == "FLEET | Count | berths" and two["category"] == "FLEET"
    assert (two["lines_added"], two["lines_deleted"], two["files_changed"]) == (6, 2, 1)        # binary line ignored
    assert two["body"].startswith("per pier\nand per quay\n") and two["ai_tools"] == "CLAUDE CODE, GITHUB COPILOT"
    assert two["commit_date"].isoformat() == "2025-01-06T07:40:00"
    assert rows["3"]["subject"] == 'Revert "FLEET | Paint hulls (!77)" (!91)'
    assert (rows["3"]["lines_added"], rows["3"]["lines_deleted"], rows["3"]["files_changed"]) == (5, 4, 2)
    four = rows["4"]
    assert (four["commit_date"], four["iso_date"], four["files_changed"]) == (None, "last spring", 0)
    assert not any(r["_corrupt"] for r in rows.values())


def test_repository_config(spark, tmp_path):
    cfg = {"repositories": [
        {"name": "harbour", "path": "/srv/git/harbour", "description": "Berths and cranes", "enabled": True},
        {"name": "ferry", "path": "~/ferry", "description": "Timetables", "enabled": True},
        {"name": "museum", "path": "/srv/git/museum", "description": "Old ships", "enabled": False}]}
    p = tmp_path / "repos.json"
    p.write_text(json.dumps(cfg, indent=2))
    conf = CF.read_repository_config(spark, str(p))
    assert CF.select_repositories(conf).count() == 2
    assert CF.select_repositories(conf, "ferry").count() == 1
    try:
        CF.select_repositories(conf, "nope")
        raise AssertionError("expected an error")
    except ValueError as exc:
        assert "ferry, harbour, museum" in str(exc)


def test_write_and_read_export_lines(spark, sf_small, tmp_path):
    from commitlens.plans import tables
    rows = X.export_rows(tables.loaded_commits(spark, sf_small), tables.repositories(spark, sf_small),
                         "2024-10-05T12:00:00+00:00")
    X.write_exports(rows, str(tmp_path / "out"))
    back = X.read_export_lines(spark, str(tmp_path / "out" / "commits"))
    assert back.count() == rows.count()
    assert back.where("commit_date IS NULL").count() == 0
    summary = spark.read.json(str(tmp_path / "out" / "_summary"))
    assert summary.agg({"total_commits": "sum"}).first()[0] == rows.count()


def log_record(n, subject, body=("",), stats=(), closed=True):
    head = f"COMMIT|{n:040x}|2025-02-0{n % 9 + 1} 08:00:00 +0000|Mia Kern|mia@kern.example|{subject}|BODY|"
    return head + "\n".join(body) + ("|BODYEND|\n" if closed and body == ("",) else "\nBODYEND|\n" if closed else "\n") + "".join(f"{s}\n" for s in stats) + "\n"


def test_git_log_puts_cut_records_together(spark, tmp_path):
    cut = ("first line", "COMMIT|not a commit", "COMMIT|twice over", "**AI tool: Cursor**")
    dump = [log_record(1, "API | one", stats=["1\t2\ta.txt"]), log_record(2, "API | two", cut, ["9999999999\t3\tb.txt", "-\t-\tc.png"]),
            log_record(3, "API | three", ("plain", "COMMIT|" + "f" * 39 + "|x"), ["4\t0\td.txt"]), "COMMIT|stray|after a closed body\n\n", log_record(4, "API | four")]
    (tmp_path / "a.log").write_text("".join(dump))
    (tmp_path / "b.log").write_text("COMMIT|leading stray\n\n" + log_record(5, "API | five", stats=["7\t7\te.txt"]))
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    expected = {1: ("", 1, 2, 1), 2: ("\n".join(cut), 9999999999, 3, 1), 3: ("plain\nCOMMIT|" + "f" * 39 + "|x", 4, 0, 1), 4: ("", 0, 0, 0), 5: ("", 7, 7, 1)}
    try:
        for split in ("60", "150", "400", default):  # cuts fall into other splits than their records
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            commits, rejected = G.git_log(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")])
            got = {int(r.hash, 16): (r.body, r.lines_added, r.lines_deleted, r.files_changed) for r in commits.collect()}
            assert got == expected, split
            assert sorted(r.value.split("\n")[0] for r in rejected.collect()) == ["COMMIT|leading stray", "stray|after a closed body"]
            assert [r.ai_tools for r in commits.where("ai_tools is not null").collect()] == ["CURSOR"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_documents_of_any_size_and_layout(spark, tmp_path):
    commits = [{"hash": f"{i:040x}", "date": "2025-03-01T08:00:00+00:00", "author_name": 'Mia "K" Kern', "author_email": "mia@kern.example",
                "subject": f"API | {i}\n    }},\n    {{\n", "lines_added": i, "lines_deleted": 0, "files_changed": 1,
                "files": [{"filename": "a", "added": i, "deleted": 0}, {"filename": "b", "added": 0, "deleted": 0}]} for i in range(300)]
    head = {"repository": "big", "repository_path": "/srv/big", "extraction_date": "2025-03-02T00:00:00+00:00", "date_range": {"from": "2025-01-01", "to": None}}
    (tmp_path / "pretty.json").write_text(json.dumps(head | {"commits": commits}, indent=2))
    (tmp_path / "last.json").write_text(json.dumps({"commits": commits[:5], **head, "repository": "tail"}, indent=2) + "\n")
    (tmp_path / "compact.json").write_text(json.dumps(head | {"repository": "flat", "commits": commits[:7]}))
    (tmp_path / "empty.json").write_text(json.dumps(head | {"repository": "empty", "commits": []}, indent=2))
    (tmp_path / "torn.json").write_text(json.dumps(head | {"repository": "torn", "commits": commits}, indent=2)[:9000])
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("4000", default):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            staged = X.read_export_documents(spark, str(tmp_path))
            rows = X.export_commits(staged).orderBy("_file", "_block", "_pos").collect()
            by = {n: [r.hash for r in rows if r.repository == n] for n in ("big", "tail", "flat")}
            assert by == {n: [c["hash"] for c in commits[:k]] for n, k in (("big", 300), ("tail", 5), ("flat", 7))} and len(rows) == 312
            assert {(r.repository_path, str(r.extracted_at), len(r.files), r.weight) for r in rows} == {("/srv/big", "2025-03-02 00:00:00", 2, 100)}
            assert sorted(r.name for r in X.export_repositories(staged).collect()) == ["big", "empty", "flat", "tail"]
            assert [(r._file.rsplit("/", 1)[-1], r.unparseable) for r in X.invalid_documents(staged).collect()] == [("torn.json", True)]
            if split == "4000":
                assert spark.read.option("lineSep", X.ELEMENT_BOUNDARY).text(str(tmp_path / "pretty.json")).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_write_and_read_export_documents(spark, sf_small, tmp_path):
    from commitlens.plans import tables
    files = [("a.py", 3, 1), ('b "x".py', 0, 0)]
    commits = tables.loaded_commits(spark, sf_small).selectExpr("*", "CASE WHEN id % 2 = 0 THEN array(named_struct('filename','a.py','added',3,'deleted',1),"
                                                                "named_struct('filename','b \"x\".py','added',0,'deleted',0)) END AS files")
    rows = X.export_rows(commits, tables.repositories(spark, sf_small), "2025-03-02T00:00:00+00:00")
    X.write_export_documents(rows, str(tmp_path / "out"), ("2025-01-01", None))
    found = sorted((tmp_path / "out").glob("folder=*/*.txt"))
    docs = [json.loads(p.read_text()) for p in found]
    assert {len(list((tmp_path / "out").glob(f"folder={d['repository']}/*.txt"))) for d in docs} == {1}
    assert sum(len(d["commits"]) for d in docs) == rows.count() and docs[0]["date_range"] == {"from": "2025-01-01", "to": None}
    for p, d in zip(found, docs):
        assert p.read_text() == json.dumps(d, indent=2, ensure_ascii=False) + "\n"
        assert d["summary"]["total_commits"] == len(d["commits"]) and d["summary"]["unique_authors"] == len({c["author_email"] for c in d["commits"]})
    assert [tuple(f.values()) for d in docs for c in d["commits"] for f in c["files"]][:2] == files
    back = X.export_commits(X.read_export_documents(spark, str(tmp_path / "out")))
    same = ["repository", "hash", "date", "subject", "weight", "category", "ai_tools", "ai_confidence", "lines_added"]
    assert back.select(same).exceptAll(rows.select(same)).count() == 0 and back.count() == rows.count()
