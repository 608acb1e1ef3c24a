"""Each step of a load derives its input once; documents of many repositories, with equal commits and without a name."""
import datetime as dt
import json

from commitlens import schema as S
from commitlens.functions import text
from commitlens.plans import orchestration as O
from commitlens.plans.snapshots import Snapshots
from commitlens.sources import exports as X


def counted(spark, rows, schema):
    """A frame and the number of times that its rows were derived."""
    seen = spark.sparkContext.accumulator(0)

    def note(row):
        seen.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(note), schema), seen


EXPORTED = "repository string, repository_path string, repository_description string, extraction_date string, hash string, date string, " \
           "author_name string, author_email string, subject string, weight int, ai_tools string, category string, ai_confidence int, " \
           "business_impact int, description string, lines_added int, lines_deleted int, files_changed int"


def exported(repository, n, date="2025-03-01T08:00:00+00:00", subject='API | "x"\n    },\n    {\n'):
    return (repository, f"/srv/{repository}", None, "2025-04-01T00:00:00+00:00", f"{n:040x}", date, "Ida \u00d8", "ida@holm.example", subject,
            None, None, "API", 7, None, None, n, 0, 1)


def test_documents_derive_their_rows_once(spark, tmp_path):
    names = [f"r{k}" for k in range(9)]  # more than there are shuffle partitions
    given = [exported(r, n) for k, r in enumerate(names) for n in range(k + 1)] + [exported("r8", 3)] * 3 + [exported("r8", 5, None)] * 2
    rows, seen = counted(spark, given + [exported(None, 1)] * 3, EXPORTED)
    X.write_export_documents(rows, str(tmp_path / "out"))
    assert seen.value == len(given) + 3
    docs = {}
    for r in names:
        (one,) = (tmp_path / "out" / f"folder={r}").glob("*.txt")
        docs[r] = json.loads(one.read_text())
        assert one.read_text() == json.dumps(docs[r], indent=2, ensure_ascii=False) + "\n"
        keys = ["|".join(c[n] for n in ("date", "hash") if c[n] is not None) for c in docs[r]["commits"]]
        assert keys == sorted(keys) and docs[r]["summary"]["total_commits"] == len(keys)
    assert [len(docs[r]["commits"]) for r in names] == [1, 2, 3, 4, 5, 6, 7, 8, 14]
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    staged = X.read_export_documents(spark, str(tmp_path / "out"))
    assert X.export_commits(staged).count() == len(given)
    assert [r.unparseable for r in X.invalid_documents(staged).collect()] == [True]  # rows without a repository


def test_a_load_derives_its_rows_once(spark, tmp_path):
    at = dt.datetime(2025, 3, 1)
    subjects = ["API | one (!1)", 'Revert "API | one (!1)" (!2)', "API | three"]
    given = [(1, f"{n:040x}", at, "Ida", "ida@holm.example", s, 1, 1, 1, at, "API", 100, None, None, None, None, at, "f", 0, n) for n, s in enumerate(subjects)]
    names = [c for c in S.COMMIT_COLUMNS if c != "id"]
    schema = ", ".join(f"{n} {S.COMMITS_SCHEMA[n].dataType.simpleString()}" for n in names) + ", extracted_at timestamp, _file string, _block long, _pos long"
    source, seen = counted(spark, given, schema)
    loaded = spark.createDataFrame([(1,)], "repository_id int")
    folded = O.fold_exports(spark.createDataFrame([], S.COMMITS_SCHEMA), source, loaded, str(tmp_path / "folded"))
    got = sorted((r.id, r.hash[-1], r.weight, r._action, r._changed) for r in folded.collect())
    assert got == [(1, "0", 0, "inserted", True), (2, "1", 0, "inserted", True), (3, "2", 100, "inserted", True)]
    assert seen.value == len(given)


def test_a_refresh_looks_for_its_months_once(spark, tmp_path):
    at = dt.datetime(2025, 3, 1)
    commits, seen = counted(spark, [(n, 1, f"{n:040x}", at, "Ida", "ida@holm.example", "API | x", 1, 1, 1, at, "API", 100, None, None, None, None) for n in range(1, 5)], S.COMMITS_SCHEMA)
    store = Snapshots(spark, str(tmp_path / "mv"))
    names = store.refresh(commits, spark.createDataFrame([(1, "one", None, None, None, None, None)], S.REPOSITORIES_SCHEMA))
    assert len(names) == 4 and seen.value == 4 * (len(names) + 1)  # each snapshot, and the months
    assert [(str(r.month_start_date), r.total_commits) for r in store.read(names[0]).collect()] == [("2025-03-01", 4)]


def test_dates_of_each_form(spark):
    given = ["2024-11-12 10:30:00 +0100", " 2024-11-12T10:30:00+01:00\n", "2024-11-12t10:30:00Z", "2024-11-12T10:30:00", "2024-11-12 10:30:00", "T", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "n int, x string")
    got = [r.t and str(r.t) for r in df.select("n", text.parse_git_date("x").alias("t")).orderBy("n").collect()]
    assert got == ["2024-11-12 09:30:00", "2024-11-12 09:30:00", "2024-11-12 10:30:00", "2024-11-12 10:30:00", None, None, None, None]
