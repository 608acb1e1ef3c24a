"""Revert weighting: hand-made edge cases and a brute-force check on a whole table."""
import re

from pyspark.sql import functions as F

from commitlens.operators import weights as W
from commitlens.plans import tables

SCHEMA = "repository_id int, hash string, subject string, weight int"


def brute_force(rows, mode="compatible"):
    """The rule written as plain loops: every revert against every commit."""
    weights = {(r[0], r[1]): r[3] for r in rows}
    zero = set()
    for rid, h, subj, _ in rows:
        if not (re.search(r"\brevert\b", subj, re.I) and not re.search(r"\bunrevert\b", subj, re.I)):
            continue
        refs = ["!" + n for n in re.findall(r"\(!([0-9]+)\)", subj)] + ["#" + n for n in re.findall(r"\(#([0-9]+)\)", subj)]
        for ref in dict.fromkeys(refs):
            if mode == "compatible":
                found = [(r, hh) for r, hh, s, _ in rows if r == rid and hh != h and ref in s]
            else:
                found = [(r, hh) for r, hh, s, _ in rows if r == rid and hh != h and ref in re.findall(r"[!#][0-9]+", s)
                         and not re.search(r"\bunrevert\b", s, re.I)]
            if found:
                zero.add((rid, h))
                zero.update(found)
    return {k: (0 if k in zero else w) for k, w in weights.items()}


def run(spark, rows, mode="compatible"):
    df = spark.createDataFrame(rows, SCHEMA)
    out = W.apply_revert_weights(df, mode).collect()
    return {(r["repository_id"], r["hash"]): r["weight"] for r in out}


ROWS = [
    (1, "a", "CS | Move HTML content (!10463)", 100),
    (1, "b", 'Revert "CS | Move HTML content (!10463)"', 100),       # the quoted ref counts
    (1, "m", "Revert bad idea", 100),                                   # revert without number
    (1, "c", 'Revert "CS | Move HTML content (!10463)" (!10662)', 100),
    (1, "d", "Unrevert !10463 and fix error (!10660)", 100),
    (1, "e", "Other (!104)", 60),
    (1, "f", "Revert (!104)", 100),                                    # substring: hits !10463 and !104 ...
    (2, "g", "Same number other repo (!10463)", 100),
    (1, "h", "Revert (!999)", 100),                                     # no original -> stays
    (1, "i", "Reverts (!10463)", 100),                                  # not the word Revert
    (3, "j", "revert lower case (#7)", 100),
    (3, "k", "feature (#7)", 50),
    (3, "l", "feature (#70)", 50),
]


def test_compatible_mode_edge_cases(spark):
    got = run(spark, ROWS)
    assert got == brute_force(ROWS)
    assert got[(1, "d")] == 0          # unrevert zeroed as an original (code behaviour)
    assert got[(2, "g")] == 100        # other repository untouched
    assert got[(1, "h")] == 100        # revert without original keeps its weight
    assert got[(3, "l")] == 0          # (#7) prefixes #70


def test_documented_mode(spark):
    got = run(spark, ROWS, W.DOCUMENTED)
    assert got == brute_force(ROWS, "documented")
    assert got[(1, "d")] == 100 and got[(3, "l")] == 50


def test_whole_table_against_brute_force(spark, sf_small):
    c = tables.loaded_commits(spark, sf_small).select("repository_id", "hash", "subject", "weight")
    rows = [tuple(r) for r in c.collect()]
    assert run(spark, rows) == brute_force(rows)


def test_report_and_plan(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rep = W.weighting_report(df)
    s = rep.summary.first()
    assert s["commits_processed"] == len(ROWS)
    assert s["reverts_found"] == 6
    changed = {(r["repository_id"], r["hash"]): r["reason"] for r in W.weighting_plan(df).collect()}
    assert changed[(1, "c")] == "Revert commit"
    assert changed[(3, "k")] == "Reverted by j"
    assert rep.reverts_without_number.count() == 1
    assert {r["token"] for r in rep.numbers_without_original.collect()} == {"!10662", "!999"}


def test_never_raises_a_weight(spark):
    rows = [(1, "x", "Revert (!5)", 0), (1, "y", "thing (!5)", 30)]
    got = run(spark, rows)
    assert got == {(1, "x"): 0, (1, "y"): 0}


def test_whole_table_equals_brute_force(spark, sf_small):
    c = tables.loaded_commits(spark, sf_small).select("repository_id", "hash", "subject", "weight")
    rows = [tuple(r) for r in c.collect()]
    assert run(spark, rows) == brute_force(rows)


def test_hot_token_is_zeroed_without_pairs(spark):
    """1,000 reverts of a number that 100,000 commits carry: 100 million pairs if they were listed."""
    i = F.col("id")
    df = spark.range(101_000).select(
        F.lit(1).alias("repository_id"), F.md5(i.cast("string")).alias("hash"),
        F.when(i < 1000, F.lit("Revert (#1)")).otherwise(F.concat(F.lit("work (#1"), i.cast("string"), F.lit(")"))).alias("subject"),
        F.lit(100).alias("weight"))
    assert W.apply_revert_weights(df).agg(F.sum("weight")).first()[0] == 0
    assert W.zeroed_keys(df).count() == 101_000


def test_building_runs_no_job(spark, sf_small):
    from commitlens.operators import views as V

    def build():
        return V.monthly_stats_by_repo(V.active(tables.commits(spark, sf_small)), tables.repositories(spark, sf_small))

    build()  # reads the footers of the tables
    spark.sparkContext.setJobGroup("building", "building a query")
    build()
    try:
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_long_run_of_digits_gives_few_tokens(spark):
    import time

    from pyspark.sql import functions as F

    from commitlens.operators import weights as W
    long = "9" * 20_000
    rows = [(1, f"{i:040x}", s) for i, s in enumerate([f"!{long} base", "x !99 y", 'Revert "x" (!99)', f"revert (!{long[:500]})", "other #99", "Revert (#9)"])]
    df = spark.createDataFrame(rows, "repository_id int, hash string, subject string")
    begun = time.time()
    size = W.original_tokens(df).agg(F.sum(F.length("token"))).first()[0]
    assert size < 2000 and time.time() - begun < 30
    got = sorted((int(r.revert_hash, 16), int(r.original_hash, 16)) for r in W.revert_matches(df).collect())
    want = sorted((i, j) for i, t in ((2, "!99"), (3, f"!{long[:500]}"), (5, "#9")) for j, r in enumerate(rows) if i != j and t in r[2])
    assert got == want
    assert {int(r.hash, 16) for r in W.zeroed_keys(df).collect()} == {x for pair in want for x in pair}
