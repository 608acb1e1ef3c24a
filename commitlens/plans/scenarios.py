"""Operator scenarios built from the driver tables (Spark side).

Each function returns the DataFrame a registered query shows for one operator
of the inventory: text rules over every subject and body, weighting variants,
an incremental load (upsert) between two date windows of the commit history,
repository loading, deletion, the constraint audit and model enrichment with a
deterministic response text derived from each commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapter
from .. import schema as S
from ..functions import text
from ..operators import enrich as E
from ..operators import table as TB
from ..operators import views as V
from ..operators import weights as W
from .tables import commits as weighted_commits
from .tables import loaded_commits, repositories, subjects

# Fixed scenario parameters.
TABLE_UNTIL = "2000-01-01"      # the stored table holds commits before this date
EXPORT_FROM = "1999-07-01"      # the new export covers commits from this date
EXTRACTED_AT = "2001-08-02 00:00:00"
CLEANED_REPOSITORY = "NATION_7"


# ------------------------------------------------------------ text rules --
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3 for every subject: candidate, validity, reason, category."""
    m = text.add_category_candidate(adapter.commit_messages(spark, sf_dir).select("id", "subject"))
    return m.select("id", "subject", "candidate",
                    text.is_valid_category("candidate").alias("is_valid"),
                    text.category_rejection_reason("candidate").alias("reason"),
                    F.when(text.is_valid_category("candidate"), F.col("candidate")).alias("category"))


def category_quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: how many subjects fail each validation rule."""
    m = text.add_category_candidate(adapter.commit_messages(spark, sf_dir).select("subject"))
    reason = text.category_rejection_reason("candidate")
    return m.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("commits"))


def tool_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 for every body."""
    m = adapter.commit_messages(spark, sf_dir).select("id", "body")
    return text.add_ai_tools(m, "body", "ai_tools")


def tool_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listed tool name with its normalised name and count."""
    m = adapter.commit_messages(spark, sf_dir)
    listed = text.strip(F.regexp_extract("body", text.AI_TOOLS_MARKER, 1))
    names = m.select(F.explode(F.split(listed, text.TOOL_SPLIT)).alias("raw"))
    names = names.select(text.strip("raw").alias("tool")).where(F.col("tool") != "")
    return (names.groupBy("tool").agg(F.count(F.lit(1)).alias("occurrences"))
            .select("tool", text.normalize_tool_name("tool").alias("tool_name"), "occurrences"))


def reference_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 and P13 for every subject."""
    m = adapter.commit_messages(spark, sf_dir)
    return m.select("id", "subject", text.is_revert("subject").alias("is_revert"),
                    F.array_join(text.pr_references("subject"), ",").alias("references"))


def repository_names_from_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 over every page URL, in three spellings (as is, ``.git``, trailing ``/``)."""
    p = adapter.read_table(spark, sf_dir, "pages").select("page_id", "url")
    forms = F.array(F.col("url"), F.concat(F.col("url"), F.lit(".git")), F.concat(F.col("url"), F.lit(".git/")))
    x = p.select("page_id", F.posexplode(forms).alias("form", "location"))
    return x.select("page_id", "form", "location", text.repository_name_from_url("location").alias("name"))


def git_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Git-style date text (with a +01:00 offset) -> UTC timestamp and ISO text."""
    o = adapter.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    t = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100"))
    x = o.select(F.col("o_orderkey").alias("id"), t.alias("git_date"))
    return x.select("id", "git_date", text.parse_git_date("git_date").alias("commit_date"),
                    text.iso_date_text("git_date").alias("iso_date"))


def diff_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10 over every document text taken as a diff."""
    d = adapter.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept, truncated = text.truncate_diff("text", S.DIFF_MAX_BYTES)
    return d.select("doc_id", F.octet_length(F.encode("text", "UTF-8")).alias("diff_bytes"),
                    F.octet_length(kept).alias("kept_bytes"), truncated.alias("truncated"),
                    F.md5(kept).alias("kept_md5"))


# -------------------------------------------------------------- weighting -
def revert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.revert_matches(subjects(spark, sf_dir))


def zeroed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.zeroed_keys(subjects(spark, sf_dir))


def weights_after(spark: SparkSession, sf_dir: str, mode: str = W.COMPATIBLE) -> DataFrame:
    c = weighted_commits(spark, sf_dir, mode)
    return c.select("repository_id", "hash", "weight")


def weights_one_repository(spark: SparkSession, sf_dir: str, name: str = CLEANED_REPOSITORY) -> DataFrame:
    """Weighting limited to one repository; the others keep their weights."""
    r = repositories(spark, sf_dir).where(F.col("name") == name).select(F.col("id").alias("repository_id"))
    c = W.apply_revert_weights(loaded_commits(spark, sf_dir), repository_ids=r, subjects=subjects(spark, sf_dir))
    return c.select("repository_id", "hash", "weight")


def weighting_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.weighting_plan(adapter.commit_messages(spark, sf_dir))


def weighting_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.weighting_report(adapter.commit_messages(spark, sf_dir)).summary


def reverts_without_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4's other warning.  Every 13th commit here is a revert that names no number."""
    c = loaded_commits(spark, sf_dir)
    bare = F.when(F.col("id") % 13 == 0, F.concat(F.lit("revert "), F.coalesce("category", F.lit("work")))).otherwise(F.col("subject"))
    return W.weighting_report(c.withColumn("subject", bare)).reverts_without_number


def weighting_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.weighting_report(adapter.commit_messages(spark, sf_dir)).numbers_without_original


# ----------------------------------------------------------- loading -------
def export_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a new export in file order (``_pos``): commits from
    ``EXPORT_FROM`` on.  Commits already in the table were re-extracted with new
    enrichment; their stale earlier version also appears, at a lower position.
    Both versions come out of one pass (an array of row structs, exploded)."""
    c = loaded_commits(spark, sf_dir).where(F.col("commit_date") >= F.lit(EXPORT_FROM).cast("timestamp"))
    again = F.col("commit_date") < F.lit(TABLE_UNTIL).cast("timestamp")
    same = ["repository_id", "hash", "commit_date", "author_name", "author_email"]
    fresh = F.struct(
        *same,
        F.when(again, F.concat(F.col("subject"), F.lit(" v2"))).otherwise(F.col("subject")).alias("subject"),
        F.when(again, F.lit(999999)).otherwise(F.col("lines_added")).alias("lines_added"),
        "lines_deleted", "files_changed",
        F.when(again, F.lit(None).cast("string")).otherwise(F.col("category")).alias("category"),
        F.when(again, F.lit(70)).otherwise(F.col("weight")).alias("weight"),
        F.when(again, F.lit(None).cast("string")).otherwise(F.col("ai_tools")).alias("ai_tools"),
        F.when(again, F.lit(77).cast("smallint")).otherwise(F.col("ai_confidence")).alias("ai_confidence"),
        F.when(again, F.lit("re-extracted")).otherwise(F.col("description")).alias("description"),
        F.when(again, F.lit(70)).otherwise(F.col("business_impact")).alias("business_impact"),
        F.lit(1).alias("_pos"))
    stale = F.struct(*same, "subject", "lines_added", "lines_deleted", "files_changed", "category", "weight",
                     "ai_tools", "ai_confidence", "description", "business_impact", F.lit(0).alias("_pos"))
    versions = F.when(again, F.array(fresh, stale)).otherwise(F.array(fresh))
    return c.select(F.explode(versions).alias("v")).select("v.*")


def export_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last whole row per key within the export."""
    return TB.latest_per_key(export_versions(spark, sf_dir), TB.COMMIT_KEY)


def new_key_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export in two files that holds every key twice, both files' rows in either order of position; the
    second one differs in every column.  The kept columns come from the first file, the updated ones from the second."""
    c = loaded_commits(spark, sf_dir)
    other = {"commit_date": F.col("commit_date") + F.expr("interval 1 day"), "author_name": F.concat(F.lit("Co-"), "author_name"),
             "author_email": F.concat(F.lit("co-"), "author_email"), "subject": F.concat("subject", F.lit(" v2")),
             "lines_added": F.col("lines_added") + 1, "lines_deleted": F.col("lines_deleted") + 2, "files_changed": F.col("files_changed") + 3,
             "weight": F.lit(70), "category": F.lit(None).cast("string"), "ai_tools": F.lit(None).cast("string"),
             "ai_confidence": F.lit(77).cast("smallint"), "description": F.lit("re-extracted"), "business_impact": F.lit(70)}
    row = lambda file, pos, own: F.struct(*[own.get(n, F.col(n)).alias(n) for n in [*TB.COMMIT_KEY, *S.UPSERT_KEPT, *S.UPSERT_UPDATED]],
                                          F.lit(file).alias("_file"), pos.alias("_pos"))
    both = F.array(row("f2", F.col("id") % 2, other), row("f1", 1 - F.col("id") % 2, {}))
    rows = c.select(F.explode(both).alias("v")).select("v.*")
    return TB.fold_versions(rows, TB.COMMIT_KEY, ["_file", "_pos"])


def stored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_commits(spark, sf_dir).where(F.col("commit_date") < F.lit(TABLE_UNTIL).cast("timestamp"))


def load_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rows and the export's, from one pass over the commits (as ``TB.versions`` of two tables gives)."""
    c = loaded_commits(spark, sf_dir)
    until, since = (F.lit(d).cast("timestamp") for d in (TABLE_UNTIL, EXPORT_FROM))
    stored, exported = F.col("commit_date") < until, F.col("commit_date") >= since
    again = {"subject": F.concat("subject", F.lit(" v2")), "lines_added": F.lit(999999), "category": F.lit(None).cast("string"),
             "weight": F.lit(70), "ai_tools": F.lit(None).cast("string"), "ai_confidence": F.lit(77).cast("smallint"),
             "description": F.lit("re-extracted"), "business_impact": F.lit(70)}
    unset = {"id": F.lit(None).cast("long"), "created_at": F.lit(None).cast("timestamp")}
    row = lambda side, pos, own: F.struct(*[own.get(n, F.col(n)).alias(n) for n in S.COMMIT_COLUMNS],
                                          F.lit(side).alias(TB.SIDE), F.lit(pos).alias("_pos"))
    old, stale, fresh, new = row(0, None, {}), row(1, 0, unset), row(1, 1, unset | again), row(1, 1, unset)
    rows = (F.when(stored & exported, F.array(old, fresh, stale)).when(stored, F.array(old)).otherwise(F.array(new)))
    return c.where(stored | exported).select(F.explode(rows).alias("v")).select("v.*")


def merged_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = adapter.commit_messages(spark, sf_dir)
    stored = F.col("commit_date") < F.lit(TABLE_UNTIL).cast("timestamp")
    keys = c.select("repository_id", "hash", F.when(stored, F.col("id")).alias("id"))  # the text rules stay out
    return TB.merge_versions(load_versions(spark, sf_dir), ["_pos"], keys)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after folding in the export (ids for new rows assigned)."""
    return merged_load(spark, sf_dir).withColumnRenamed(TB.ACTION, "load_action")


def load_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.load_statistics(merged_load(spark, sf_dir))


def repositories_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories named by the new export.  Every repository with commits
    in the export window is known (updated); the market segments of the window's
    orders arrive as new repositories (created)."""
    window = F.col("commit_date") >= F.lit(EXPORT_FROM).cast("timestamp")
    known = (loaded_commits(spark, sf_dir).where(window).select("repository_id").distinct()
             .join(V.repo_names(repositories(spark, sf_dir)), "repository_id")
             .select(F.col("repository_name").alias("name")))
    orders = adapter.read_table(spark, sf_dir, "orders").where(
        F.col("o_orderdate").cast("timestamp") >= F.lit(EXPORT_FROM).cast("timestamp")).select("o_custkey")
    customers = adapter.read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    segments = (orders.join(customers, orders.o_custkey == customers.c_custkey)
                .select(F.concat(F.lit("segment-"), F.lower("c_mktsegment")).alias("name")).distinct())
    incoming = known.unionByName(segments).select(
        "name", F.concat(F.lit("/srv/git/"), F.col("name")).alias("url"),
        F.concat(F.lit("Repository "), F.col("name")).alias("description"))
    out = TB.load_repositories(repositories(spark, sf_dir), incoming, EXTRACTED_AT)
    return out.withColumnRenamed(TB.ACTION, "load_action")


def after_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, commits left after cleaning one repository."""
    kept, repos = TB.delete_repository(weighted_commits(spark, sf_dir), repositories(spark, sf_dir),
                                       CLEANED_REPOSITORY)
    counts = kept.groupBy("repository_id").agg(F.count(F.lit(1)).alias("commits"))
    return (repos.join(counts, repos.id == counts.repository_id, "left")
            .select("id", "name", "last_extracted_at", F.coalesce(F.col("commits"), F.lit(0)).alias("commits")))


def cleanup_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TB.deletion_preview(weighted_commits(spark, sf_dir), repositories(spark, sf_dir), CLEANED_REPOSITORY)


def orphan_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits left without a repository once a repository row is dropped alone."""
    repos = repositories(spark, sf_dir).where(F.col("name") != CLEANED_REPOSITORY)
    c = weighted_commits(spark, sf_dir)
    return c.join(repos.select(F.col("id").alias("repository_id")), "repository_id", "left_anti") \
            .select("repository_id", "hash")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 over the table produced by the incremental load."""
    merged = merged_load(spark, sf_dir).drop(TB.ACTION)
    return TB.constraint_audit(merged, repositories(spark, sf_dir))


def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary block of each repository's export."""
    c = loaded_commits(spark, sf_dir)
    g = c.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.sum(F.col("lines_added").cast("long")).alias("total_lines_added"),
        F.sum(F.col("lines_deleted").cast("long")).alias("total_lines_deleted"),
        F.sum(F.col("files_changed").cast("long")).alias("total_files_changed"),
        F.countDistinct("author_email").alias("unique_authors"))
    return g.join(V.repo_names(repositories(spark, sf_dir)), "repository_id").select(
        F.col("repository_name").alias("repository"), "total_commits", "total_lines_added",
        "total_lines_deleted", "total_files_changed", "unique_authors")


# ------------------------------------------------------------ enrichment --
def stub_response(c) -> F.Column:
    """A deterministic model answer per commit, covering the parser's cases."""
    k = F.col("id")
    cat = (F.when(k % 5 == 0, F.lit("billing")).when(k % 5 == 1, F.lit("Api Gateway"))
           .when(k % 5 == 2, F.lit("2.58.0")).when(k % 5 == 3, F.lit("#123")).otherwise(F.lit("INFRA")))
    cat_line = F.when(k % 7 == 0, F.lit("NOTE: none\n")).otherwise(F.concat(F.lit("CATEGORY: "), cat, F.lit("\n")))
    conf_key = F.when(k % 17 == 0, F.lit("confidence: ")).otherwise(F.lit("CONFIDENCE: "))
    conf_line = F.when(k % 11 == 0, F.lit("")).otherwise(
        F.concat(conf_key, (k % 150).cast("string"), F.lit("\n")))
    impact_line = F.when(k % 13 == 0, F.lit("")).otherwise(
        F.concat(F.lit("business_impact: "), (k % 120).cast("string"), F.lit("\n")))
    return F.concat(cat_line, conf_line, impact_line,
                    F.lit("REASON: matches "), F.col("subject"), F.lit("\n"),
                    F.lit("DESCRIPTION: Touches "), F.col("files_changed").cast("string"),
                    F.lit(" files.\nSecond line."))


def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 over one answer per commit that has a diff."""
    c = loaded_commits(spark, sf_dir).where(F.col("files_changed") > 0)
    p = c.select("repository_id", "hash", parse_response_col(stub_response(c)))
    return p.select("repository_id", "hash", "p.*")


def parse_response_col(response) -> F.Column:
    return E.parse_response(response).alias("p")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits merged with the parsed answers."""
    return E.merge_enrichment(loaded_commits(spark, sf_dir), parsed_responses(spark, sf_dir))


def category_weights(commits: DataFrame) -> DataFrame:
    """A category table derived from usage; names of an odd length are not listed."""
    g = commits.where(F.col("category").isNotNull()).groupBy(F.col("category").alias("name")).agg(
        F.count(F.lit(1)).alias("n"))
    return g.where(F.length("name") % 2 == 0).select("name", (F.lit(50) + F.col("n") % 51).cast("int").alias("weight"))


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the rows an export writes (line form), for every loaded commit."""
    from ..sources import exports as X
    return X.export_rows(loaded_commits(spark, sf_dir), repositories(spark, sf_dir), EXTRACTED_AT)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every commit, with its repository's category vocabulary."""
    from .queries import vocabulary_lists
    c = loaded_commits(spark, sf_dir)
    j = c.join(vocabulary_lists(c), "repository_id", "left")
    none = F.lit(None).cast("array<string>")
    return j.select("repository_id", "hash", E.prompt_text(
        "subject", "hash", none, F.lit(None).cast("string"), F.lit(False), "categories").alias("prompt"))


#: Fixed values of the scenario: instructions and the bound of a diff.
INSTRUCTIONS = "Name the category."


def prompts_with_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 with files and T10: each document is a diff, cut at ``DIFF_MAX_BYTES``, of two files; its source's languages are
    the category vocabulary."""
    d = adapter.read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    known = d.groupBy("source").agg(F.sort_array(F.collect_set(F.upper("lang"))).alias("categories"))  # a few languages
    files = F.array(F.concat("lang", F.lit("/"), "source", F.lit(".txt")), F.lit("README"))
    _, truncated = text.truncate_diff("text", S.DIFF_MAX_BYTES)
    prompt = E.prompt_text(F.concat(F.lit("Change "), F.col("doc_id").cast("string")), F.md5(F.col("doc_id").cast("string")),
                           files, text.truncate_diff_text("text", S.DIFF_MAX_BYTES), truncated, "categories", INSTRUCTIONS)
    rows = d.join(known, "source", "left").select("doc_id", truncated.alias("truncated"), prompt.alias("prompt"))
    return rows.select("doc_id", "truncated", F.octet_length("prompt").alias("prompt_bytes"), F.md5("prompt").alias("prompt_md5"))


def model_answer(prompt: str) -> str:
    """A deterministic model that answers by the commit's hash; one in seven calls fails, one answer in seven is invalid."""
    digest = prompt.split("- Hash: ", 1)[1][:32]
    n = int(digest[:4], 16)
    if n % 7 == 0:
        raise ValueError(f"no answer for {digest[:4]}")
    name = str(n) if n % 7 == 1 else f"AREA {n % 5}"
    return f"CATEGORY: {name}\nCONFIDENCE: {n % 120}\nBUSINESS_IMPACT: {n % 90}\nREASON: by hash\nDESCRIPTION: Answer {n}."


def model_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 -> X1 -> T12 -> T13 for the commits that change files."""
    c = loaded_commits(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    ask = c.where(F.col("files_changed") > 0).select("repository_id", "hash", E.prompt_text(
        "subject", "hash", none, F.lit(None).cast("string"), F.lit(False), none, INSTRUCTIONS).alias("prompt"))
    out = E.enrich(c, ask, model_answer, backoff_base=0.0)
    return out.select("repository_id", "hash", "category", "weight", "ai_confidence", "business_impact", "description")


def event_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q25 on event timestamps (orders carry no time of day): events per ISO
    weekday and hour, every event counted as active work."""
    from .queries import activity_by_weekday_hour
    ev = adapter.read_table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("commit_date"), F.lit(100).alias("weight"))
    return activity_by_weekday_hour(ev)
