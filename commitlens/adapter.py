"""Driver tables -> ``repositories`` and ``commits`` (the test adapter).

One order is one commit; nations are repositories.  Line items give the line
and file counts, the customer's market segment feeds the subject, and the
order priority picks a commit body for tool extraction.  Category and tools
are *derived* with the engine's own text operators (T1, T5), exactly as the
extraction stage derives them from real subjects and bodies.

Plan shape: line items are pre-aggregated per order (partial aggregation before
the shuffle), then joined to orders on the order key and to customers on the
customer key.  Both are ordinary shuffle joins that AQE may turn into broadcast
joins at run time when a side is small; nothing is broadcast by assumption.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text

# Fixed values of the adapter (see FIXTURES.md section 3).
REPOSITORY_COUNT = 25
ORDERS_PER_BLOCK = 100
AUTHOR_COUNT = 40
BODY_BY_PRIORITY = [
    ("1-URGENT", "**AI tool: Claude Code and Copilot**"),
    ("2-HIGH", "AI tools: Cursor, GitHub Copilot"),
    ("3-MEDIUM", None),
    ("4-NOT SPECIFIED", "ai tool: windsurf & Cursor"),
    ("5-LOW", "no marker"),
]


_READS: dict[tuple[str, int, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a lazy DataFrame.

    The DataFrame (file listing and footer schema, no data) is kept per session
    and path, so building many queries over the same tables lists them once;
    every action still reads the files.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    df = _READS.get(key)
    if df is None or df.sparkSession is not spark:
        df = _READS[key] = spark.read.parquet(path)
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that scans into fewer partitions than there are cores.

    A small file with a single row group is read by one task, and every
    row-wise expression fused into that stage (the regex text rules) would run
    serially.  Large inputs already scan in many splits and pass through.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    return nation.select(
        F.col("n_nationkey").cast("int").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("/repos/"), F.col("n_name")).alias("url"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("timestamp").alias("last_extracted_at"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
    )


def _subject(k, seg) -> F.Column:
    ks = k.cast("string")
    slot = k % 10
    return (
        F.when(slot == 0, F.concat(seg, F.lit(" | update order (!"), ks, F.lit(")")))
        .when(slot == 1, F.concat(F.lit("["), seg, F.lit("] update (#"), ks, F.lit(")")))
        .when(slot == 2, F.concat(seg, F.lit(" rework")))
        .when(slot == 3, F.concat(F.lit("Fix rounding (#"), ks, F.lit(")")))
        .when(slot == 4, F.concat(F.lit('Revert "'), seg, F.lit(" | update order (!"),
                                  (k - 4).cast("string"), F.lit(')" (!'), ks, F.lit(")")))
        .when(slot == 5, F.concat(F.lit("Unrevert !"), (k - 5).cast("string"),
                                  F.lit(" and fix (!"), ks, F.lit(")")))
        .when(slot == 6, F.lit("2.58.0 release"))
        .when(slot == 7, F.concat(F.lit("#"), ks, F.lit(" hotfix")))
        .when(slot == 8, F.lit("MERGE branch"))
        .otherwise(F.lit("I18N labels"))
    )


def _body(priority) -> F.Column:
    chain = None
    for value, body in BODY_BY_PRIORITY:
        lit = F.lit(body).cast("string")
        chain = F.when(priority == value, lit) if chain is None else chain.when(priority == value, lit)
    return chain


#: What a file's entry is made of.
FILE_COLUMNS = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]


def _files(items) -> F.Column:
    """The files of a commit, of its order's line items: each is a file; returned quantities are deletions."""
    def entry(i):
        back, n = i["l_returnflag"] == "R", i["l_quantity"].cast("int")
        return F.struct(i["l_linenumber"].alias("l_linenumber"), F.concat(F.lit("parts/"), i["l_partkey"].cast("string"), F.lit(".txt")).alias("filename"),
                        F.when(back, 0).otherwise(n).alias("added"), F.when(back, n).otherwise(0).alias("deleted"))
    return F.transform(F.array_sort(F.transform(items, entry)), lambda e: F.struct(
        e["filename"].alias("filename"), e["added"].alias("added"), e["deleted"].alias("deleted")))


def commit_messages(spark: SparkSession, sf_dir: str, files: bool = False) -> DataFrame:
    """Commits as extracted from a log: numbers, subject and body, weights as loaded, and on demand their ``files``."""
    orders = spread(read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"), "o_orderkey")
    items = (read_table(spark, sf_dir, "lineitem")
             .select("l_orderkey", *(FILE_COLUMNS if files else ["l_quantity", "l_returnflag"]))
             .groupBy("l_orderkey")
             .agg(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("_added"),
                  F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("_deleted"),
                  F.count(F.lit(1)).alias("_files"), *([F.collect_list(F.struct(*FILE_COLUMNS)).alias("_items")] if files else [])))
    # one row per key by grouping, on the shuffle that the join needs anyway: Catalyst then knows the key to be
    # unique and leaves the join out where no column of it is used
    customers = read_table(spark, sf_dir, "customer").groupBy("c_custkey").agg(F.max("c_mktsegment").alias("c_mktsegment"))

    sides = [(items, orders.o_orderkey == items.l_orderkey), (customers, orders.o_custkey == customers.c_custkey)]
    j = orders
    for side, on in reversed(sides) if files else sides:  # files are not shuffled a second time
        j = j.join(side, on, "left")
    k = F.col("o_orderkey")
    cust = F.col("o_custkey")
    status_p = F.col("o_orderstatus") == "P"
    author_no = (cust % AUTHOR_COUNT).cast("string")
    return j.select(
        k.alias("id"),
        (F.floor(k / ORDERS_PER_BLOCK) % REPOSITORY_COUNT).cast("int").alias("repository_id"),
        F.md5(k.cast("string")).alias("hash"),
        F.col("o_orderdate").cast("timestamp").alias("commit_date"),
        F.concat(F.lit("Author "), author_no,
                 F.when(cust % 200 >= 160, F.lit(" Jr")).otherwise(F.lit(""))).alias("author_name"),
        F.concat(F.lit("author"), author_no, F.lit("@example.com")).alias("author_email"),
        _subject(k, F.col("c_mktsegment")).alias("subject"),
        _body(F.col("o_orderpriority")).alias("body"),
        F.coalesce(F.col("_added"), F.lit(0)).cast("int").alias("lines_added"),
        F.coalesce(F.col("_deleted"), F.lit(0)).cast("int").alias("lines_deleted"),
        F.coalesce(F.col("_files"), F.lit(0)).cast("int").alias("files_changed"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(status_p, (F.lit(40) + k % 61).cast("int")).otherwise(F.lit(100)).alias("weight"),
        F.when(status_p, (F.lit(50) + k % 51).cast("smallint")).alias("ai_confidence"),
        F.lit(None).cast("string").alias("description"),
        F.when(status_p, (F.lit(40) + k % 61).cast("int")).alias("business_impact"),
        *([_files(F.col("_items")).alias("files")] if files else []),
    )


def enriched_commits(messages: DataFrame) -> DataFrame:
    """Apply the pattern enrichment (T1 category, T5 tools) to extracted commits."""
    df = text.add_ai_tools(text.add_category(messages, "subject", "category"), "body", "ai_tools")
    return df.select(
        "id", "repository_id", "hash", "commit_date", "author_name", "author_email", "subject",
        "lines_added", "lines_deleted", "files_changed", "created_at", "category", "weight", "ai_tools",
        "ai_confidence", "description", "business_impact", *(["files"] if "files" in df.columns else []),
    )


def loaded_commits(spark: SparkSession, sf_dir: str, files: bool = False) -> DataFrame:
    """The commit table right after loading, before revert weighting."""
    return enriched_commits(commit_messages(spark, sf_dir, files))
