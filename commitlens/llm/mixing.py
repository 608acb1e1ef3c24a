"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  Keys are uniform, so their leading bits are
balanced ranges: word counts are summed per (source, range), prefix sums over the
ranges find the range in which a source's budget ends, and only that range's rows are
sorted to find the document at the cut.  What remains is narrow: a row compares its
key with the cut of its source.  Budgets beyond a source's size repeat it in epochs.

Defined cases: null or wordless text has size 0 and is never taken; a null source is
one source, the last; rows with equal doc_id and size at the cut share the words left
evenly (rounded down); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import WORD, aside, materialise, restored, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Of the 52 bits of a key the first 12 name its range: 4096 ranges per source.
KEY_BITS, RANGE_BITS = 52, 12


def mix_key(doc_id: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """Narrow: adds size, _key and _range to the input's columns."""
    return (df.withColumn("size", word_count(F.col(text))).withColumn("_key", mix_key(F.col("doc_id")))
            .withColumn("_range", F.shiftright("_key", KEY_BITS - RANGE_BITS)))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> target, epochs, rest.

    The target is ``least(cap, weight * level)`` where the level spends the whole budget;
    it is the largest quotient of remaining budget and remaining weight over the sources in
    order of cap / weight.  The table has one row per source name; only it is sorted.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = per_source.withColumn("_w", picked.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    below = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(below), F.lit(0.0))
    t = t.withColumn("_level", left / weight)
    t = t.withColumn("target", F.least("_cap", F.col("_w") * F.max("_level").over(everything)))
    budget, size = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(size > 0, F.floor(budget / F.when(size > 0, size))).otherwise(0).cast("long")
    return t.select("source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * size).alias("rest"))


def cuts(rows: DataFrame, **how) -> DataFrame:
    """One row per source: its target, its full epochs and the document at which the last one is cut.

    ``rows``: source, doc_id, size, _key, _range.
    """
    per_range = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    per_range = materialise(per_range, "mix-ranges")
    goal = targets(per_range.groupBy("source").agg(F.sum("_words").alias("source_size")), **how)
    goal = materialise(goal, "mix-targets")
    upto = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = per_range.withColumn("_before", F.sum("_words").over(upto) - F.col("_words")).alias("a")
    g = goal.alias("g")
    at = at.join(g, F.col("a.source").eqNullSafe(F.col("g.source"))).where(
        (F.col("_before") <= F.col("rest")) & (F.col("rest") < F.col("_before") + F.col("_words")))
    at = materialise(at.select("g.source", "_range", (F.col("rest") - F.col("_before")).alias("_rest")), "mix-cut-ranges").alias("c")
    r = rows.alias("r")
    near = r.join(at, F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r._range") == F.col("c._range"))).select(
        "r.source", "r._key", "r.doc_id", "r.size", "c._rest")
    near = near.groupBy("source", "_rest", "_key", "doc_id", "size").agg(F.count("*").alias("_same"))
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.col("_same") * F.col("size")
    near = near.withColumn("_before", F.sum(words).over(order) - words).where(
        (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + words))
    near = near.select(F.col("source").alias("_s"), F.struct("_key", "doc_id", "size").alias("cut"),
                       F.floor((F.col("_rest") - F.col("_before")) / F.col("_same")).cast("long").alias("cut_words"))
    return materialise(goal.join(near, goal["source"].eqNullSafe(near["_s"]), "left").drop("_s"), "mix-cuts")


def mix(df: DataFrame, cut: DataFrame) -> DataFrame:
    """Narrow but for the join with the per-source table: adds source_size, target and taken."""
    c = cut.withColumnRenamed("source", "_source")
    own = F.struct("_key", "doc_id", "size")
    part = F.when(F.col("cut").isNull(), 0).when(own < F.col("cut"), F.col("size")).when(
        own == F.col("cut"), F.col("cut_words")).otherwise(0)
    return df.join(c, df["source"].eqNullSafe(c["_source"])).withColumn(
        "taken", (F.col("epochs") * F.col("size") + part).cast("long")).drop("_source", "epochs", "rest", "cut", "cut_words")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Pipeline stage: a row for each epoch that takes a document, under the columns of the
    input; the copy at a cut keeps as many words as the budget has left."""
    rows = sized(aside(docs, "doc_id", "source"), "_row.text")
    cut = cuts(rows.select("source", "doc_id", "size", "_key", "_range").checkpoint(), **how)
    out = mix(rows, cut).where(F.col("taken") > 0)
    over = F.col("taken") % F.col("size")
    copies = F.floor(F.col("taken") / F.col("size")) + F.when(over > 0, 1).otherwise(0)
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    pieces = F.regexp_extract_all("_row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    short = (F.col("_copy") * F.col("size")) > F.col("taken")
    text = F.when(short, F.array_join(F.slice(pieces, F.lit(1), over.cast("int")), "")).otherwise(F.col("_row.text"))
    chars = F.when(short, F.length(text).cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else text
    return restored(out, docs.columns, text=text, n_chars=chars)


def mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5."""
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text").checkpoint()
    return mix(rows, cuts(rows)).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB; the same arithmetic over all rows at once.
MIX_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as k
  from {docs}),
per as (select source, cast(sum(size) as bigint) as source_size from sized group by 1),
w as (select *, cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as w,
             source_size * 2.0::double as cap from per),
lv as (select *, (cast(sum(source_size) over () as double) * 1.5::double
                  - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
                 / (sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as lvl
       from w),
tg as (select source, source_size, least(cap, w * max(lvl) over ()) as target from lv),
ep as (select *, case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end as epochs from tg),
rs as (select *, cast(floor(target) as bigint) - epochs * source_size as rest from ep),
run as (select s.*, r.source_size, r.target, r.epochs, r.rest,
               coalesce(sum(s.size) over (partition by s.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
        from sized s join rs r on s.source is not distinct from r.source)
select doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken
from run
"""
OP5_SQL = MIX_SQL.format(docs="documents", text="text")
