"""Benchmark decontamination by canonical templates, with DataFrame functions only.

A text becomes a template: numbers, units after numbers, and names (capitalised words, wherever
they stand) turn into typed placeholders, marks go, letters are lowered.  Windows of five
template tokens are hashed and joined with those of the benchmark; windows with names are hashed
a second time with the names as plain words, so that copies in other letters are found too.
Only documents with enough of an item's hashes go on (``candidates``).
Windows that match along one alignment of a document with an item must agree on the
slots: one item value stands for one document value (several may stand for the same), so the
same question with other numbers is caught; windows that hold another value than most do are left out,
and so is an alignment of nothing but changed slots.  A document is contaminated by an item when at least
``MIN_COVER`` of the item's windows match so, with names as slots or with names as words.

Defined cases: a null or empty text has no windows; a shorter text or item is one window;
repeated rows are judged alike; equal items are items of their own; empty tables give
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, table, text_hash

WIDTH, MIN_COVER = 5, 0.8
#: Windows of the benchmark (under 100 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
#: The first sign after those of the slots, and more characters than a text has.
_BEYOND, _LONGEST = "\ue003", (1 << 31) - 1
UNITS = ("%", "kg", "g", "mg", "km", "cm", "mm", "m", "miles", "mile", "feet", "ft", "inches", "inch", "l", "ml", "liters", "hours", "hour", "h", "minutes", "minute",
         "min", "seconds", "second", "s", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "degrees")
_UNITS = "|".join(UNITS[1:])
#: Each pattern looks at one character before anything costly.  Tokens that begin with a sign of the text's own count as slots.
_STEPS = (
    (r"(?=[0-9])(?<![\p{L}\p{N}.,])([0-9]+(?:[.,][0-9]+)*)(?![\p{L}\p{N}])", f" {NUMBER}$1 "),
    (rf"(?=[0-9])(?<![\p{{L}}\p{{N}}.,])([0-9]+(?:[.,][0-9]+)*)(?=(?i:{_UNITS})(?![\p{{L}}\p{{N}}]))", f" {NUMBER}$1 "),
    (rf"{NUMBER}([0-9.,]+)\s*(%|(?i:{_UNITS})(?![\p{{L}}\p{{N}}]))", f"{NUMBER}$1 {UNIT}$2 "),
    (rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}\p{{M}}{NAME}-{UNIT}])(\p{{L}}+)", f" {NAME}$1"),
    (rf"[^a-zA-Z0-9 \p{{L}}\p{{N}}\p{{M}}{NAME}-{UNIT}%.,]+|[.,](?:(?![0-9])|(?<![0-9].))", " "),
)


def marked(text: Column) -> Column:
    """The text's tokens between spaces, slots led by the sign of their type."""
    for pattern, to in _STEPS:
        text = F.regexp_replace(text, pattern, to)
    return F.lower(F.trim(text))


def tokens(df: DataFrame, *keep: str) -> DataFrame:
    """(*keep, raw, tpl, low, total, some): a text's tokens, as a template if there are slots, with its names as words if
    there are any; the number of its windows and the places where they begin."""
    df = df.select(*keep, marked(F.coalesce("text", F.lit(""))).alias("_m"))
    # No filter on _m: it would be pushed down and mark the text twice.  Without slots the template is the text itself.
    named = F.contains("_m", F.lit(NAME))
    df = df.select(*keep, F.array_remove(F.split("_m", " "), "").alias("raw"), named.alias("_named"),
                   (named | F.contains("_m", F.lit(NUMBER)) | F.contains("_m", F.lit(UNIT))).alias("_any"))
    slot = lambda t: (t >= NAME) & (t < _BEYOND)
    tpl = F.transform("raw", lambda t: F.when(slot(t), F.substring(t, 1, 1)).otherwise(t))
    low = F.transform("raw", lambda t: F.when(~slot(t), t).when(t < NUMBER, F.substring(t, 2, _LONGEST)).otherwise(F.substring(t, 1, 1)))
    df = df.select(*keep, "raw", "_any", F.when(F.col("_any"), tpl).otherwise(F.col("raw")).alias("tpl"), F.when(F.col("_named"), low).alias("low"))
    df = df.select("*", F.greatest(F.size("tpl") - (WIDTH - 1), F.lit(1)).alias("total"))
    return df.select("*", F.when(F.size("tpl") == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("total"))).alias("some"))


def over(words: str, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + (k - 1)) for k in range(WIDTH)))


def hashes(df: DataFrame, *keep: str) -> DataFrame:
    """(*keep, h): the hashes that ``windows`` gives, without all that goes with them.

    The places of both ways are told first and hashed behind the explode, so that hashes and the join with them are compiled as one.
    An outer explode: the filter that Spark puts below a plain one would mark the text twice."""
    df = tokens(df, *keep).select(*keep, "tpl", "low", "total", "some")
    both = F.when(F.col("low").isNull() | (F.size("some") == 0), F.col("some")).otherwise(F.sequence(F.lit(1), F.col("total") * 2))
    df = df.select(*keep, "tpl", "low", "total", F.explode_outer(both).alias("p")).where("p is not null")
    second = F.col("p") > F.col("total")
    df = df.select(*keep, F.when(second, F.col("low")).otherwise(F.col("tpl")).alias("way"), F.when(second, F.col("p") - F.col("total")).otherwise(F.col("p")).alias("i"))
    return df.select(*keep, over("way", F.col("i")).alias("h"))


def windows(df: DataFrame, *keep: str) -> DataFrame:
    """(*keep, h, names, at, slots, total, plain): a row per window, and another with its names as words if it has any.

    names: 1 names are slots, 0 they are words, null there are none.  slots holds the values of all slots,
    without their tokens between; plain: some token is no slot."""
    # Sizes are columns before the windows are told: behind the explode they would carry the tokens into each row.
    df = tokens(df, *keep).select("*", F.least(F.size("tpl"), F.lit(WIDTH)).alias("_wide"))
    none = F.array().cast("array<string>")
    one = lambda i: F.struct(
        over("tpl", i).alias("h"), F.when(F.col("low").isNotNull(), over("low", i)).alias("g"), i.alias("at"),
        F.when(F.col("_any"), F.filter(F.slice("raw", i, F.lit(WIDTH)), lambda t: F.substring(t, 1, 1).between(NAME, UNIT))).otherwise(none).alias("slots"))
    df = df.select(*keep, "total", "_wide", F.explode(F.transform("some", one)).alias("w"))
    way = lambda h, names: F.struct(F.col(h).alias("h"), F.lit(names).cast("int").alias("names"))
    ways = F.when(F.col("w.h") == F.coalesce("w.g", "w.h"), F.array(way("w.h", None))).otherwise(F.array(way("w.h", 1), way("w.g", 0)))
    return df.select(*keep, "total", "w.at", "w.slots", (F.size("w.slots") < F.col("_wide")).alias("plain"), F.explode(ways).alias("y")).select(
        *keep, "y.h", "y.names", "at", "slots", "total", "plain")


def bound(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def agreeing(hits: Column) -> Column:
    """The hits (i, plain, pairs) all of whose pairs of an item's with a document's value are what most hits have for the item's value."""
    ahead = lambda p, q: (q["theirs"] == p["theirs"]) & ((q["n"] < p["n"]) | ((q["n"] == p["n"]) & (q["slots"] < p["slots"])))
    votes = lambda pairs: F.transform(F.array_distinct(pairs), lambda p: F.struct(
        p["theirs"].alias("theirs"), (-F.size(F.filter(pairs, lambda q: q == p))).alias("n"), p["slots"].alias("slots")))
    lost = lambda v: F.transform(F.filter(v, lambda p: F.exists(v, lambda q: ahead(p, q))), lambda p: F.struct(p["theirs"].alias("theirs"), p["slots"].alias("slots")))
    kept = lambda out: F.filter(hits, lambda w: ~F.arrays_overlap(w["pairs"], out))
    single = lambda pairs: F.size(F.array_distinct(pairs)) == F.size(F.array_distinct(pairs["theirs"]))
    return bound(F.flatten(hits["pairs"]), lambda pairs: F.when(single(pairs), hits).otherwise(bound(votes(pairs), lambda v: bound(lost(v), kept))))


def candidates(rows: DataFrame, items: DataFrame, min_cover: float) -> DataFrame:
    """The rows (doc_id, th, text) of which enough windows of an item are found, whatever their slots hold and wherever they
    are: a bound from above, so that slots are looked at in few documents only."""
    small = items.count() <= BROADCAST_ROWS
    side = items.select("_item", "windows", "h", "i").distinct()
    met = hashes(rows, "doc_id", "th").join(F.broadcast(side) if small else side, "h").groupBy("doc_id", "th", "_item", "windows").agg(F.countDistinct("i").alias("n"))
    found = materialise(met.where(F.col("n") >= F.col("windows") * min_cover).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct(), "candidates")
    found_side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return rows.join(found_side, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["th"] == F.col("_th")), "left_semi")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, th, item_id, windows, matched, changed): a row per document and item that it holds;
    changed: a slot has another value than the item's."""
    items = benchmark.select(F.monotonically_increasing_id().alias("_item"), "item_id", "text")
    items = materialise(windows(items, "_item", "item_id"), "benchmark-windows").select(
        "_item", "item_id", F.col("total").alias("windows"), "h", F.col("names").alias("named"), F.col("at").alias("i"), F.col("slots").alias("theirs"))
    side = F.broadcast(items) if items.count() <= BROADCAST_ROWS else items
    rows = candidates(docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text"), items, min_cover)
    hits = windows(rows, "doc_id", "th").drop("total").join(side, "h")
    # Windows without names on either side count both with names as slots and with names as words.
    hits = hits.withColumn("way", F.explode(F.when(F.col("names").isNull() & F.col("named").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.coalesce("names", "named")))))
    typed = lambda c: F.when(F.col("way") == 1, F.col(c)).otherwise(F.filter(c, lambda t: F.substring(t, 1, 1) != NAME))
    hits = hits.withColumn("theirs", typed("theirs")).withColumn("slots", typed("slots"))
    doc = ["doc_id", "th", "_item", "item_id", "windows"]
    # Along one alignment every window of the item occurs once, so the lists are no longer than the item.
    along = hits.groupBy(*doc, "way", (F.col("at") - F.col("i")).alias("shift")).agg(
        F.collect_set(F.struct("i", "plain", F.arrays_zip("theirs", "slots").alias("pairs"))).alias("hits"))
    along = along.withColumn("hits", agreeing(F.col("hits")))
    along = along.withColumn("changed", F.exists("hits", lambda w: F.exists(w["pairs"], lambda p: ~p["slots"].eqNullSafe(p["theirs"]))))
    along = along.where(~F.col("changed") | F.exists("hits", lambda w: w["plain"]))
    found = along.select(*doc, "way", "changed", F.explode("hits.i").alias("i")).groupBy(*doc, "way").agg(
        F.countDistinct("i").alias("matched"), F.max("changed").alias("changed"))
    found = found.where(F.col("matched") >= F.col("windows") * min_cover)
    return found.groupBy(*doc).agg(F.max("matched").alias("matched"), F.max("changed").alias("changed")).drop("_item")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op7: the contaminated documents and the items they hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "windows", "matched", "changed")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Pipeline stage: the documents that hold no item."""
    out = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    out = materialise(out, "contaminated")
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_id"]) & (text_hash(docs["text"]) == out["_th"]), "left_anti")
