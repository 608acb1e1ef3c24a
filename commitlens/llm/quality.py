"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lowered, white space folded, digits to 0) and hashed.  Per host the
distinct documents of each line are counted; lines above the limit are removed, and
documents of which too little remains are rejected.

Copies would make every line of a much copied text look like boilerplate.  Documents of one
text therefore count once; a line is above the limit when more than ``max_docs`` different
texts of the host hold it, whatever other lines these have.

Defined cases: null text has no words and fails the base rules; a null host counts as
the empty host; repeated rows are judged one by one; an empty table gives an empty result; the stage
passes all other columns on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import UPPER, aside, batches, fresh, materialise, table, text_hash

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
MAX_DOCS = 20
MIN_LEFT_PCT = 40
_FOLD = str.maketrans(UPPER + "0123456789", UPPER.lower() + "0" * 10)
_METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    k = len(ids)
    if k ** 3 < 2 ** 62:
        code = (code[:-2] * k + code[1:-1]) * k + code[2:]
    else:
        _, pair = np.unique(code[:-1] * k + code[1:], return_inverse=True)
        code = pair[:-1] * np.int64(k) + code[2:]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i:i + n] |= twice
    return int(covered.sum())


def line_key(words: list[bytes]) -> int:
    """Signed 64 bits, in the order of the md5 digits."""
    folded = b" ".join(words).decode().translate(_FOLD)
    return int.from_bytes(md5(folded.encode()).digest()[:8], "big") - (1 << 63)


def measure(text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
    """The base metrics, and per distinct line: hash, words in all its occurrences."""
    text = text or ""
    seen: set[str] = set()
    lines: dict[int, int] = {}
    dup = 0
    for line in text.split("\n"):
        words = line.encode().split()
        if words:
            if line in seen:
                dup += 1
            seen.add(line)
            key = line_key(words)
            lines[key] = lines.get(key, 0) + len(words)
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return [len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat_words(words)], list(lines.items())


def _measured(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        metrics, lines = zip(*map(measure, b.column("text").to_pylist()), strict=True)
        flat = [x for row in lines for x in row]
        offsets = np.cumsum([0, *map(len, lines)])
        fields = [pa.array([x[i] for x in flat], pa.int64()) for i in range(2)]
        struct = pa.StructArray.from_arrays(fields, names=["h", "words"])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("host"), b.column("th"), *(pa.array(c, pa.int64()) for c in zip(*metrics, strict=True)),
             pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)],
            names=["doc_id", "host", "th", *_METRICS, "lines"])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base metrics and line hashes of whole texts; narrow."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
                       text_hash(F.col("text")).alias("th"), "text")
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_measured, f"doc_id {id_type}, host string, th long, " + ", ".join(f"{m} long" for m in _METRICS)
                           + ", lines array<struct<h: long, words: long>>")


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, h) of the lines above the limit.  Each step pre-aggregates before it shuffles."""
    lines = rows.select("host", "th", F.explode("lines").alias("l")).select("host", "th", "l.h").distinct()
    return lines.groupBy("host", "h").agg(F.count("*").alias("texts")).where(F.col("texts") > max_docs).select("host", "h")


def judged(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, min_left_pct: int = MIN_LEFT_PCT) -> DataFrame:
    """A row per document: metrics, base_failed, removed (hashes of its removed lines), n_left, kept, th."""
    rows = measured(docs, host).checkpoint().withColumn("_row", F.monotonically_increasing_id())
    often = materialise(frequent_lines(rows, max_docs), "frequent-lines")
    lines = rows.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.h", "l.words")
    gone = lines.join(often, ["host", "h"]).groupBy("_row").agg(
        F.sum("words").alias("_gone"), F.sort_array(F.collect_list("h")).alias("removed"))  # a document's own lines only
    out = rows.drop("lines", "host").join(gone, "_row", "left").withColumn("n_left", F.col("n_words") - F.coalesce("_gone", F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PCT)
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_left") * 100 >= F.col("n_words") * min_left_pct)).drop("_row", "_gone")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op8; the host of a document is its source."""
    return judged(table(spark, sf_dir, "documents")).select("doc_id", *_METRICS, "n_left", "base_failed", "kept")


def _without(name: str):
    """Drop the lines whose hashes the column ``name`` lists, and the column."""
    def drop_lines(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            texts = []
            for text, removed in zip(b.column("text").to_pylist(), b.column(name).to_pylist(), strict=True):
                if removed:
                    drop = set(removed)
                    text = "\n".join(x for x in text.split("\n") if not (w := x.encode().split()) or line_key(w) not in drop)
                texts.append(text)
            out = b.drop_columns([name])
            yield out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return drop_lines


def clean_documents(docs: DataFrame, **how) -> DataFrame:
    """Pipeline stage: rejected documents go, lines above the limits leave the others' texts."""
    names = docs.columns
    verdicts = judged(docs, **how).select("doc_id", "th", "kept", "removed").dropDuplicates(["doc_id", "th"])
    verdicts = materialise(verdicts.where(~F.col("kept") | F.col("removed").isNotNull()), "verdicts")
    rows = aside(docs, F.col("doc_id").alias("id"), text_hash(F.col("text")).alias("own"))
    rows = rows.join(verdicts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("th")), "left").where(F.coalesce("kept", F.lit(True)))
    removed = fresh(names, "removed")
    out = rows.select("_row.*", F.col("removed").alias(removed)).mapInArrow(_without(removed), docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)


OP8_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as t from documents),
m as (
  select r, doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
ln as (
  select r, host, md5(t) as th, x as line, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as lw
  from (select r, host, t, unnest(string_split(t, chr(10))) as x from d)),
lw as (
  select r, host, th, line, len(lw) as n,
         substr(md5(regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g')), 1, 16) as h
  from ln where len(lw) > 0),
dup as (select r, count(*) - count(distinct line) as n from lw group by 1),
one as (select r, host, th, h, sum(n) as n from lw group by all),
often as (select host, h from one group by 1, 2 having count(distinct th) > 20),
gone as (select r, sum(n) as n from one join often using (host, h) group by 1),
win as (select r, i, list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2) as x
        from (select r, w, unnest(range(1, len(w) - 1)) as i from m where len(w) >= 3)),
rep as (select r, unnest([i, i + 1, i + 2]) as i from (select r, i, count(*) over (partition by r, x) as c from win) where c > 1),
rw as (select r, count(distinct i) as n from rep group by 1),
f as (
  select m.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rw.n, 0) as bigint) as n_repeat_words,
         cast(len(w) - coalesce(gone.n, 0) as bigint) as n_left
  from m left join dup using (r) left join rw using (r) left join gone using (r)),
g as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from f)
select *, not base_failed and n_left * 100 >= n_words * 40 as kept from g
"""
