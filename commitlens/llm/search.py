"""Ranked lexical search: accumulator-limited, term at a time, rarest terms first.

Documents stay where they are.  One pass writes, per document, its terms that the queries ask for
with their frequencies; counts over all documents (N, L, df) give the weights.  A second pass takes
these postings in chunks: each query's terms come rarest first, and a document gets an accumulator
while the bounds of the terms to come can still reach the score of the k-th best seen so far, be it
partial.  From there on only documents that have one are updated, to their exact scores.  A document
without one scores less than k others, so each task's k best are exact, and so is their merger.

Queries go in blocks of about ``BLOCK_BYTES`` of text (dealt by hash; a longer query is a block's
only excess), which is all that driver and tasks hold of them.

Scores are 64-bit integers: a term weighs ``floor(1000 ln((2N+2)/(2df+1)))``, a document's length
factor m is ``75 + 25 n N div L``, and a term adds ``weight * ((10^9 tf) div (1000 tf + 12 m))`` each
time the query has it.

Defined cases: null and empty texts have no terms, so they are found by no query and count in neither N
nor L; a query without terms, or whose terms are in no document, has no rows; equal queries (id and
text) count once, different texts under one id are ranked apart; repeated documents are all ranked;
equal scores come by ascending doc_id, null first; empty tables give an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import batches, materialise, table

K = 20
BLOCK_BYTES = 4 << 20
GROUP_BYTES, CHUNK_POSTINGS = 4 << 20, 1 << 20
NULL_ID = -(1 << 63)
#: Bytes of a term stay, upper case becomes lower; all other bytes below 0x80 part terms.
_FOLD = bytes(b if b >= 0x80 or bytes([b]).isalnum() else 0x20 for b in range(256)).lower()

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _indexer(vocabulary: dict[bytes, int]):
    def index(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, width = vocabulary.get, max(1, len(vocabulary))
        for b in batches(it):
            texts, at = b.column("text").to_pylist(), 0
            while at < len(texts):
                first, size, n, known = at, 0, [], []
                while at < len(texts) and size < GROUP_BYTES:
                    words = terms_of(texts[at])
                    known.append(np.fromiter(map(find, words, repeat(-1)), np.int64, len(words)))
                    n.append(len(words))
                    size += len(texts[at] or "")
                    at += 1
                ids, doc = np.concatenate(known), np.repeat(np.arange(len(n)), n)
                keys, tfs = np.unique((doc * width + ids)[ids >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * width), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys % width, tfs)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, at - first), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return index


class Chunk:
    """The postings of some documents, by term."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, docs: int, length: int, width: int):
        m = 75 + 25 * n * docs // max(1, length)
        doc = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(terms, kind="stable")
        tf = tfs[order].astype(np.int64)
        self.n_docs, self.doc = len(n), doc[order]
        self.impact = 10**9 * tf // (1000 * tf + 12 * m[self.doc])
        self.start = np.searchsorted(terms[order], np.arange(width + 1))
        filled = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(width, np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.impact, self.start[filled])

    def best(self, query: list[tuple[int, int]], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores, among them all that can be one of the k best, given that k scores
        of ``floor`` or more are known already.  ``query``: (term, weight times repeats), rarest first."""
        query = [(t, w) for t, w in query if self.most[t] and w]
        rest = np.cumsum([w * self.most[t] for t, w in query][::-1], dtype=np.int64)[::-1]
        scores, held = np.zeros(self.n_docs, np.int64), None
        for (t, w), bound in zip(query, rest.tolist(), strict=True):
            doc, impact = (x[self.start[t]:self.start[t + 1]] for x in (self.doc, self.impact))
            if held is None and (bound < floor or bound < scores.max(initial=0) and bound < _kth(scores, k)):
                held = np.flatnonzero(scores)
            if held is None:
                scores[doc] += w * impact  # a document once per term
            else:
                at = np.minimum(np.searchsorted(doc, held), len(doc) - 1)
                has = doc[at] == held
                scores[held[has]] += w * impact[at[has]]
        found = np.flatnonzero(scores)
        return found, scores[found]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _chunks(it: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches(it):
        ends = np.cumsum(b.column("terms").value_lengths().to_numpy())
        at = 0
        while at < b.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_POSTINGS, "right")))
            part = b.slice(at, upto - at)
            ids = part.column("doc_id").fill_null(NULL_ID).to_numpy()
            yield (ids, part.column("n").to_numpy(), part.column("terms").value_lengths().to_numpy(),
                   part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy())
            at = upto


def _searcher(queries: list[list[tuple[int, int]]], docs: int, length: int, width: int, k: int):
    def search(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(queries)
        for ids, *postings in _chunks(it):
            chunk = Chunk(*postings, docs, length, width)
            for q, query in enumerate(queries):
                known = best[q][1]
                found, scores = chunk.best(query, int(known[-1]) if len(known) == k else 0, k)
                ids_q, scores = np.concatenate([best[q][0], ids[found]]), np.concatenate([known, scores])
                if len(scores) > k:
                    ids_q, scores = (x[scores >= _kth(scores, k)] for x in (ids_q, scores))
                order = np.lexsort((ids_q, -scores))[:k]
                best[q] = ids_q[order], scores[order]
        for q, (ids, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), pa.array(ids, mask=ids == NULL_ID), pa.array(scores)], names=["_q", "doc_id", "score"])

    return search


def _block(docs: DataFrame, asked: list[Row], k: int) -> DataFrame:
    """The k best documents of each query of a block: _q (its place in the block), rank, doc_id, score."""
    words = [Counter(terms_of(r.text)) for r in asked]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    postings = materialise(rows.mapInArrow(_indexer(vocabulary), POSTINGS), "search-postings")
    n_docs, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most the block's terms
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    queries = [[(t, weight[t] * c) for t, c in sorted(((vocabulary[w], c) for w, c in q.items() if vocabulary[w] in df), key=lambda x: (df[x[0]], x[0]))] for q in words]
    hits = postings.mapInArrow(_searcher(queries, n_docs, length, len(vocabulary), k), "_q long, doc_id long, score long")
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each query (item_id, text)."""
    spark = docs.sparkSession
    asked = queries.select("item_id", "text").where(F.octet_length("text") > 0).distinct()
    blocks = (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes + 1
    out, id_type = None, dict(queries.dtypes)["item_id"]
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], f"_q long, item_id {id_type}")
        part = _block(docs, rows, k).join(names, "_q").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op12: the 20 best documents of each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
size as (select count(*) as n_docs, sum(len(w)) as total from d where len(w) > 0),
tf as (select r, term, count(*) as tf from (select r, unnest(w) as term from d) group by all),
weight as (select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w
           from (select term, count(*) as df from tf group by 1), size),
m as (select r, doc_id, 75 + (25 * len(w) * n_docs) // total as m from d, size where len(w) > 0),
item as (
  select i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as i, * from (select distinct item_id, text from benchmark))),
score as (
  select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as score
  from item join weight using (term) join tf using (term) join m using (r) group by all),
top as (select *, row_number() over (partition by i order by score desc, doc_id) as rank from score where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from top where rank <= 20
"""
