"""Periodic runs of words: difference-cover longest common extensions on a harmonic grid.

A run with period q is a longest stretch of words in which words q apart are equal, q being the
least such distance.  Runs of ``max(6, 4q)`` words or more are found.  Such a run holds, at the
multiples of q, three equal neighbours in a row; each first one of a row asks for its longest
common extension (LCE) with the position q further, which gives the run's end, and a binary search
over extensions gives its start.  An LCE sorts the suffixes at the positions of a difference cover
only: two positions reach sampled ones together after fewer than ``PERIOD`` words, compared
directly, and from there a sparse table over the sorted suffixes' common prefixes answers.

Texts are concatenated in groups of ``GROUP_BYTES``, each ended by a word of its own, so no
extension leaves its text.  All work of a group is linear in its words but for the logarithms of
the grid, the sort and the table.  A text is one row and is held by one task, whole.

Defined cases: null and empty texts have no words, no runs and the collapsed text ``""``; repeated
rows give repeated results; an empty table gives an empty result; other columns pass through, and
input columns called ``n_words``, ``runs`` or ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import WORD, batches, table

#: A perfect difference set, so every distance modulo 31 is one between two of them.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
MIN_LENGTH, MIN_REPEATS = 6, 4
GROUP_BYTES = 4 << 20
#: Grid points held before their extensions are asked for.
HELD = 1 << 20

_INDEX = np.full(PERIOD, -1)
_INDEX[list(COVER)] = range(len(COVER))
#: For each distance modulo PERIOD the cover's member x for which x + distance is one, too.
_MEET = np.array([next(x for x in COVER if (x + d) % PERIOD in COVER) for d in range(PERIOD)])


class Extensions:
    """LCE of any two positions of a word array that ends in a word found nowhere else."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, np.zeros(2 * PERIOD, words.dtype)])  # 0 is no word
        at = np.arange(len(words))
        self.sampled = at[_INDEX[at % PERIOD] >= 0]
        levels = self._sorted()
        order = np.argsort(levels[-1])
        self.place = levels[-1]
        self._table(self._common(order, levels))

    def _sample(self, at: np.ndarray) -> np.ndarray:
        return at // PERIOD * len(COVER) + _INDEX[at % PERIOD]

    def _refine(self, rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split the groups of ``active`` samples, given by their rank, by key; who is left in a group."""
        order = np.lexsort((key, rank[active]))
        who, key = active[order], key[order]
        old, place = rank[who], np.arange(len(who))
        first = np.ones(len(who), bool)
        first[1:] = old[1:] != old[:-1]
        new = first.copy()
        new[1:] |= key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(first, place, 0))
        rank[who] = old + np.maximum.accumulate(np.where(new, place, 0)) - start
        alone = new & np.append(new[1:], True)
        return who[~alone]

    def _sorted(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first PERIOD, 2 PERIOD, 4 PERIOD ... words; the last are all distinct."""
        words, m = self.words.astype(np.int64), len(self.sampled)
        rank, active = np.zeros(m, np.int64), np.arange(m)
        for k in range(0, PERIOD - 1, 2):
            if not len(active):
                break
            at = self.sampled[active] + k
            active = self._refine(rank, active, words[at] << 32 | words[at + 1])
        if len(active):
            active = self._refine(rank, active, words[self.sampled[active] + PERIOD - 1])
        levels, step = [rank], PERIOD
        while len(active):
            rank = rank.copy()
            later = self._sample(self.sampled[active] + step)  # exists: the texts' last words part suffixes before the end
            active = self._refine(rank, active, levels[-1][later])
            levels.append(rank)
            step *= 2
        return levels

    def _common(self, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that neighbours among the sorted suffixes have in common."""
        a, b = self.sampled[order[:-1]], self.sampled[order[1:]]
        out = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            rank = levels[k]
            same = rank[self._sample(a + out)] == rank[self._sample(b + out)]
            out[same] += PERIOD << k
        return out + self._direct(a + out, b + out, np.full(len(a), PERIOD))

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most so many."""
        out, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(live):
            live = live[self.words[a[live] + out[live]] == self.words[b[live] + out[live]]]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def _table(self, common: np.ndarray) -> None:
        self.least, width = [common.astype(np.int32)], 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words equal from a and b on, for a < b."""
        wait = (_MEET[(b - a) % PERIOD] - a) % PERIOD
        out = self._direct(a, b, wait)
        far = np.flatnonzero(out == wait)  # no text has ended yet, so both sampled places exist
        if len(far):
            u, v = (self.place[self._sample(x[far] + wait[far])] for x in (a, b))
            low, high = np.minimum(u, v), np.maximum(u, v)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            got = np.empty(len(far), np.int64)
            for k in np.unique(level):
                of = level == k
                got[of] = np.minimum(self.least[k][low[of]], self.least[k][high[of] - (1 << int(k))])
            out[far] += got
        return out


def _starting(at: np.ndarray, q: np.ndarray, words: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid points, ascending by (q, place), to runs (start, length, q)."""
    reach = words.lce(at, at + q)
    inner = np.zeros(len(at), bool)  # of a run that holds the grid point before, too
    inner[1:] = (at[1:] - at[:-1] == q[1:]) & (q[1:] == q[:-1]) & (reach[:-1] >= q[:-1])
    keep = ~inner & (reach > 2 * q)
    at, q, reach = at[keep], q[keep], reach[keep]
    low, high = np.maximum(at - q + 1, 0), at.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        ok = words.lce(mid, mid + q[open_]) >= at[open_] - mid
        high[open_[ok]] = mid[ok]
        low[open_[~ok]] = mid[~ok] + 1
        open_ = open_[low[open_] < high[open_]]
    length = q + at - high + reach
    keep = length >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)
    return high[keep], length[keep], q[keep]


def find_runs(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, length, period) by start, then period, of concatenated texts.

    ``words``: numbers from 1; each text ends with a number of its own.  ``ends``: places behind
    the texts, which come longest first, so that the grid of q passes over texts of 4q words only.
    """
    sizes = np.diff(ends, prepend=0) - 1
    found, held, n_held, lce = [], [], 0, None

    def flush():
        nonlocal lce, n_held
        lce = lce or Extensions(words)
        found.append(_starting(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), lce))
        held.clear()
        n_held = 0

    for q in range(1, int(sizes[0]) // MIN_REPEATS + 1 if len(sizes) else 1):
        part = words[:ends[np.searchsorted(-sizes, -max(MIN_LENGTH, MIN_REPEATS * q), "right") - 1]] if sizes[0] >= MIN_LENGTH else words[:0]
        same = part[:-q:q] == part[q::q]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * q
        if len(at):
            held.append((at, np.full(len(at), q)))
            n_held += len(at)
            if n_held >= HELD:
                flush()
    if held:
        flush()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, length, start))  # equal stretches: the least period is the run's
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(start[order]) != 0) | (np.diff(length[order]) != 0)
    start, length, q = (x[order[first]] for x in (start, length, q))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _grouped(texts: list[str | None]) -> Iterator[list[int]]:
    """Rows in groups of bounded size, longest texts first within a group."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(i)
        size += len(t or "")
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _described(texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Per text: its number of words, its runs (rows of start, length, period) and its collapsed form."""
    split = [(t or "").encode().split() for t in texts]
    order = sorted(range(len(split)), key=lambda i: -len(split[i]))
    number = defaultdict(count(1).__next__)
    sizes = np.array([len(split[i]) for i in order], np.int64)
    ends = np.cumsum(sizes + 1)
    words = np.empty(ends[-1], np.int32)
    for k, i in enumerate(order):
        words[ends[k] - 1 - sizes[k]:ends[k] - 1] = np.fromiter(map(number.__getitem__, split[i]), np.int32, len(split[i]))
    words[ends - 1] = len(number) + 1 + np.arange(len(ends))
    start, length, q = find_runs(words, ends)
    cuts = np.searchsorted(start, ends)
    runs, collapsed = [np.zeros((0, 3), np.int64)] * len(split), [b""] * len(split)
    for k, i in enumerate(order):
        a, z, base = cuts[k - 1] if k else 0, cuts[k], ends[k] - 1 - sizes[k]
        kept = split[i]
        if z > a:
            runs[i] = np.stack([start[a:z] - base, length[a:z], q[a:z]], 1)
            cover = np.zeros(len(kept) + 1, np.int64)
            np.add.at(cover, runs[i][:, 0] + runs[i][:, 2], 1)
            np.add.at(cover, runs[i][:, 0] + runs[i][:, 1], -1)
            kept = [kept[j] for j in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        collapsed[i] = b" ".join(kept)
    return [len(w) for w in split], runs, collapsed


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN, False)), T.StructField("collapsed", T.StringType())])


def _with_runs(text: str):
    def add(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            place = 0
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for group in _grouped(texts):
                n, runs, collapsed = _described([texts[i] for i in group])
                flat = np.concatenate(runs)
                offsets = np.cumsum([0, *(len(r) for r in runs)])
                struct = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], [f.name for f in _RUN])
                part = b.slice(place, len(group))
                place += len(group)
                out = {name: part.column(k) for k, name in enumerate(b.schema.names) if name not in ADDED.names}
                out |= {"n_words": pa.array(n, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
                        "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return add


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, runs (start, length, period; by start, then period) and collapsed, the text's words
    joined by one space without those that a run holds after its first period.  Narrow."""
    kept = [f for f in docs.schema.fields if f.name not in ADDED.names]
    return docs.mapInArrow(_with_runs(text), T.StructType(kept + ADDED.fields))


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: every tenth by the checksum of doc_id repeats a stretch of its words to its end.
    A null doc_id has no checksum and its text stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("w"))
    n, g = F.size("w").cast("long"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    part = lambda arr, at, size: F.slice(arr, at.cast("int"), size.cast("int"))
    tail = F.flatten(F.array_repeat(part(F.col("w"), a + 1, p), F.ceil((n - a) / p).cast("int")))
    text = F.array_join(F.concat(part(F.col("w"), F.lit(1), a), part(tail, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The run of greatest length / period, compared as integers; ties: the first by start, then period."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.try_element_at(runs, F.lit(1)),
                    lambda a, b: F.when(better(a, b), b).otherwise(a))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op11."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = with_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", _best(F.col("runs")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
