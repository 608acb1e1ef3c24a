"""Subword lattice likelihood: marginal probabilities over all segmentations.

A vocabulary of pieces (byte strings, with all single bytes among them) has a log score
each.  A word is spelt by drawing pieces until a stop; its probability is the sum over all
ways to cut it into pieces, by forward recursion in log space.  Words of one length are
handled together: position by position, over arrays.

A token's probability joins the lattice with an edge for the whole word: absolute
discounting leaves seen tokens ``(count - d) / N`` and gives the mass taken off, ``d * V / N``,
to the spelt words.  So known and unknown texts have a proper probability.

The pieces come from an existing tokenizer's vocabulary.  Their scores start from its order
and are fitted by expectation over all distinct training words: that and the counts cover
the whole training part, and grow with it.

Defined cases: null text is empty and has its end alone; without training documents the
spelling model keeps its first scores and half of the mass is the end's; repeated rows are
scored one by one; words of any length are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import batches, materialise, table

LN10 = math.log(10)
#: Words whose scores every worker holds (the most frequent); the others are joined.
HELD_WORDS = 200_000
#: Distinct words a worker gathers before it passes their counts on.
GATHER = 500_000
EM_ROUNDS = 2
#: Longer words go alone, so that the arrays of a batch stay small.
LONG_WORD = 64
#: Positions of a long word whose cuts are held at a time.
SPAN = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def public_pieces(name: str = "piece_bpe_32k.model") -> list[bytes]:
    """Pieces of a public vocabulary in its order, lower-cased, without word marks."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    kept = (sp.id_to_piece(i).replace("▁", "") for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return list(dict.fromkeys(p.encode().lower() for p in kept if p))


class Pieces:
    """Pieces by a hash of their bytes, with log scores; ``log_stop`` ends a word."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray | None = None, stop: float = 0.4):
        single = [bytes([b]) for b in range(256)]
        own = list(dict.fromkeys([*pieces, *single]))
        first = 1.0 / (np.arange(len(own)) + 10.0) if weights is None else weights
        self.pieces, self.stop = own, stop
        keys = np.array([self._hash(p) for p in own], np.uint64)
        order = np.argsort(keys)
        self.order, self.keys, self.longest = order, keys[order], max(map(len, own))
        assert (np.diff(self.keys.astype(object)) > 0).all(), "two pieces share a hash"
        self.maybe = np.zeros(1 << 20, bool)  # by the first bits of a hash
        self.maybe[self.keys >> np.uint64(44)] = True
        self.scores = (np.log(first / first.sum()) + math.log(1 - stop))[order]
        self.log_stop = math.log(stop) - math.log(1 - stop)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = ((h + b + 1) * int(_MIX)) & (2 ** 64 - 1)
        return h

    def _found(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, rows, places of their pieces, log scores) for all cuts of words of one length, by end."""
        n, length = words.shape
        hashes: list[np.ndarray] = []
        codes = words.astype(np.uint64) + np.uint64(1)
        for end in range(1, length + 1):
            hashes = [(h + codes[:, end - 1]) * _MIX for h in [*hashes, np.zeros(n, np.uint64)]][-self.longest:]
            for k, h in enumerate(hashes):
                rows = np.flatnonzero(self.maybe[h >> np.uint64(44)])
                if len(rows):
                    at = np.minimum(np.searchsorted(self.keys, h[rows]), len(self.keys) - 1)
                    hit = self.keys[at] == h[rows]
                    yield end - len(hashes) + k, end, rows[hit], at[hit], self.scores[at[hit]]

    def log_spelt(self, words: np.ndarray) -> np.ndarray:
        """Natural logs of the marginal probabilities of words of one length (rows of bytes)."""
        n, length = words.shape
        forward = np.full((length + 1, n), -np.inf)
        forward[0] = 0
        for start, end, rows, _, score in self._found(words):
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + score)
        return forward[length] + self.log_stop

    def expected(self, words: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, summed."""
        n, length = words.shape
        cuts = list(self._found(words))
        forward, backward = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
        forward[0] = backward[length] = 0
        for start, end, rows, _, score in cuts:
            forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + score)
        for start, end, rows, _, score in sorted(cuts, key=lambda c: -c[1]):
            backward[start, rows] = np.logaddexp(backward[start, rows], backward[end, rows] + score)
        out = np.zeros(len(self.keys))
        for start, end, rows, at, score in cuts:
            out += np.bincount(at, np.exp(forward[start, rows] + score + backward[end, rows] - forward[length, rows]), len(out))
        return out

    def _cuts(self, word: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, places of their pieces) for all cuts of one word that end in (low, high], by end."""
        base = max(0, low + 1 - self.longest)
        codes = word[base:high].astype(np.uint64) + np.uint64(1)
        h, found = np.zeros(len(codes), np.uint64), []
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = (h[:len(codes) - size + 1] + codes[size - 1:]) * _MIX
            starts = np.flatnonzero(self.maybe[h >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.keys, h[starts]), len(self.keys) - 1)
            hit = (self.keys[at] == h[starts]) & (starts + (base + size) > low)
            found.append((starts[hit] + base, starts[hit] + (base + size), at[hit]))
        start, end, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], at[order]

    def expected_long(self, word: np.ndarray) -> np.ndarray:
        """expected() of one word of any length: its cuts are found twice, a span at a time."""
        length = len(word)
        forward, backward = [-math.inf] * (length + 1), [-math.inf] * (length + 1)
        forward[0] = backward[length] = 0.0
        spans = [(low, min(low + SPAN, length)) for low in range(0, length, SPAN)]
        for span in spans:
            start, end, at = self._cuts(word, *span)
            for i, j, score in zip(start.tolist(), end.tolist(), self.scores[at].tolist(), strict=True):
                forward[j] = _log_sum(forward[j], forward[i] + score)
        out = np.zeros(len(self.keys))
        ahead = np.array(forward)
        for span in reversed(spans):
            start, end, at = (x[::-1] for x in self._cuts(word, *span))
            scores = self.scores[at]
            for i, j, score in zip(start.tolist(), end.tolist(), scores.tolist(), strict=True):
                backward[i] = _log_sum(backward[i], backward[j] + score)
            behind = np.array(backward[span[0] + 1:span[1] + 1])  # complete: all cuts from these positions have been seen
            out += np.bincount(at, np.exp(ahead[start] + scores + behind[end - span[0] - 1] - forward[length]), len(out))
        return out


def _log_sum(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x)) if y > -math.inf else x


def by_length(words: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of bytes) of words of one length, in arrays of bounded size."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = most if length <= LONG_WORD else max(1, most * 8 // int(length))
        for i in range(0, len(places), step):
            part = places[i:i + step]
            yield part, np.frombuffer(b"".join(words[j] for j in part), np.uint8).reshape(len(part), length)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _counts(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    seen: Counter[bytes] = Counter()
    for b in batches(it):
        for text in b.column("text").to_pylist():
            seen.update(tokens(text))
        if len(seen) >= GATHER:
            yield out()
            seen.clear()
    if seen:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts."""
    rows = docs.select("text").mapInArrow(_counts, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def fitted(pieces: Pieces, words: DataFrame, rounds: int = EM_ROUNDS) -> Pieces:
    """Pieces with scores from the distinct words; what comes back is as long as the vocabulary."""
    for _ in range(rounds):
        def expect(it: Iterable[pa.RecordBatch], model: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(model.keys)), 0
            for b in batches(it):
                own = b.column("word").to_pylist()
                n += len(own)
                for _, rows in by_length(own):
                    total += model.expected(rows) if rows.shape[1] <= LONG_WORD else sum(map(model.expected_long, rows))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], n), pa.float64())], names=["piece", "n"])

        got = words.select("word").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        found = dict(zip(got["piece"].to_pylist(), got["n"].to_pylist(), strict=True))
        n_words = found.pop(-1, 0)
        if not found:
            return pieces
        weights = np.full(len(pieces.pieces), 0.01)
        for at, n in found.items():
            weights[pieces.order[at]] += n
        pieces = Pieces(pieces.pieces, weights, n_words / max(n_words + 1, sum(found.values())))
    return pieces


class TokenModel:
    """log10 probabilities of tokens given their counts, and the base's."""

    def __init__(self, pieces: Pieces, total: int, distinct: int, ends: int, discount: float):
        self.pieces, self.total, self.distinct, self.ends, self.discount = pieces, total, distinct, ends, discount
        self.log_new = math.log(discount * distinct / total if total else 0.5)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def words(self, words: list[bytes], c: np.ndarray) -> np.ndarray:
        spelt = np.empty(len(words))
        for places, rows in by_length(words):
            spelt[places] = self.pieces.log_spelt(rows)
        with np.errstate(divide="ignore"):
            seen = np.log(np.maximum(c - self.discount, 0) / max(self.total, 1))
        return np.logaddexp(seen, spelt + self.log_new) / LN10

    def end(self) -> float:
        return math.log10((self.ends - self.discount) / self.total if self.total else 0.5)


def _scored_words(model: TokenModel):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            words, c = b.column("word").to_pylist(), np.array(b.column("c").to_pylist(), np.float64)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(model.base(c)), pa.array(model.words(words, c))],
                                             names=["word", "c", "base", "score"])

    return run


def score_words(words: DataFrame, model: TokenModel) -> DataFrame:
    """(word, c) -> (word, c, base, score)."""
    return words.select("word", "c").mapInArrow(_scored_words(model), "word binary, c long, base double, score double")


PARTS = "row long, doc_id {id}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, n long"


def _parts(held: dict[bytes, tuple[float, float, bool]], end: tuple[float, float]):
    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches(it):
            docs, rare = [], []
            for text in b.column("text").to_pylist():
                count = Counter(tokens(text))
                known, base, score = 0, [end[0]], [end[1]]
                for w, n in count.items():
                    if (x := held.get(w)) is not None:
                        known += n
                        base.append(n * x[0])
                        score.append(n * x[1])
                    else:
                        rare.append((row, w, n))
                docs.append((row, count.total() + 1, known, math.fsum(base), math.fsum(score)))
                row += 1
            n, m = len(docs), len(rare)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            row_, tok, known_, base_, score_ = (pa.array([d[i] for d in docs], t) for i, t in enumerate(kinds))
            yield pa.RecordBatch.from_arrays(
                [row_, b.column("doc_id"), b.column("held_out"), tok, known_, base_, score_, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
            for i in range(0, m, 50_000):
                part = rare[i:i + 50_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.nulls(k, b.schema.field("doc_id").type), pa.nulls(k, pa.bool_()), *(pa.nulls(k, t) for t in kinds[1:]),
                     pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.int64())], names=names)

    names = [x.split()[0] for x in PARTS.split(", ")]
    return run


def scored(docs: DataFrame, held_out, pieces: list[bytes] | None = None, held_words: int = HELD_WORDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a Column; the documents where it is false are learnt from.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = materialise(word_counts(train), "word-counts")
    some = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    ends = train.count()
    total, distinct = some[0] + ends, some[1] + (ends > 0)
    discount = min(0.9, max(0.1, some[2] / max(1, some[2] + 2 * some[3])))
    model = TokenModel(fitted(Pieces(pieces or public_pieces()), counts), total, distinct, ends, discount)
    # The least count that at most held_words words reach: few distinct counts are ordered, no words.
    reach = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(reach))
    least = ranks.where(F.col("upto") <= held_words).agg(F.min("c")).first()[0]
    top = score_words(counts.where(F.col("c") >= F.lit(least)), model).toArrow()
    held = dict(zip(top["word"].to_pylist(), zip(top["base"].to_pylist(), top["score"].to_pylist(), strict=True), strict=True))
    ids = dict(docs.dtypes)["doc_id"]
    end = (float(model.base(np.float64(ends))), model.end())
    sent = spark.sparkContext.broadcast(held)
    parts = materialise(docs.mapInArrow(lambda it: _parts(sent.value, end)(it), PARTS.format(id=ids)), "word-parts")
    rare = parts.where(F.col("word").isNotNull()).select("row", "word", "n")
    words = rare.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("c", F.lit(0)).alias("c"))
    words = materialise(score_words(words, model), "word-scores")
    more = rare.join(words, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.col("base")).alias("b"), F.sum(F.col("n") * F.col("score")).alias("s"))
    zero = F.lit(0)
    return parts.where(F.col("word").isNull()).join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", zero) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("score") + F.coalesce("s", zero)).alias("score"))


def in_fold(doc_id, fold: int = 1, folds: int = 5):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op3."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, in_fold(F.col("doc_id")))
