"""Best-fit packing of documents into sequences by the sum of squares.

A document's ids with an end id are one piece, or, if longer than a sequence, pieces of whole sequences
behind a shorter first one.  Pieces are dealt at random over packing tasks of ``TASK_PIECES`` each, so
that every task sees the same mix of lengths.  A task takes its pieces longest first.  Let N(g) be the
number of its open sequences with g places left: a piece goes into the open sequence by which the sum of
all N(g)^2 becomes smallest; ties take the one with the fewest places left.  Full sequences leave the sum.
A new sequence is begun only where no open one has room (left to the sum as well, it would begin 0.4 % more
at the end, where all counts are small).  Open counts that stay small keep many different gaps at hand, so
the short pieces at the end find one that they fill.

The sum over gaps is held as one array, so a piece costs one pass over at most ``capacity`` numbers.  A
task holds the lengths of its pieces only, never their ids: these stay in the table of pieces, written once.
``sequences`` joins them back, one row per sequence.

Defined cases: null and empty texts are one piece of the end id alone; repeated documents are packed each;
an empty table gives an empty result; a null doc_id stays null; columns other than the id and the text
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import batches, materialise, table
from commitlens.llm.tokens import _byte_chars, public_vocabulary

CAPACITY, END_ID = 2048, 0
TASK_PIECES = 100_000
GROUP_BYTES = 16 << 20
#: What the vocabulary's pattern makes of texts without two white spaces in a row: it needs no look ahead.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _joined(texts: pa.Array) -> str:
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return pc.binary_join(whole, "")[0].as_py()


class ByteEncoder:
    """Ids of many texts at once by a byte-level vocabulary.

    Its pattern parts a text before every space that begins a word, so a text's ids are those of its words, each with
    the space before it, in order.  Each distinct word is merged once (by tiktoken, from the vocabulary's own
    ranks) and its ids are gathered for every place.  Texts with two white spaces in a row, an added token or a
    zero byte go through the tokenizers library whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole, chars = Tokenizer.from_file(path), {c: b for b, c in _byte_chars().items()}
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {bytes(map(chars.__getitem__, w)): i for w, i in self.whole.get_vocab(with_added_tokens=False).items() if w not in self.added}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(w) for w in ranks]
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.odd = "|".join([_SPACE + "{2}", r"\x00", *map(re.escape, self.added)])

    def by_library(self, text: str | None) -> np.ndarray:
        return np.array(self.whole.encode(text or "", add_special_tokens=False).ids, self.dtype)

    def _merged(self, joined: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined words, and the number of ids up to each of the given byte places."""
        ids = np.array(self.words.encode_ordinary(joined), self.dtype)
        return ids, np.searchsorted(np.cumsum(self.width[ids]), ends) + 1

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and the first place and the number of each word's."""
        spaced = pc.starts_with(words, " ")
        inner, head = words.filter(spaced), words.filter(pc.invert(spaced))  # heads begin a text; line ends part them here
        ids, cuts = self._merged(_joined(inner), np.cumsum(pc.binary_length(inner).to_numpy()))
        more, ends = self._merged("".join([w + "\n" for w in head.to_pylist()]), np.cumsum(pc.binary_length(head).to_numpy() + 1))
        first, count = np.empty((2, len(words)), np.int64)
        spaced = spaced.to_numpy(zero_copy_only=False)
        for of, last, base, line in ((spaced, cuts, 0, 0), (~spaced, ends, len(ids), 1)):
            many = np.diff(last, prepend=0)
            first[of], count[of] = base + last - many, many - line
        return np.concatenate([ids, more]), first, count

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(pc.replace_substring(plain, " ", "\0 "), "\0")
        words = parts.flatten().dictionary_encode()
        ids, first, count = self._distinct(words.dictionary)
        at = words.indices.to_numpy()
        many = count[at]
        upto = np.cumsum(many)
        ids = ids[np.repeat(first[at] - upto + many, many) + np.arange(upto[-1] if len(upto) else 0)]
        ends = np.concatenate([[0], upto])[np.cumsum(parts.value_lengths().to_numpy())]
        out = np.split(ids, ends[:-1])
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.by_library(texts[i].as_py())
        return out


@lru_cache(1)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences behind a shorter first piece."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)] if n > capacity else [0]
    return [(a, z - a) for a, z in zip(starts, [*starts[1:], n], strict=True)]


def _tokenizer(vocabulary: str, capacity: int, end_id: int):
    def split(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key = _encoder(vocabulary), TaskContext.get().partitionId() << 33
        end = np.array([end_id], encoder.dtype)
        for b in batches(it):
            texts, at = b.column("text"), 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES, "right")))
                rows = []
                for i, ids in enumerate(encoder.encode(texts.slice(at, upto - at)), at):
                    ids = np.append(ids, end)
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start:start + n]
                        rows.append((key, i, k, start, n, zlib.crc32(own.astype("<u4").tobytes()), own.tobytes()))
                        key += 1
                at = upto
                keys, row, piece, start, n, crc, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    names=["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return split


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Write every document's pieces: key (unique), doc_id, piece, start, length, ids_crc32 and ids, which
    are little-endian unsigned numbers of 16 bits, or of 32 where the vocabulary has more ids."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = dict(rows.dtypes)["doc_id"]
    return materialise(rows.mapInArrow(_tokenizer(vocabulary, capacity, end_id),
                                       f"key long, doc_id {id_type}, piece int, start long, length long, ids_crc32 long, ids binary"), "packing-pieces")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of its sequence and place in it for each length, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by places left
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made, never = 0, 4 * len(lengths) + 4
    for i, n in enumerate(lengths.tolist()):
        # the change of the sum, by places left before: one sequence fewer there, one more at n places less
        change = np.where(count[n:], 1 - 2 * count[n:], never)
        change[1:] += 2 * count[1:capacity + 1 - n] + 1
        gap = n + int(change.argmin())
        if not count[gap]:  # none has room
            gap, at = capacity, made
            made += 1
        else:
            at = open_[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > n:
            open_[gap - n].append(at)
            count[gap - n] += 1
    return sequence, offset


def _packer(capacity: int):
    def pack(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches(it)]
        if not rows:
            return
        rows = pa.Table.from_batches(rows)
        sequence, offset = sum_of_squares(rows.column("length").to_numpy(), capacity)
        base = TaskContext.get().partitionId() << 33
        out = rows.append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches(max_chunksize=50_000)

    return pack


def packed(parts: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Give each piece (of any table with a unique ``key`` and a ``length``) a sequence_id and its offset there;
    ids stay behind, and columns of these two names are replaced."""
    parts = parts.drop("sequence_id", "offset", "ids")
    tasks = -(-parts.count() // task_pieces) or 1
    dealt = parts.repartition(tasks, F.xxhash64("key", F.lit("packing"))).sortWithinPartitions(F.desc("length"), "key")
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.mapInArrow(_packer(capacity), schema)


def sequences(parts: DataFrame, places: DataFrame) -> DataFrame:
    """sequence_id, length, ids and the documents in it (doc_id, piece, offset, length), by offset."""
    rows = places.select("key", "sequence_id", "offset").join(parts, "key")
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))  # at most a sequence's ids
    rows = rows.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("length"))
    joined = F.reduce("held", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    docs = F.transform("held", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return rows.select("sequence_id", "length", joined.alias("ids"), docs.alias("docs"))


def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op13."""
    parts = pieces(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))
    return packed(parts).drop("key")
