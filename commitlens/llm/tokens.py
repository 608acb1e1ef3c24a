"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are ranged over tasks by doc_id and sorted, so the files in the order of their
partitions hold all documents in ascending doc_id order.  A task writes, under a name of its
own, ``<name>.ids`` (unsigned 16 or 32 bits, by the vocabulary's size), ``<name>.offsets``
(int64, one more than documents, from 0) and ``<name>.docs`` (int64 doc_ids), all
little-endian.  The manifest lists the files of the tasks that succeeded; prefix sums over
it give each file its bases, so a document starts at its file's base plus its offset.
A repeated task writes new files, and those of the lost one are in no manifest.

Defined cases: null text is empty and still gets its end id; rows of equal doc_id are ordered
by a hash of the text; a null doc_id sorts first and is stored as -2**63; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitlens.llm.common import batches, materialise, shared_path, table, text_hash
from commitlens.llm.files import make_folder, open_fs

NULL_ID = -(1 << 63)
END_ID = 1
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64
#: Latin words with trailing marks: one-to-one lower case, stable under NFC, split before the marks only.
_PLAIN, MARKS = re.compile(r"[a-zß-öø-ÿ]+"), b".,;:!?"


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of words, kept while there is room.

    This vocabulary's texts fall apart at white space, so a text's ids are its words'
    ids in order.  Plain Latin words go straight to the merges; the library's whole chain
    encodes all others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.merge, self.chars = self.whole.model.tokenize, _byte_chars()
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.bytes_of = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.whole.get_vocab_size())]

    def __missing__(self, word: bytes) -> bytes:
        run = word.rstrip(MARKS)
        if run.isalpha():  # of bytes: Latin letters without accents
            low = run.lower()
            ids = b"".join([self.bytes_of[t.id] for t in self.merge(low.decode())]) if low == word else self[low]
        elif len(word) <= CACHE_BYTES and (plain := _PLAIN.fullmatch((text := run.decode()).lower())) and max(text) < "Ā":
            low = plain[0].encode()
            spelt = plain[0].encode().decode("latin-1").translate(self.chars)
            ids = b"".join([self.bytes_of[t.id] for t in self.merge(spelt)]) if low == word else self[low]
        else:
            run, text = word, word.decode()
            ids = b"".join([self.bytes_of[i] for i in self.whole.encode(text, add_special_tokens=False).ids])
        if len(run) < len(word):
            ids += self[word[len(run):]]
        if len(word) <= CACHE_BYTES:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, (fs, at), name = _encoder(vocabulary), open_fs(folder), uuid.uuid4().hex
        end, width, docs, total = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize, 0, 0
        out = None
        for b in batches(it):
            if out is None:
                out = [fs.open_output_stream(f"{at}/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                out[1].write(np.zeros(1, "<i8").tobytes())
            ids = [encoder.encode(t) + end for t in b.column("text").to_pylist()]
            offsets = total + np.cumsum([len(x) // width for x in ids], dtype="<i8")
            out[0].write(b"".join(ids))
            out[1].write(offsets.tobytes())
            out[2].write(np.array([NULL_ID if x is None else x for x in b.column("doc_id").to_pylist()], "<i8").tobytes())
            docs, total = docs + len(ids), int(offsets[-1])
        if out is not None:
            for stream in out:
                stream.close()
            yield pa.RecordBatch.from_pylist([{"place": TaskContext.get().partitionId(), "file": f"{folder}/{name}", "width": width, "docs": docs, "ids": total}])

    return write


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents' ids; the manifest: place, file, width, docs, ids, first_doc, first_id."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token-ids")
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("_th"), "text")
    rows = rows.repartitionByRange("doc_id", "_th").sortWithinPartitions("doc_id", "_th").select("doc_id", "text")
    files = materialise(rows.mapInArrow(_writer(folder, vocabulary, end_id), "place long, file string, width long, docs long, ids long"), "token-manifest")
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # over files, not documents
    return files.withColumn("first_doc", F.coalesce(F.sum("docs").over(before), F.lit(0))).withColumn(
        "first_id", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def open_array(path: str, dtype: str) -> np.ndarray:
    """Memory-mapped where the folder is a mounted one, else read whole."""
    fs, at = open_fs(path)
    if fs.type_name == "local":
        return np.memmap(at, dtype, "r")
    with fs.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


def _digests(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it):
        for row in b.to_pylist():
            ids = open_array(row["file"] + ".ids", f"<u{row['width']}")
            offsets, docs = open_array(row["file"] + ".offsets", "<i8"), open_array(row["file"] + ".docs", "<i8")
            for i in range(0, len(docs), 10_000):
                part, upto = docs[i:i + 10_000], offsets[i:i + 10_001]
                crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(part), pa.int64(), mask=np.asarray(part) == NULL_ID), pa.array(row["first_id"] + np.asarray(upto[:-1]), pa.int64()),
                     pa.array(np.diff(upto), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its first id's place among all ids, its ids and their checksum."""
    files = materialise(manifest, "token-bases")
    return files.repartition(max(1, files.count())).mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4."""
    return read_digests(write_ids(table(spark, sf_dir, "documents"), public_vocabulary()))
