"""WARC archives with revisit resolution.

``write_archives`` writes a response record per page, each a gzip member of its own, and
returns an index of the records.  ``resolve`` shuffles only the index by payload digest: of
the records with one digest the last page is the original and the others revisit it.
``write_deduplicated`` streams each archive once more, with the decisions on its own
records, and writes the responses and short revisit records under fresh headers.
``read_archives`` reads what the archives hold.  Payloads are never shuffled.

A task writes files of its own name, and the index lists those of the tasks that
succeeded; what a lost task left is in no index.

Defined cases: null html is an empty payload; a null page_id is written as ``null`` and
sorts first; of repeated rows of the last page one is the original; payloads shorter than
``min_bytes`` are never merged; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import batches, materialise, shared_path, table
from commitlens.llm.files import make_folder, open_fs

MIN_BYTES, FILE_BYTES, LEVEL, CHUNK = 0, 512 << 20, 3, 1 << 14
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, digest string, payload_bytes long, file string, at long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def record(kind: str, page: str, name: str, url: str | None, payload: bytes, length: int, digest: str,
           refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record, compressed.  A revisit keeps the HTTP headers, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}:{name}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(http) + len(payload)}")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def records(stream) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """Place, WARC headers, HTTP headers and payload of each record; one is held at a time."""
    pairs = lambda lines: dict(x.split(": ", 1) for x in lines.decode().split("\r\n")[1:])
    left, at = b"", 0
    while left := left or stream.read(CHUNK):
        member, start, parts = zlib.decompressobj(31), at, []
        while not member.eof:
            if not (left := left or stream.read(CHUNK)):
                raise EOFError("a record is cut")
            parts.append(member.decompress(left))
            at += len(left) - len(member.unused_data)
            left = member.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        warc = pairs(head)
        http, _, payload = rest[:int(warc["Content-Length"])].partition(b"\r\n\r\n")
        yield start, warc, pairs(http), payload


class Archives:
    """The files one task writes; a new one when the last is full."""

    def __init__(self, folder: str):
        self.folder, (self.fs, self.at), self.out, self.size = folder, open_fs(folder), None, 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.size >= FILE_BYTES:
            self.close()
            self.name, self.size = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.at}/{self.name}")
        self.out.write(data)
        self.size += len(data)
        return self.name, self.size - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def _id(page) -> str:
    return "null" if page is None else str(page)


def _writer(folder: str):
    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, n = Archives(folder), 0
        for b in batches(it):
            out = []
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode()
                digest = digest_of(payload)
                file, at = archives.add(record("response", _id(page), uuid.uuid4().hex, url, payload, len(payload), digest))
                out.append((page, digest, len(payload), f"{folder}/{file}", at))
            yield _rows(out, [("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("file", pa.string()), ("at", pa.int64())])
        archives.close()

    return write


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame) -> DataFrame:
    """Write a response record per page; the index of all records."""
    folder = shared_path(pages.sparkSession, "warc")
    make_folder(folder)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return materialise(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


def resolve(index: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(file, at, original): the records that revisit another, which ``original`` places."""
    place = F.struct("page_id", "file", "at")
    large = index.where(F.col("payload_bytes") >= min_bytes).select("digest", place.alias("own"))
    originals = large.groupBy("digest").agg(F.max("own").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    originals = materialise(originals, "warc-originals")  # so that a digest with many records can be split in the join
    return large.join(originals, "digest").where(F.col("own") != F.col("original")).select("own.file", "own.at", "original")


def _rewriter(folder: str):
    def write(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for b in batches(it):
            for row in b.to_pylist():
                revisits = {r["at"]: r["original"] for r in row["revisits"] or ()}
                fs, path = open_fs(row["file"])
                stem, made = row["file"].rpartition("/")[2].partition(".")[0], {}
                with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for at, warc, http, payload in records(stream):
                        page, digest = warc["WARC-Record-ID"].split(":")[2], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                        o = revisits.get(at)
                        to = o and f"urn:page:{_id(o['page_id'])}:{o['file'].rpartition('/')[2].partition('.')[0]}-{o['at']}"
                        file, _ = archives.add(record("revisit" if o else "response", page, f"{stem}-{at}", None if (u := warc.get("WARC-Target-URI")) is None else u,
                                                      b"" if o else payload, int(http["Content-Length"]), digest, to))
                        made[file] = made.get(file, 0) + 1
                yield _rows([(f"{folder}/{f}", n) for f, n in made.items()], [("file", pa.string()), ("n", pa.int64())])
        archives.close()

    return write


def write_deduplicated(index: DataFrame, revisits: DataFrame) -> DataFrame:
    """Write the archives anew; (file, n): records per new file, a file may be listed more than once."""
    folder = shared_path(index.sparkSession, "warc-deduplicated")
    make_folder(folder)
    # A file's own revisits only: FILE_BYTES bounds its records.
    own = revisits.groupBy("file").agg(F.collect_list(F.struct("at", "original")).alias("revisits"))
    files = materialise(index.select("file").distinct().join(own, "file", "left"), "warc-decisions")
    return materialise(files.repartition(max(1, files.count())).mapInArrow(_rewriter(folder), "file string, n long"), "warc-files")


def _reader(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    number = lambda urn: None if (x := urn.split(":")[2]) == "null" else int(x)
    for b in batches(it):
        for file in b.column("file").to_pylist():
            fs, path = open_fs(file)
            out = []
            with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                for _, warc, http, payload in records(stream):
                    kind, to, digest = warc["WARC-Type"], warc.get("WARC-Refers-To"), warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"{file}: a payload does not match its digest")
                    out.append((number(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, to and number(to)))
                    if len(out) >= 10_000:
                        yield _rows(out, fields)
                        out = []
            if out:
                yield _rows(out, fields)


def read_archives(files: DataFrame) -> DataFrame:
    """A row per record of the files."""
    files = files.select("file").distinct()
    return files.repartition(max(1, files.count())).mapInArrow(
        _reader, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2."""
    index = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(write_deduplicated(index, resolve(index)))
