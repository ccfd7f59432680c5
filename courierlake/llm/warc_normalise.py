"""WARC archives, and the normaliser of monolithic gzip ones.

A monolithic archive is a whole WARC file in one gzip stream, which cannot be
read from the middle. The normaliser inflates such a stream once, in pieces,
cuts it into records by their Content-Length, writes every record as a gzip
member of its own, and lists (offset, length) of each member in a sidecar
index. Any record can then be read by inflating its own member alone.

Archives are files in a folder that all executors share (any file system that
Arrow opens by its address). A task writes under a temporary name and renames;
the tables that name the files come from finished tasks only, so what a lost
executor left behind is read by nobody. An archive is bounded: a writer task
starts a new one at ARCHIVE_BYTES of payload, and a single longer payload has
one alone. A worker holds one record, never an archive.

Equal payloads: of records whose payload has at least `least` bytes, the one
with the smallest page_id is a response and the others are revisits of it. The
first holder comes from an aggregate by digest (combined before the shuffle)
and goes back to the pages by page_id, url and digest, so a page copied to a
third of all rows makes no hot key.

Defined results: a null html is an empty payload; a null url becomes
`urn:page:<id>`; a null page_id takes part in no revisit and is written as a
response. Of rows that repeat a page_id with an equal payload, the one with the
smallest url is the response; of wholly equal rows one is, and the others are
revisits of the same page_id, however the rows are dealt. Very long payloads
are written whole; empty tables give no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import IO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop, rows_of, scratch_path, settled, slices, small_batches

ARCHIVE_BYTES = 64 << 20
LEVEL = 1
BLOCK = 1 << 16
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LENGTH = re.compile(rb"^content-length:\s*(\d+)\s*$", re.I | re.M)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = field(repr=False, default=b"")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header in the block."""
        return self.block.partition(b"\r\n\r\n")[2]


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    """A header value; line breaks would end the header."""
    return re.sub(r"[\r\n]+", " ", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and length of its payload only."""
    block = HTTP + (payload if refers_to is None else b"")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {one_line(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(["WARC/1.1", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    headers = {k.strip().lower(): v.strip() for k, _, v in pairs}
    return Record(headers, rest[: int(headers["content-length"])])


def inflate(source: IO[bytes]) -> Iterator[bytes]:
    """Pieces of the stream; further members of a mixed archive follow on."""
    data = source.read(BLOCK)
    while data:
        d = zlib.decompressobj(31)
        while not d.eof:
            piece = d.decompress(data, BLOCK)
            data = d.unconsumed_tail or (b"" if d.eof else source.read(BLOCK))
            if piece:
                yield piece
            elif not data and not d.eof:
                raise ValueError("the gzip stream is cut off")
        data = d.unused_data or source.read(BLOCK)


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Raw records of a WARC stream; only the record being read is held."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                start = re.match(rb"[\r\n]*", held).end()
                at = held.find(b"\r\n\r\n", start)
                if at < 0:
                    break
                found = LENGTH.search(held[start : at + 2].replace(b"\r\n", b"\n"))
                if not found:
                    raise ValueError("a record has no Content-Length")
                del held[:start]
                need = at - start + 4 + int(found[1])
            if len(held) < need + 4:
                break
            yield bytes(held[: need + 4])
            del held[: need + 4]
            need = 0
    if bytes(held).strip(b"\r\n"):
        raise ValueError("the last record is cut off")


def member(raw: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def normalise(source: IO[bytes], sink: IO[bytes]) -> list[tuple[int, int]]:
    """Rewrite an archive with a member per record; (offset, length) of each."""
    index, at = [], 0
    for raw in split_records(inflate(source)):
        made = member(raw)
        sink.write(made)
        index.append((at, len(made)))
        at += len(made)
    return index


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, as an address that Arrow opens too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, kind))
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", whole)


class Folder:
    """Files of a folder given by its address."""

    def __init__(self, address: str) -> None:
        self.files, self.path = pafs.FileSystem.from_uri(address)
        self.files.create_dir(self.path, recursive=True)

    def opened(self, name: str) -> tuple[str, IO[bytes]]:
        """A temporary name and its stream."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        return part, self.files.open_output_stream(f"{self.path}/{part}", compression=None)

    def finish(self, part: str, name: str) -> None:
        self.files.move(f"{self.path}/{part}", f"{self.path}/{name}")


def read_file(address: str) -> pa.NativeFile:
    files, path = pafs.FileSystem.from_uri(address)
    return files.open_input_file(path)


def with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """page_id, url, html and refers_to (null: a response)."""
    small_batches(pages.sparkSession)
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"].cast("string"), F.lit("")).alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("d", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    row = ["page_id", "url", "d"]
    held = cut(own.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select(*row))
    first = held.groupBy("d").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select("d", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))
    told = held.join(first, "d").groupBy(*row).agg(F.min("first_id").alias("first_id"), F.min("first_url").alias("first_url"), F.count("*").alias("same"))
    is_first = (F.col("page_id") == F.col("first_id")) & (F.col("url") == F.col("first_url"))
    told = cut(told.withColumn("response", is_first).where("not response or same > 1"))
    drop(held)
    drop(first)
    revisits = told.where("not response").select(*row, F.col("first_id").alias("refers_to"))
    out = own.join(revisits, row, "left")
    again = told.where("response").select(*row, "same")
    if not again.isEmpty():  # equal rows of the response: one of them stays, the others follow
        one = own.join(again, row).dropDuplicates(row).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "same")))
        several = one.withColumn("refers_to", F.when(F.col("k") > 1, F.col("page_id")))
        out = out.join(again, row, "left_anti").select(*own.columns, "refers_to").unionByName(several.select(*own.columns, "refers_to"))
    return out.select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages to monolithic archives of the folder; archive (its address) and records. Nothing is written before the result is used."""
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Folder(folder)
        stream, c, held, n, name, part = None, None, 0, 0, "", ""

        def finished() -> pa.RecordBatch:
            stream.write(c.flush())
            stream.close()
            place.finish(part, name)
            return rows_of(schema, archive=[f"{folder}/{name}"], records=[n])

        for b in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(b.column(x).to_pylist() for x in ("page_id", "url", "html", "refers_to")), strict=True):
                if stream is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    part, stream = place.opened(name)
                    c, held, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                payload = html.encode()
                stream.write(c.compress(record_bytes(page_id, url, payload, digest(payload), refers_to)))
                held, n = held + len(payload), n + 1
                if held >= ARCHIVE_BYTES:
                    yield finished()
                    stream = None
        if stream is not None:
            yield finished()

    return with_revisits(pages, least).mapInArrow(run, "archive string, records long")


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite the named archives, a member per record, to the folder with a sidecar index each: archive, index (addresses) and records."""
    schema = pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Folder(folder)
        for b in batches:
            for address in b.column("archive").to_pylist():
                name = address.rsplit("/", 1)[1]
                part, sink = place.opened(name)
                with read_file(address) as source, sink:
                    index = normalise(source, sink)
                listed, lines = place.opened(f"{name}.idx")
                with lines:
                    lines.write("".join(f"{at}\t{n}\n" for at, n in index).encode())
                place.finish(listed, f"{name}.idx")
                place.finish(part, name)
                yield rows_of(schema, archive=[f"{folder}/{name}"], index=[f"{folder}/{name}.idx"], records=[len(index)])

    return archives.select("archive").mapInArrow(run, "archive string, index string, records long")


def read_records(archives: DataFrame) -> DataFrame:
    """What each record of normalised archives says, read at its offset in the sidecar index; the payload of a response must have its digest."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def read(source: pa.NativeFile, at: int, length: int) -> dict[str, object]:
        source.seek(at)
        r = parse(zlib.decompress(source.read(length), 31))
        told = r.headers["warc-payload-digest"].removeprefix("sha1:")
        kind, size = r.headers["warc-type"], int(r.headers["x-payload-length"])
        if kind == "response" and (digest(r.payload) != told or len(r.payload) != size):
            raise ValueError("a payload does not match its digest")
        return {"page_id": number(r.headers["warc-record-id"]), "url": r.headers["warc-target-uri"], "payload_bytes": size, "payload_digest": told, "record_type": kind, "refers_to": number(r.headers.get("warc-refers-to"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address, index in zip(b.column("archive").to_pylist(), b.column("index").to_pylist(), strict=True):
                with read_file(index) as listed:
                    places = [tuple(map(int, line.split())) for line in listed.read().splitlines()]
                with read_file(address) as source:
                    for first in range(0, len(places), 1024):
                        yield pa.RecordBatch.from_pylist([read(source, at, n) for at, n in places[first : first + 1024]], schema=schema)

    return archives.select("archive", "index").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """The records of all pages, written to monolithic archives in the shared folder, normalised there and read back; the archives are deleted when they are read."""
    spark = pages.sparkSession

    def make() -> DataFrame:
        written = cut(write_archives(pages, new_folder(spark, "warc"), least))
        return read_records(cut(normalised(written, new_folder(spark, "warc"))))

    return settled(spark, make)
