"""WARC archives packaged in ZIP files, written and read by range.

An archive is a ZIP whose members are *stored*: ``archive/data.warc.gz``, WARC 1.1
records in one gzip member each, and ``indexes/index.cdxj``, a line of JSON for each
record with its offset and length in the first.  The reader takes the end of the
file, finds the end-of-central-directory record (and the ZIP64 one, which is
there as soon as a size or an offset passes 32 bits or a count 16), reads the
central directory, locates the members' bytes from their local headers, and then
reads single records by offset.  Nothing is unpacked to disk, and no archive is
read whole.

Duplicates: of records with equal payloads the one with the largest page_id is a
response, the others are ``revisit`` records that refer to it and carry its HTTP
header without the payload.

Files go through pyarrow's filesystems (local, HDFS, S3 and others by URI) into a
folder below spark.checkpoint.dir, which all executors share.  A task writes to a
name of its own attempt and renames when complete; the names that count are those
the tasks return, so a lost or repeated task leaves no wrong archive.

Edge cases: a null payload is empty; empty payloads are duplicates of each other
like any other.  Null page ids: never the response while another id is there.
Repeated rows with the largest id, which tie, are all responses.  A very long payload is one
record, held whole by one task.  A table without rows writes no archive.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import prepare, shared_folder

#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed when it holds so many bytes.
ARCHIVE_BYTES = 64 << 20
#: What a reading task holds before it sends records on, and the most tasks that read.
HELD_RECORDS, HELD_BYTES, READ_TASKS = 500, 8 << 20, 20_000
_DATE = "2024-01-01T00:00:00Z"


class ZipWriter:
    """Stored members, one after the other, into a binary stream; ``force64`` writes ZIP64 fields always."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.force64, self.entries = out, 0, force64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, size: int, crc: int, chunks) -> None:
        start, raw, wide = self.at, name.encode(), self.force64 or size >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = MAX32 if wide else size
        self._put(LOCAL + struct.pack("<5H3I2H", 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, short, short, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self._put(chunk)
        self.entries.append((raw, size, crc, start))

    def close(self) -> None:
        begin = self.at
        for raw, size, crc, start in self.entries:
            wide = self.force64 or size >= MAX32 or start >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if wide else b""
            short, offset = (MAX32, MAX32) if wide else (size, start)
            self._put(CENTRAL + struct.pack("<6H3I5H2I", 45, 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        length, count = self.at - begin, len(self.entries)
        if self.force64 or begin >= MAX32 or count >= MAX16:
            end64 = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            begin, count = MAX32, MAX16
        self._put(END + struct.pack("<HHHHIIH", 0, 0, count, count, min(length, MAX32), begin, 0))


class ZipReader:
    """Members of a ZIP, found through its directories; ``read(offset, length)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail_at = max(0, size - 22 - MAX16)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the mark can also stand in a comment
        if at < 0:
            raise ValueError("not a ZIP archive")
        count, length, begin = struct.unpack_from("<HII", tail, at + 10)
        if begin == MAX32 or count == MAX16 or length == MAX32:
            locator = read(tail_at + at - 20, 20)
            if locator[:4] == LOCATOR64:
                end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64:
                    raise ValueError("damaged ZIP64 directory")
                count, length, begin = struct.unpack_from("<QQQ", end64, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        directory, p = read(begin, length), 0
        for _ in range(count):
            if directory[p : p + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method, crc, packed, plain = struct.unpack_from("<H4xIII", directory, p + 10)
            names, extras, comments = struct.unpack_from("<HHH", directory, p + 28)
            start = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + names].decode("utf-8", "replace")
            extra = directory[p + 46 + names : p + 46 + names + extras]
            q = 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # the fields that didn't fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                    plain = next(wide) if plain == MAX32 else plain
                    packed = next(wide) if packed == MAX32 else packed
                    start = next(wide) if start == MAX32 else start
                q += 4 + n
            self.members[name] = (start, packed, method, crc)
            p += 46 + names + extras + comments

    def range_of(self, name: str) -> tuple[int, int]:
        """(offset in the file, length) of a stored member."""
        start, size, method, _ = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(start, 30)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return start + 30 + names + extras, size


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response, or with a revisit of the page ``refers_to``."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {''.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one gzip member."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class _Archive:
    """Collects records of one task in a spool file beside the archive, then packs both members."""

    def __init__(self, files: fs.FileSystem, folder: str):
        self.files, self.name = files, f"{folder}/{uuid.uuid4().hex}"
        self.spool = files.open_output_stream(f"{self.name}.part")
        self.at, self.crc, self.index = 0, 0, []

    def add(self, record: bytes, **entry) -> None:
        self.spool.write(record)
        self.crc = zlib.crc32(record, self.crc)
        self.index.append(json.dumps(entry | {"offset": self.at, "length": len(record)}))
        self.at += len(record)

    def close(self) -> tuple[str, int]:
        self.spool.close()
        index = ("\n".join(self.index) + "\n").encode()
        with self.files.open_output_stream(f"{self.name}.tmp") as out:
            pack = ZipWriter(out)
            pack.member(INDEX, len(index), zlib.crc32(index), [index])
            with self.files.open_input_stream(f"{self.name}.part") as spooled:
                pack.member(DATA, self.at, self.crc, iter(lambda: spooled.read(1 << 20), b""))
            pack.close()
        self.files.delete_file(f"{self.name}.part")
        self.files.move(f"{self.name}.tmp", f"{self.name}.wacz")
        return f"{self.name}.wacz", len(self.index)


def _write(uri: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(uri)
        done, archive = [], None
        for batch in batches:
            for page, url, html, last in zip(*(batch.column(x) for x in ("page_id", "url", "html", "last_id")), strict=True):
                page, last, payload = page.as_py(), last.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass")
                archive = archive or _Archive(files, folder)
                revisit = page != last
                archive.add(warc_record(page, url.as_py(), payload, last, revisit), url=url.as_py(), page=page, digest=payload_digest(payload), mime="warc/revisit" if revisit else "text/html")
                if archive.at >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    return rows


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to ZIP archives in ``folder`` (a URI); (path, records) of each, once written."""
    prepare(pages.sparkSession)
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    last = pages.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last_id"))
    return pages.join(last, F.col("digest") == F.col("d")).select("page_id", "url", "html", "last_id").mapInArrow(_write(folder), "path string, records long").checkpoint()


@dataclass
class _Range:
    """Range reads of one file."""

    file: pa.NativeFile

    def __call__(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)


def _read(uri: str, payloads: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(uri)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_file(path) as file:
                    read = _Range(file)
                    zipped = ZipReader(read, file.size())
                    data_at, _ = zipped.range_of(DATA)
                    held: list[tuple] = []
                    size = 0
                    for line in read(*zipped.range_of(INDEX)).splitlines():
                        entry = json.loads(line)
                        warc, http, payload = parse_record(read(data_at + entry["offset"], entry["length"]))
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        revisit = warc["warc-type"] == "revisit"
                        if not revisit and payload_digest(payload) != digest:
                            raise ValueError(f"damaged record at {entry['offset']} of {path}")
                        page, refers = warc.get("warc-page-id"), warc.get("warc-refers-to-page-id")
                        held.append((int(page) if page else None, entry["url"], int(http["content-length"]), digest, warc["warc-type"], int(refers) if refers else None, *[payload] * payloads))
                        size += len(payload) * payloads
                        if len(held) == HELD_RECORDS or size >= HELD_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return rows


def read_archives(archives: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if wanted) of every record of ``archives`` (path).

    Archives are dealt to as many tasks as there are archives, ``READ_TASKS`` at most, which adaptive execution leaves as they are.
    """
    tasks = max(1, min(READ_TASKS, archives.count()))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return archives.select("path").repartition(tasks).mapInArrow(_read(folder, payloads), schema)


def archive_folder(spark) -> str:
    """A new folder below the checkpoint directory, as a URI."""
    # Named in full, as a folder without a scheme is on the cluster's default file system, not on this machine's.
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}")
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri
