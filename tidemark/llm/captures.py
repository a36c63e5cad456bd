"""WARC archives with a two-level capture index.

Archives are WARC/1.1 with one gzip member for each record: a warcinfo record, then
HTTP responses and revisits, so a record is read by its offset and length alone. The
index's lines, sorted by reversed-host URL key, lie in compressed blocks of
``BLOCK_LINES``; at the end of an index file stands the sparse directory of its blocks
(first key, offset, length). A look-up searches the first keys of the index files, then
one file's directory, then reads one block's range, searches it, and reads the records'
ranges. Executors do so for many URLs at once.

Every task writes files under names of its own into the shared folder and returns them
as rows, so files of a task that was lost or repeated are never read. The folder is
opened by pyarrow's file systems (local and mounted paths, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle, shared_dir, stored

ARCHIVE_BYTES, BLOCK_LINES = 64 << 20, 1024
#: A payload under this many bytes is never a revisit.
LEAST_REVISIT = 1000
#: Records that a task reads before it hands them on.
READ = 64
TRAILER = ">QQ"
INDEX_SCHEMA = "surt string, capture long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
DIRECTORY_SCHEMA = "first_surt string, first_capture long, file string, offset long, length long, lines long"


def surt(url: str | None) -> str:
    """The URL with its host reversed: ``org,example,www)/path?query``; lower-case, without scheme, user, default port and fragment."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://")) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def warc_record(fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def record_id(capture: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{capture}:{digest}')}>"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an uncompressed record; raises ValueError when it is malformed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length")
    return fields, rest[:size]


def target_uri(url: str | None, capture: int | None) -> str:
    """The URL as a valid URI: other characters percent-encoded, a name of its own where there is none."""
    clean = quote((url or "").strip(), safe="%/:=&?~#+!$,;'@()*[]")
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:.", clean):
        return clean
    return f"urn:capture:{capture}:{clean}"


def sha1_label(digest: str) -> str:
    return f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"


def sha1_hex(label: str) -> str:
    return base64.b32decode(label.removeprefix("sha1:")).hex()


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def info_record(name: str, date: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, b"format: WARC File Format 1.1\r\n")


def page_record(r: dict, date: str) -> bytes:
    """The response or revisit record of a capture."""
    payload, uri = r["body"].encode(), target_uri(r["url"], r["capture"])
    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", record_id(r["capture"], r["payload_digest"])), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", sha1_label(r["payload_digest"])), ("WARC-Capture-Number", json.dumps(r["capture"]))]
    if uri != r["url"]:
        fields.append(("WARC-Original-URL", json.dumps(r["url"])))
    if r["record_type"] == "response":
        return warc_record(fields, http_head(len(payload)) + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["refers_to"], r["payload_digest"])), ("WARC-Refers-To-Number", str(r["refers_to"]))]
    return warc_record(fields, http_head(len(payload)))


def read_record(data: bytes, bodies: bool) -> tuple:
    """(capture, url, type, refers_to, digest, bytes, body) of a record; digest and size of a response are those of its payload, of a revisit those that it states."""
    fields, block = parse_record(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    url = json.loads(fields["WARC-Original-URL"]) if "WARC-Original-URL" in fields else fields["WARC-Target-URI"]
    number = json.loads(fields["WARC-Capture-Number"])
    if fields["WARC-Type"] == "revisit":
        return number, url, "revisit", int(fields["WARC-Refers-To-Number"]), sha1_hex(fields["WARC-Payload-Digest"]), stated, None
    digest = hashlib.sha1(payload).hexdigest()
    if len(payload) != stated or digest != sha1_hex(fields["WARC-Payload-Digest"]):
        raise ValueError(f"a payload of capture {number} that is not the one written")
    return number, url, "response", None, digest, stated, payload.decode() if bodies else None


@dataclass(frozen=True)
class Capture:
    """What ``write_archives`` leaves: the folder, the captures and the block directory."""

    folder: str
    directory: DataFrame


def typed_captures(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    """(capture, url, body, payload_digest, payload_bytes, record_type, refers_to).

    Of equal payloads of at least LEAST_REVISIT bytes the one with the largest id is the
    response; rows that repeat that id too, and rows whose id is null, are responses.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("capture"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumn("payload_digest", F.sha1("body")).withColumn("payload_bytes", F.octet_length("body").cast("long"))
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).where("capture is not null")
    repeated = large.groupBy("payload_digest", "payload_bytes").agg(F.max("capture").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # With its real size Spark sees whether it can be broadcast; then no body is shuffled.
    repeated = stored(repeated)
    rows = rows.join(repeated, ["payload_digest", "payload_bytes"], "left")
    again = F.col("capture") < F.col("last")
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("last"))).drop("last")


def archive_writer(folder: str, date: str):
    """Writes the records of a partition to archives of about ARCHIVE_BYTES and yields an index row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                        info = gzip_member(info_record(name, date))
                        out.write(info)
                        at = len(info)
                    member = gzip_member(page_record(r, date))
                    out.write(member)
                    rows.append((surt(r["url"]), r["capture"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], name, at, len(member)))
                    at += len(member)
                    if at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                if rows:
                    if out is not None:
                        out.flush()
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()], pa.string(), pa.int64(), pa.int64()], strict=True)], ["surt", "capture", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def index_writer(folder: str):
    """Writes the sorted index rows of a partition in compressed blocks and yields a directory row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        name, at, lines, found = f"{uuid.uuid4().hex}.index.gz", 0, [], []
        with files.open_output_stream(f"{path}/{name}", compression=None) as out:

            def flush() -> None:
                nonlocal at
                member = gzip_member("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in lines).encode())
                out.write(member)
                found.append((lines[0][0], lines[0][1], name, at, len(member), len(lines)))
                at += len(member)
                lines.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    lines.append(list(r.values()))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            # The directory, and where it stands.
            member = gzip_member("".join(json.dumps([f[0], f[1], f[3], f[4]], ensure_ascii=False) + "\n" for f in found).encode())
            out.write(member + struct.pack(TRAILER, at, len(member)))
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3], strict=True)], ["first_surt", "first_capture", "file", "offset", "length", "lines"])

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", folder: str | None = None, date: str = "2025-01-01T00:00:00Z") -> Capture:
    """Write a WARC record for each row and the two-level index over them.

    Payloads are the bodies in UTF-8, null ones empty. URLs may be null, empty or
    repeated; other columns are ignored. ``folder`` is a new folder that driver and
    executors share (default: one under spark.checkpoint.dir).
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files, path = store(folder)
    files.create_dir(path)
    index = settle(typed_captures(pages, id_col, url_col, body_col).mapInArrow(archive_writer(folder, date), INDEX_SCHEMA))
    ordered = index.repartitionByRange("surt", "capture", "offset").sortWithinPartitions("surt", "capture", "file", "offset")
    directory = settle(ordered.mapInArrow(index_writer(folder), DIRECTORY_SCHEMA))
    return Capture(folder, directory)


def json_lines(member: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(member, 31).decode().split("\n")[:-1]]


class IndexFile:
    """One index file, read by ranges."""

    def __init__(self, files: fs.FileSystem, path: str, name: str):
        self.name, self.file = name, files.open_input_file(f"{path}/{name}")
        at, length = struct.unpack(TRAILER, self.file.read_at(16, self.file.size() - 16))
        self.directory = json_lines(self.file.read_at(length, at))
        self.firsts = [d[0] for d in self.directory]
        self.number, self.block = -1, ([], [])

    def lines(self, key: str) -> Iterator[list]:
        """The lines of a URL key: a binary search of the directory, then of the blocks that may hold it. It may begin in the block before the first one that starts with it."""
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            if i != self.number:
                _, _, offset, length = self.directory[i]
                lines = json_lines(self.file.read_at(length, offset))
                self.number, self.block = i, (lines, [x[0] for x in lines])
            lines, keys = self.block
            yield from lines[bisect_left(keys, key) : bisect_right(keys, key)]

    def close(self) -> None:
        self.file.close()


class Archives:
    """Records by file, offset and length, with the file read last kept open."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.files, self.path, self.name, self.source = files, path, None, None

    def record(self, line: list) -> bytes:
        if line[7] != self.name:
            self.close()
            self.name, self.source = line[7], self.files.open_input_file(f"{self.path}/{line[7]}")
        return zlib.decompress(self.source.read_at(line[9], line[8]), 31)

    def batch(self, lines: list[list], bodies: bool) -> pa.RecordBatch:
        rows = [read_record(self.record(line), bodies) for line in sorted(lines, key=lambda x: (x[7], x[8]))]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["capture", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "body"])

    def close(self) -> None:
        if self.source is not None:
            self.source.close()


RECORD_SCHEMA = "capture long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, body string"


def checked(found: DataFrame) -> DataFrame:
    """``found``, whose every revisit must state digest and size of a response that was read under the number it refers to; raises otherwise."""
    there = found.where("record_type = 'response' and capture is not null").select(F.col("capture").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("_there")).distinct()
    again = found.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest", "payload_bytes"], "left")
    message = F.concat(F.lit("revisit "), F.col("capture").cast("string"), F.lit(" refers to no response with its payload"))
    again = again.withColumn("record_type", F.when(F.col("_there"), F.col("record_type")).otherwise(F.raise_error(message).cast("string")))
    return found.where("record_type = 'response'").unionByName(again.select(*found.columns))


def tops_of(capture: Capture) -> list[tuple[str, str]]:
    """(first key, name) of the index files, in order: a row for each task that wrote the index."""
    return sorted((r.first.first_surt, r.file) for r in capture.directory.groupBy("file").agg(F.min(F.struct("first_surt", "first_capture")).alias("first")).collect())


def files_with(firsts: list[str], key: str) -> range:
    """Which of sorted files may hold a key; it may begin in the file before the first one that starts with it."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def look_up(capture: Capture, urls: DataFrame, url_col: str = "url", bodies: bool = True) -> DataFrame:
    """Every capture of every URL in ``urls`` (repeated ones count once; null is the empty URL), by binary search on executors.

    Each URL key goes to the index files that may hold it; a task searches a file's
    directory and blocks for its keys in order and reads the records' ranges. A URL with
    very many captures lies in many files, each read by a task of its own. Digests and
    sizes of responses are those of the bytes that were read; revisits are to be
    ``checked``.
    """
    folder, tops = capture.folder, tops_of(capture)
    firsts = [t[0] for t in tops]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(tops[i][1], key) for key in {surt(u) for u in batch.column(0).to_pylist()} for i in files_with(firsts, key)]
            yield pa.record_batch([pa.array(c, pa.string()) for c in (zip(*found, strict=True) if found else ([], []))], ["file", "surt"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        archives, index = Archives(files, path), None
        waiting: list[list] = []
        for batch in batches:
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if index is None or index.name != name:
                    if index is not None:
                        index.close()
                    index = IndexFile(files, path, name)
                for line in index.lines(key):
                    waiting.append(line)
                    if len(waiting) >= READ:
                        yield archives.batch(waiting, bodies)
                        waiting = []
        if waiting:
            yield archives.batch(waiting, bodies)
        archives.close()

    wanted = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(keys, "file string, surt string").distinct()
    return wanted.repartition("file").sortWithinPartitions("file", "surt").mapInArrow(read, RECORD_SCHEMA)


def read_archives(spark: SparkSession, capture: Capture, bodies: bool = True) -> DataFrame:
    """Every capture of the archives, block by block: capture, url, record_type, refers_to, payload_digest, payload_bytes and the body (null for a revisit)."""
    folder = capture.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        archives = Archives(files, path)
        for batch in batches:
            for block in batch.to_pylist():
                with files.open_input_file(f"{path}/{block['file']}") as f:
                    lines = sorted(json_lines(f.read_at(block["length"], block["offset"])), key=lambda x: (x[7], x[8]))
                for at in range(0, len(lines), READ):
                    yield archives.batch(lines[at : at + READ], bodies)
        archives.close()

    return capture.directory.mapInArrow(run, RECORD_SCHEMA)


class Lookup:
    """Captures of one URL from the driver: the same searches as ``look_up``, without a job for each URL."""

    def __init__(self, capture: Capture):
        self.files, self.path = store(capture.folder)
        self.tops = tops_of(capture)
        self.firsts = [t[0] for t in self.tops]

    def find(self, url: str) -> list[dict]:
        """The records of the URL, in capture order: headers and block."""
        key, found = surt(url), []
        archives = Archives(self.files, self.path)
        for i in files_with(self.firsts, key):
            index = IndexFile(self.files, self.path, self.tops[i][1])
            found += [dict(zip(("fields", "body"), parse_record(archives.record(line)), strict=True)) for line in index.lines(key)]
            index.close()
        archives.close()
        return found
