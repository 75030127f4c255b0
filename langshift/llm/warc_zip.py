"""WARC records in ZIP packages: written by partition, read by range.

A package is a ZIP file: ``archive/`` holds WARC files, stored as they are (one gzip member for each
record), ``indexes/`` CDXJ indexes, plain or gzipped, whose sorted lines give each record's file (relative
to ``archive/``), offset and length; ``datapackage.json`` lists the members. The reader parses the end
record, the ZIP64 records and the central directory, locates the members, and reads single records by the
ranges of the index. Nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVES, INDEXES, LISTING = "archive/", "indexes/", "datapackage.json"
DATA = "data.warc.gz"

#: Bytes of packages that one task reads records from, about.
TASK_BYTES = 8 << 20

#: Fixed values of the ZIP format: signatures, and the sizes that stand for "see ZIP64".
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
GZIP = b"\x1f\x8b"

#: Bytes of payload from which equal payloads are stored once.
LEAST_REVISIT = 100

#: Fixed value of WARC: the profile of a record that repeats a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Member:
    name: str
    method: int
    crc: int
    compressed: int
    size: int
    header: int
    flags: int = 0x800


class ZipWriter:
    """Stored members, one after the other, with ZIP64 fields where sizes or offsets need them
    (everywhere with ``zip64``). The file is written in one pass, forwards only: a member whose size isn't
    known yet is followed by a data descriptor."""

    def __init__(self, file, zip64: bool = False):
        self.file, self.zip64, self.members, self.at = file, zip64, [], 0

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, size = zlib.crc32(data), len(data)
        self.members.append(Member(name, 0, crc, size, size, self.at))
        large = self.zip64 or size >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = MAX32 if large else size
        self.put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if large else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(name.encode()), len(extra)) + name.encode() + extra)
        self.put(data)

    def begin(self, name: str) -> None:
        """A member of unknown size: ``append`` its bytes, then ``end``."""
        self.members.append(Member(name, 0, 0, 0, 0, self.at))
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, MAX32, MAX32, len(name.encode()), len(extra)) + name.encode() + extra)

    def append(self, data: bytes) -> None:
        member = self.members[-1]
        member.crc, member.size, member.flags = zlib.crc32(data, member.crc), member.size + len(data), 0x808
        self.put(data)

    def end(self) -> None:
        member = self.members[-1]
        member.compressed, member.flags = member.size, 0x808
        self.put(struct.pack("<IIQQ", DESCRIPTOR, member.crc, member.size, member.size))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            large = self.zip64 or m.size >= MAX32 or m.header >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m.size, m.size, m.header) if large else b""
            size, header = (MAX32, MAX32) if large else (m.size, m.header)
            name = m.name.encode()
            self.put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if large else 20, m.flags, 0, 0, 0x21, m.crc, size, size, len(name), len(extra), 0, 0, 0, 0, header) + name + extra)
        length, n = self.at - start, len(self.members)
        large = self.zip64 or n >= MAX16 or start >= MAX32 or length >= MAX32
        if large:
            end64 = self.at
            self.put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
            self.put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            n, length, start = MAX16, MAX32, MAX32
        self.put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, start, 0))


def read_at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def directory(file, size: int) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory."""
    tail = read_at(file, max(0, size - 22 - MAX16), min(size, 22 + MAX16))
    at = tail.rfind(struct.pack("<I", END))
    if at < 0:
        raise ValueError("no end of central directory: this is no ZIP file")
    _, _, _, _, n, length, start, _ = struct.unpack("<IHHHHIIH", tail[at : at + 22])
    if MAX16 == n or MAX32 in (length, start):
        locator = struct.unpack("<IIQI", tail[at - 20 : at]) if at >= 20 else (0,)
        if locator[0] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        end64 = struct.unpack("<IQHHIIQQQQ", read_at(file, locator[2], 56))
        if end64[0] != END64:
            raise ValueError("the ZIP64 end record is missing")
        n, length, start = end64[7], end64[8], end64[9]
    data, found, at = read_at(file, start, length), {}, 0
    for _ in range(n):
        (sign, _, _, _, method, _, _, crc, compressed, size, n_name, n_extra, n_comment, _, _, _, header) = struct.unpack("<IHHHHHHIIIHHHHHII", data[at : at + 46])
        if sign != CENTRAL:
            raise ValueError("the central directory is broken")
        name = data[at + 46 : at + 46 + n_name].decode()
        extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: only the fields that don't fit, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                size = next(values) if size == MAX32 else size
                compressed = next(values) if compressed == MAX32 else compressed
                header = next(values) if header == MAX32 else header
            extra = extra[4 + width :]
        found[name] = Member(name, method, crc, compressed, size, header)
        at += 46 + n_name + n_extra + n_comment
    return found


def data_offset(file, member: Member, stored: bool = True) -> int:
    """Where a member's bytes begin."""
    if member.method and stored:
        raise ValueError(f"{member.name} is compressed: its records can't be read by range")
    head = struct.unpack("<IHHHHHIIIHH", read_at(file, member.header, 30))
    if head[0] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    return member.header + 30 + head[9] + head[10]


def member_bytes(file, member: Member) -> bytes:
    """A whole member, stored or deflated."""
    data = read_at(file, data_offset(file, member, stored=False), member.compressed)
    if member.method == 8:
        data = zlib.decompress(data, -15)
    elif member.method:
        raise ValueError(f"{member.name} is compressed by method {member.method}")
    return data


def index_lines(file, members: dict[str, Member]) -> list[dict]:
    """The entries of all CDXJ indexes of a package: filename (a member), offset and length among them."""
    found = []
    for name in sorted(members):
        if name.startswith(INDEXES) and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            data = member_bytes(file, members[name])
            lines = (gzip.decompress(data) if data[:2] == GZIP else data).decode().splitlines()
            found += [json.loads(line[line.index("{") :]) for line in lines if "{" in line and not line.startswith("!")]
    return [x | {"filename": ARCHIVES + x["filename"] if ARCHIVES + x["filename"] in members else x["filename"]} for x in found]


def warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, compressed by itself."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def record(kind: str, key: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """The record of a page. A revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{key}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return warc([*fields, ("Content-Type", "application/http; msgtype=response")], http + payload if kind == "response" else http)


def named(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields (names in lower case), HTTP fields (none where the block is no HTTP message) and body of
    a record, compressed or not."""
    plain = gzip.decompress(data) if data[:2] == GZIP else data
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("this is no WARC record")
    fields = named(lines)
    block = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, {}, block
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, named(http.decode("latin-1").split("\r\n")[1:]), body


def unchunked(body: bytes) -> bytes:
    """The body of a message in chunked transfer coding."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0] or b"0", 16)):
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def agrees(digest: str, body: bytes) -> bool | None:
    """Whether a digest (``algorithm:value``, in hex or Base32) is that of ``body``; None if it can't be told."""
    algorithm, _, value = digest.lower().partition(":")
    if algorithm.replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own = hashlib.new(algorithm.replace("-", ""), body, usedforsecurity=False)
    return value in (own.hexdigest(), base64.b32encode(own.digest()).decode().lower(), base64.b32encode(own.digest()).decode().rstrip("=").lower())


def file_system(path: str):
    """A file system that tasks can use, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: A URL is kept on one line of a header.
def one_line(url: str | None) -> str:
    return " ".join((url or "").split())


def write_packages(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False, records_per_package: int = 20_000) -> DataFrame:
    """Write ZIP packages below ``folder``, which all executors share; returns their manifest (package,
    records, bytes), itself written there.

    Payload: the html in UTF-8, null as empty. Of equal payloads of at least ``LEAST_REVISIT`` bytes the
    one with the smallest id is a response, rows with a larger id (or a null one, if there is another)
    are revisits of it. Rows that repeat the smallest id are responses too. Smaller payloads are all
    responses. Packages have names of their own for each attempt of a task, and count only once they
    are in the manifest, so what lost or repeated tasks leave behind is not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # Payloads that are never shared keep out of each other's way under a key of their own.
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    groups = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("same", "id").groupBy("same").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first_id is not null")
    groups = common.cut_lineage(groups)
    total = pages.count()
    marked = common.attach_group(rows, groups, "same", "copies", total).drop("same", "copies")
    marked = marked.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")))

    def run(batches):
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        package = None
        for batch in batches:
            for key, url, payload, digest, first in zip(*(batch.column(c) for c in range(5)), strict=True):
                if package is None:
                    package = Package(files, base, zip64)
                package.add(key.as_py(), one_line(url.as_py()), payload.as_py(), digest.as_py(), first.as_py())
                if len(package.index) >= records_per_package:
                    yield package.close()
                    package = None
        if package is not None:
            yield package.close()

    manifest = marked.select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "package string, records long, bytes long")
    return common.cut_lineage(manifest)


class Package:
    """A package in the making. Records go to the file as they come; what is held is the index."""

    def __init__(self, files, base: str, zip64: bool):
        self.name, self.index = f"{uuid.uuid4().hex}.wacz", []
        self.out = files.open_output_stream(f"{base}/{self.name}")
        self.zip = ZipWriter(self.out, zip64)
        self.zip.begin(ARCHIVES + DATA)
        self.start = self.zip.at
        info = warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        self.zip.append(info)

    def add(self, key, url: str, payload: bytes, digest: str, first) -> None:
        data = record("response" if first is None else "revisit", json.dumps(key), url, payload, digest, len(payload), None if first is None else json.dumps(first))
        line = {"url": url, "digest": f"sha256:{digest}", "filename": DATA, "offset": self.zip.at - self.start, "length": len(data)}
        self.index.append(f"{url or '-'} 19700101000000 {json.dumps(line)}\n".encode())
        self.zip.append(data)

    def close(self) -> pa.RecordBatch:
        self.zip.end()
        self.zip.add(INDEXES + "index.cdx.gz", gzip.compress(b"".join(sorted(self.index)), 6, mtime=0))
        listing = [{"name": m.name.rpartition("/")[2], "path": m.name, "bytes": m.size} for m in self.zip.members]
        self.zip.add(LISTING, json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": listing}).encode())
        self.zip.close()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([len(self.index)], pa.int64()), pa.array([self.zip.at], pa.int64())], ["package", "records", "bytes"])


RECORDS = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_packages(manifest: DataFrame, folder: str, *, records_per_row: int = 1000) -> DataFrame:
    """The indexed records of the packages of ``manifest`` (package, bytes), which lie below ``folder``:
    record_id and refers_to as they are written, url, record_type, payload_bytes, payload_digest and payload.

    Records of any type are read. The payload is the HTTP body (without chunked coding), or the block of a
    record that is no HTTP message; of revisits it is null, and payload_bytes what their HTTP header
    says, or null. payload_digest is the bare value of a SHA-256, other digests keep their algorithm's name,
    null if none is recorded. A payload whose digest is not the recorded one raises.

    First each package's directory and indexes are read, then its records, by one range read each.
    The number of tasks follows from the bytes of the packages.
    """
    packages, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()

    def locate(batches):
        files, base = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_file(f"{base}/{name}") as file:
                    members = directory(file, file.size())
                    found = index_lines(file, members)
                    start = {f: data_offset(file, members[f]) for f in {x["filename"] for x in found}}
                ranges = sorted((start[x["filename"]] + int(x["offset"]), int(x["length"])) for x in found)
                for k in range(0, len(ranges), records_per_row):
                    part = ranges[k : k + records_per_row]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[r[0] for r in part]], pa.list_(pa.int64())), pa.array([[r[1] for r in part]], pa.list_(pa.int64()))], ["package", "offsets", "lengths"])

    def one(name: str, offset: int, data: bytes) -> tuple:
        fields, http, body = parse_record(data)
        digest = fields.get("warc-payload-digest")
        if "chunked" in http.get("transfer-encoding", "").lower() and (digest is None or not agrees(digest, body)):
            body = unchunked(body)
        kind = fields["warc-type"]
        if kind == "revisit":
            size, body = int(http["content-length"]) if http.get("content-length", "").isdigit() else None, None
        else:
            size = len(body)
            if digest and agrees(digest, body) is False:
                raise ValueError(f"{name}: the payload at {offset} is not what was written")
        bare = digest.partition(":")[2].lower() if digest and digest.lower().startswith("sha256:") else digest
        return fields.get("warc-record-id"), fields.get("warc-target-uri"), kind, size, bare, fields.get("warc-refers-to"), body

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["record_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def table(rows):
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def fetch(batches):
        files, base = file_system(folder)
        for batch in batches:
            for name, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows, held = [], 0
                with files.open_input_file(f"{base}/{name}") as file:
                    for offset, length in zip(offsets, lengths, strict=True):
                        rows.append(one(name, offset, read_at(file, offset, length)))
                        held += len(rows[-1][-1] or b"")
                        if held > common.BATCH_BYTES:
                            yield table(rows)
                            rows, held = [], 0
                yield table(rows)

    ranges = manifest.select("package").repartition(max(1, min(packages, 10_000)), "package").mapInArrow(locate, "package string, offsets array<long>, lengths array<long>")
    ranges = common.cut_lineage(ranges)
    # A number that is asked for isn't changed by adaptive execution, which would see the small offsets only.
    return ranges.repartition(max(1, -(-int(total) // TASK_BYTES)), F.xxhash64("package", F.element_at("offsets", 1))).mapInArrow(fetch, RECORDS)


def page_key(record_id: str, id_type: str) -> Column:
    """The page's id in a record's own: JSON between ``<urn:page:`` and ``>``."""
    inner = F.regexp_extract(record_id, r"(?s)^<urn:page:(.*)>$", 1)
    return F.from_json(F.concat(F.lit('{"id":'), inner, F.lit("}")), f"id {id_type}")["id"]


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages' records to packages in the shared folder and read them back (see both above):
    page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for revisits).

    Null html and null urls count as empty; null and repeated ids are carried along. A page of any
    length is one record. No rows: none out. Other columns are not read.
    """
    folder = common.shared_dir(pages.sparkSession)
    manifest = write_packages(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = read_packages(manifest, folder)
    return rows.select(page_key("record_id", id_type).alias("page_id"), "url", "record_type", "payload_bytes", "payload_digest", page_key("refers_to", id_type).alias("refers_to"), "payload")
