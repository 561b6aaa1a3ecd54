"""WARC records in ZIP packages, read by range without extraction.

Writing packs gzip members, one a record, into ``archive/data.warc.gz`` and their places
into ``indexes/index.cdxj``, both *stored* members of a ZIP file in the shared folder (the
layout of web archive collections).  Reading is by path: a first step parses each file's end
record, its ZIP64 form and the central directory, finds where stored members begin and reads
the index; its entries are dealt out over all tasks as groups of (offset, length), and a
second step fetches every record by one seek and read.  No step holds a package, so that
files may have any size.  Paths are opened by ``pyarrow.fs``: local and shared folders,
HDFS and the object stores that it knows.

Nulls: a null payload is an empty one; a null or unprintable address is written empty or
percent-encoded; a null id is kept.  Repeated rows are all written; rows that share the
largest id of a group of equal payloads are all responses.  An empty table gives no
archive and no row.  Extra columns are left behind, whatever their names.  A very long
payload is one record, and makes a package of its own if need be.  A task that runs twice
leaves files that no row names, and that are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
MIN_REVISIT = 1000
GROUP = 64
DATE = "2024-01-01T00:00:00Z"

ReadAt = Callable[[int, int], bytes]


# --- ZIP ---------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def write_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; ``zip64`` forces the 64-bit records that large ones need."""
    out, central = bytearray(), bytearray()
    for name, body in members:
        raw, crc, at, n = name.encode(), zlib.crc32(body), len(out), len(body)
        wide = zip64 or max(n, at) >= 0xFFFFFFFF
        sizes, where = (0xFFFFFFFF, 0xFFFFFFFF) if wide else (n, at)
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 0x21, crc, sizes, sizes, len(raw), len(extra)) + raw + extra + body
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 0x21, crc, sizes, sizes, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra
    start, count = len(out), len(members)
    out += central
    if zip64 or start >= 0xFFFFFFFF or count >= 0xFFFF:
        at = len(out)
        out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(central), start)
        out += struct.pack("<4sIQI", b"PK\6\7", 0, at, 1)
        count, start, length = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    else:
        length = len(central)
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, count, count, length, start, 0)
    return bytes(out)


def zip_directory(read_at: ReadAt, size: int) -> dict[str, Member]:
    """Members by name, from the central directory alone: two or three range reads."""
    tail_at = max(0, size - 22 - 65535)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = read_at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read_at(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method, crc = struct.unpack_from("<HH4xI", directory, at + 8)
        packed, full, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        (header,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + width :]
        found[name] = Member(name, method, crc, packed, full, header)
        at += 46 + n + m + k
    return found


def member_start(read_at: ReadAt, member: Member) -> int:
    """Where a stored member's bytes begin, from its local header."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by range")
    head = read_at(member.header, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + m


# --- WARC --------------------------------------------------------------------------


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit keeps the answer's head, with the full payload's length, and no payload."""
    target = quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        *([] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to))]),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


class Record(NamedTuple):
    fields: dict[str, str]
    http: dict[str, str]
    payload: bytes


def parse_record(raw: bytes) -> Record:
    head, cut, rest = raw.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    if not cut or not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    n = int(fields["content-length"])
    block = rest[:n]
    if len(block) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    if not fields.get("content-type", "").startswith("application/http"):
        return Record(fields, {}, block)
    http_head, _, payload = block.partition(b"\r\n\r\n")
    return Record(fields, _fields(http_head)[1], payload)


def _page(uri: str | None) -> int | None:
    digits = (uri or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def index_entries(read_at: ReadAt, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of each record that the package's index names."""
    directory = zip_directory(read_at, size)
    index_at, data_at = (member_start(read_at, directory[x]) for x in (INDEX, DATA))
    index = read_at(index_at, directory[INDEX].size)
    if zlib.crc32(index) != directory[INDEX].crc:
        raise ValueError("bad checksum of the index")
    for line in index.splitlines():
        entry = json.loads(line.split(b" ", 2)[2])
        yield data_at + entry["offset"], entry["length"]


def read_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, SHA-1, record type, referred page) of a record's gzip member."""
    record = parse_record(gzip.decompress(raw))
    kind = record.fields["warc-type"]
    digest = base64.b32decode(record.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    n = int(record.http["content-length"])
    if kind == "response" and (hashlib.sha1(record.payload).hexdigest() != digest or len(record.payload) != n):
        raise ValueError("payload differs from its digest")
    return _page(record.fields["warc-record-id"]), n, digest, kind, _page(record.fields.get("warc-refers-to"))


def build_archive(records: list[tuple[str, bytes]]) -> bytes:
    """A ZIP package of (address, gzip member) pairs, in their order."""
    data, lines, at = [], [], 0
    for url, member in records:
        lines.append(f"{quote(url, safe=':/?=&.-_~') or '-'} {DATE[:19].translate({ord(c): None for c in '-:T'})} " + json.dumps({"offset": at, "length": len(member)}))
        data.append(member)
        at += len(member)
    index = "".join(f"{x}\n" for x in lines).encode()
    about = json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": at}, {"path": INDEX, "bytes": len(index)}]}).encode()
    return write_zip([(DATA, b"".join(data)), (INDEX, index), ("datapackage.json", about)])


# --- Spark -------------------------------------------------------------------------


def _write(batches: Iterator[pa.RecordBatch], root: str, archive_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    store, folder = fs.FileSystem.from_uri(root)
    held: list[tuple[str, bytes]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        blob, name = build_archive(held), f"{uuid.uuid4().hex}.zip"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(blob)
        return pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(blob)], pa.int64()), pa.array([len(held)], pa.int64())], ["path", "bytes", "records"])

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode()
            address = url.as_py()
            raw = warc_record(page_id.as_py(), address, payload, digest.as_py(), refers_to.as_py())
            member = gzip.compress(raw, level, mtime=0)
            held.append((address or "", member))
            size += len(member)
            if size >= archive_bytes:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                entries = list(index_entries(lambda at, n, file=file: file.read_at(n, at), file.size()))
            groups = [entries[i : i + GROUP] for i in range(0, len(entries), GROUP)]
            lists = [pa.array([[e[k] for e in g] for g in groups], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(groups), pa.string()), *lists], ["path", "offsets", "lengths"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                rows = [read_record(file.read_at(n, at)) for at, n in zip(offsets, lengths, strict=True)]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(payload_digest, response_id) of payloads of at least ``min_bytes`` that occur more
    than once.  Only digests move; counts combine before the shuffle, so that a payload
    that a third of all pages share costs one row a task."""
    digests = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("payload_digest")).where(F.octet_length(F.coalesce(pages["html"], F.lit(""))) >= min_bytes)
    return digests.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1 and response_id is not null").drop("n")


def write_archives(pages: DataFrame, repeats: DataFrame, root: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 4, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(path, bytes, records): ZIP files of about ``archive_bytes`` under ``root``, each written
    by the task that reads its pages.

    ``repeats`` is the written table of ``revisits``.  Spark broadcasts it if its files are
    under its threshold; otherwise both sides shuffle on the digest and a hot digest's
    partition is split by the adaptive skew join.
    """
    full = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("payload_digest"))
    marked = full.join(repeats, "payload_digest", "left")
    other = (F.col("response_id") != F.coalesce("page_id", F.col("response_id") - 1)) & (F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes)
    rows = marked.select("page_id", "url", "html", "payload_digest", F.when(other, F.col("response_id")).alias("refers_to"))
    return rows.mapInArrow(lambda it: _write(it, root, archive_bytes, level), "path string, bytes long, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the packages in a ``path`` column.  Groups of index entries are dealt out
    anew, so that a large package is read by many tasks."""
    entries = archives.select("path").mapInArrow(_entries, "path string, offsets array<long>, lengths array<long>")
    dealt = entries.repartition("path", F.col("offsets")[0])
    return dealt.mapInArrow(_fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into ZIP packages and read back from them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    scratch = Scratch(spark, "warc")
    repeats = scratch.keep(revisits(pages))
    return read_archives(scratch.keep(write_archives(pages, repeats, f"{scratch.root}/packages")))


QUERIES = {"op4_warc_zip": op4_warc_zip}
ORACLE_SQL = {
    "op4_warc_zip": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages
), g as (
  select d, max(page_id) as keep from p where n >= 1000 group by d having count(*) > 1
)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
  case when g.keep is not null and g.keep is distinct from p.page_id then 'revisit' else 'response' end as record_type,
  case when g.keep is distinct from p.page_id then g.keep end as refers_to
from p left join g on p.d = g.d
"""
}
