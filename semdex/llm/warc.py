"""Operator 4: WARC records in ZIP-packaged archives.

Writing: each task streams its pages as WARC records, one gzip member a record,
into packages: ZIP files with a stored member `archive/data.warc.gz` and a stored
index `indexes/index.cdxj` (one JSON line a record: offset, length, type). Of
equal payloads the page with the smallest identifier is written as response, the
others as revisit records that refer to it.

Reading: a package's end record, ZIP64 end record and central directory are
parsed to find the stored members; the index is range-read, and records are read
by byte ranges of some megabytes, each range a row, so that Spark spreads them.
Nothing is extracted. Files are reached through pyarrow's file systems by URI,
so packages may lie wherever the cluster's tasks can read and seek.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zipfile
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha1, sha256
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import materialize, partitions, table
from semdex.session import tables_folder

ARCHIVES, INDEXES = "archive/", "indexes/"
DATA, INDEX = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdxj"
TASK_BYTES, TASK_PACKAGES = 64 << 20, 4     # of archives that a task reads; packages whose indexes a task reads
REVISIT_BYTES = 100
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 100_000
SPAN_BYTES = 4 << 20
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


# ---- ZIP directories ----

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def read_directory(f: pa.NativeFile) -> list[Member]:
    """Entries of the central directory, by range reads at the end of the file."""
    size = f.size()
    tail_at = max(0, size - 22 - 65535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)     # the bytes stood in the comment
    if end < 0:
        raise ValueError("not a ZIP file: no end of central directory")
    entries, length, at = struct.unpack_from("<HII", tail, end + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = tail[end - 20:end] if end >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("ZIP64 locator is missing")
        f.seek(struct.unpack_from("<Q", locator, 8)[0])
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end record is missing")
        entries, length, at = struct.unpack_from("<QQQ", record, 32)
    f.seek(at)
    directory, members, p = f.read(length), [], 0
    for _ in range(entries):
        if directory[p:p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, p + 20)
        header_at = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46:p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name:p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, q)
            if kind == 1:       # the 64-bit values of those fields that are all ones, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            q += 4 + n
        members.append(Member(name, method, packed, header_at))
        p += 46 + n_name + n_extra + n_comment
    return members


def member_start(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be range-read")
    f.seek(member.header_at)
    header = f.read(30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header for {member.name}")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))


# ---- records ----

def _uri(value: str) -> str:
    """Characters that can't stand in a header line, percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _escaped(value: str) -> str:
    """As `_uri`, and reversible by `unquote`."""
    return _uri(value.replace("%", "%25"))


def encode_record(page_id, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit (refers_to) has no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {_escaped(str(page_id))}")
    if url is not None:
        head += [f"WARC-Target-URI: {_uri(url)}", f"X-Page-Url: {_escaped(url)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {_escaped(str(refers_to))}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, 6, mtime=0)


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers by lower-case name, and the payload behind the HTTP headers."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def _digest(fields: dict[str, str], payload: bytes, revisit: bool) -> str | None:
    """The payload's SHA-256; a revisit's as its record says, null if it says another kind. A
    response whose payload doesn't have the digest that its record names raises an error."""
    kind, _, named = fields.get("warc-payload-digest", "").partition(":")
    if revisit:
        return named.lower() if kind == "sha256" else None
    found = sha256(payload).hexdigest()
    if kind == "sha256" and named.lower() != found or kind == "sha1" and named.upper() not in (
            b32encode(sha1(payload).digest()).decode(), sha1(payload).hexdigest().upper()):
        raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't have its digest")
    return found


class _Package:
    """A ZIP package that grows record by record."""

    def __init__(self, root: str, name: str):
        self.uri = f"{root}/{name}"
        fs, path = filesystem(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines, self.size = [], 0

    def add(self, record: bytes, kind: str) -> None:
        self.lines.append(json.dumps({"offset": self.size, "length": len(record), "type": kind, "filename": DATA[len(ARCHIVES):]}))
        self.data.write(record)
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.lines))
        self.zip.close()
        self.sink.close()
        return self.uri, len(self.lines), self.size


def with_references(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null: a response)."""
    base = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    repeated = materialize(base.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest")
                           .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # with few repeated payloads the pages stay where they are; else a shuffled join, whose skew AQE splits
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_GROUPS else repeated
    return (base.join(side, "digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first"))


def write_packages(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   package_bytes: int = PACKAGE_BYTES, package_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write every page to packages under `root`; returns their list: package, records, bytes.

    Null html is an empty payload; null url or identifier leaves out its header.
    Payloads under 100 bytes are always responses. Pages that repeat the smallest
    identifier of their payload are responses too. A page without identifier
    revisits, unless no page of its payload has one. An empty table writes none.
    File names hold the attempt, and the list, a written table, names only those
    of attempts that Spark accepted, so lost executors and repeated tasks do no harm.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, package, n = TaskContext.get(), None, 0
        done = lambda p: pa.RecordBatch.from_pylist([dict(zip(("package", "records", "bytes"), p.close()))])
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to"))):
                if package is None:
                    package = _Package(root, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.zip")
                    n += 1
                page_id, url, payload, digest, n_bytes, refers_to = r
                kind = "response" if refers_to is None else "revisit"
                package.add(encode_record(page_id, url, payload.encode("utf-8", "surrogatepass"), digest, n_bytes, refers_to), kind)
                if package.size >= package_bytes or len(package.lines) >= package_records:
                    yield done(package)
                    package = None
        if package is not None:
            yield done(package)

    return materialize(with_references(pages, id_col, url_col, html_col)
                       .mapInArrow(write, "package string, records long, bytes long"))


def index_entries(index: bytes) -> Iterator[dict]:
    """Entries of a CDXJ index, gzip-compressed or not: a line's JSON, which a key and a timestamp
    may precede. Lines without JSON (headers) are left out."""
    if index[:2] == b"\x1f\x8b":
        index = gzip.decompress(index)
    for line in index.decode("utf-8").split("\n"):
        at = line.find("{")
        if at >= 0 and not line.startswith("!"):
            yield json.loads(line[at:])


def record_spans(packages: DataFrame, span_bytes: int = SPAN_BYTES, tasks: int | None = None) -> DataFrame:
    """Per range of neighbouring records: package, start (in the file), offsets, lengths (from start).

    Every stored member under `archive/` and every index under `indexes/` is read; an entry's
    `filename` names its archive, which may be left out where there is only one. `tasks` read
    the indexes (default: as many as the session's shuffles).
    """
    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["package"]:
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    members = [m for m in read_directory(f) if not m.name.endswith("/")]
                    archives = {m.name[len(ARCHIVES):]: member_start(f, m) for m in members if m.name.startswith(ARCHIVES)}
                    found: dict[int, list[tuple[int, int]]] = {}
                    for m in members:
                        if not m.name.startswith(INDEXES) or m.name.endswith(".idx"):   # .idx: an index of index lines
                            continue
                        f.seek(member_start(f, m))
                        for entry in index_entries(f.read(m.size)):
                            name = entry.get("filename", next(iter(archives)) if len(archives) == 1 else None)
                            name = name if name in archives else str(name).removeprefix(ARCHIVES)
                            if name not in archives:
                                raise ValueError(f"{uri} has no archive {name!r}")
                            found.setdefault(archives[name], []).append((int(entry["offset"]), int(entry["length"])))
                out = []
                for at, entries in found.items():
                    held: list[tuple[int, int]] = []
                    for offset, length in sorted(entries):
                        if held and offset + length - held[0][0] > span_bytes:
                            out.append((at, held))
                            held = []
                        held.append((offset, length))
                    out.append((at, held))
                yield pd.DataFrame({"package": uri, "start": [at + s[0][0] for at, s in out],
                                    "offsets": [[o - s[0][0] for o, _ in s] for _, s in out],
                                    "lengths": [[n for _, n in s] for _, s in out]})

    return packages.select("package").repartition(tasks or partitions(packages.sparkSession), "package").mapInPandas(
        spans, "package string, start long, offsets array<long>, lengths array<long>")


def read_packages(packages: DataFrame, id_type: str = "long", payloads: bool = True, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest
    and, with `payloads`, payload (null for a revisit). A response whose payload
    doesn't have its digest raises an error. Records of other writers have no page_id;
    their url is the target URI, and a revisit's length and digest are null if unknown.

    Tasks get about `TASK_BYTES` of archives each; packages are listed in a written
    table, and the list of spans is one, so that both counts are taken from files.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = lambda fields, name: None if name not in fields else unquote(fields[name], errors="surrogatepass")
        for batch in batches:
            for uri, start, offsets, lengths in zip(batch["package"], batch["start"], batch["offsets"], batch["lengths"]):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as f:
                    f.seek(int(start))
                    span = f.read(int(offsets[-1] + lengths[-1]))
                rows = []
                for o, n in zip(offsets, lengths):
                    fields, payload = decode_record(span[int(o):int(o + n)])
                    revisit = fields["warc-type"] == "revisit"
                    size = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
                    rows.append((text(fields, "x-page-id"), text(fields, "x-page-url") or fields.get("warc-target-uri"), fields["warc-type"],
                                 text(fields, "x-refers-to-page-id"), size if revisit else len(payload),
                                 _digest(fields, payload, revisit), *([None if revisit else payload] if payloads else [])))
                yield pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes",
                                                  "payload_digest", *(["payload"] if payloads else [])]).astype({"payload_bytes": "Int64"})

    kinds = ("page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string"
             + ", payload binary" * payloads)
    shuffles = partitions(packages.sparkSession)
    listed = packages.count()
    spans = materialize(record_spans(packages, span_bytes, max(1, min(listed, max(shuffles, listed // TASK_PACKAGES)))))
    size = spans.agg(F.sum(F.element_at("offsets", -1) + F.element_at("lengths", -1))).first()[0] or 0
    found = spans.repartition(max(shuffles, -(-size // TASK_BYTES)), "package", "start").mapInPandas(read, kinds)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root = f"{tables_folder(spark)}/warc-{uuid.uuid4().hex}"     # deleted with the other intermediate files
    return read_packages(write_packages(pages, root), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
             CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""
