import base64
import gzip
import hashlib
import json
import os
import zipfile

import duckdb
import pyarrow.fs as pafs
import pytest

from semdex.llm import warc

LONG = "<p>" + "é" * 60 + "</p>"
ROWS = [(3, "http://a/1", LONG), (1, "http://a/2", LONG), (2, None, LONG), (None, "http://a/ b\r\nX: y", LONG), (1, "http://a/2", LONG),
        (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\n" * 50), (9, "u", "x" * 3_000_000), (10, "u", "x" * 99),
        (11, "u", "x" * 99), (12, "u", "WARC/1.1\r\n\r\nPK\x05\x06" * 9)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "f") for r in rows], "page_id long, url string, html string, digest string, first string")


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if j is not None and (h or "").encode() == data]
        first = min(ids) if ids and len(data) >= 100 else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("package_records, span", [(100, 4 << 20), (2, 1)])
def test_round_trip(spark, tmp_path, package_records, span):
    listed = warc.write_packages(pages(spark, ROWS).repartition(3), f"file://{tmp_path}", package_records=package_records)
    got = warc.read_packages(listed, span_bytes=span).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    html = {i: h for i, _, h in ROWS}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in got if r.record_type == "response")
    for r in listed.collect():
        with zipfile.ZipFile(r.package[len("file://"):]) as z:     # another reader agrees
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            assert len(z.read(warc.INDEX).splitlines()) == r.records and r.records <= package_records


def test_several_archives_and_cdxj_lines(spark, tmp_path):
    """A package of another writer: two archives, two indexes (one gzip-compressed), SHA-1 digests, no page ids."""
    def record(kind, uri, payload, extra=()):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response",
                f"Content-Length: {len(block)}", *extra]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    sha = base64.b32encode(hashlib.sha1(b"one").digest()).decode()
    records = {"a.warc.gz": [record("response", "http://x/%20a", b"one", [f"WARC-Payload-Digest: sha1:{sha}"]), record("response", "http://x/b", b"two")],
               "b.warc.gz": [record("revisit", "http://x/c", b"", [f"WARC-Payload-Digest: sha1:{sha}"])]}
    path, lines = tmp_path / "foreign.zip", {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/", "")
        for name, rs in records.items():
            z.writestr(f"archive/{name}", b"".join(rs))
            at = 0
            for i, r in enumerate(rs):
                entry = json.dumps({"url": "http://x", "filename": name, "offset": str(at), "length": str(len(r))})
                lines.setdefault(name, []).append(f"com,x)/{i} 20240101000000 {entry}")
                at += len(r)
        z.writestr("indexes/index.cdxj", "!CDXJ 1.0 {\"about\": 1}\n" + "\n".join(lines["a.warc.gz"]) + "\n")
        z.writestr("indexes/more.cdx.gz", gzip.compress("\n".join(lines["b.warc.gz"]).encode()))
        z.writestr("indexes/more.idx", "com,x)/ 20240101 {\"offset\": 0}")
    got = warc.read_packages(spark.createDataFrame([(f"file://{path}",)], "package string")).collect()
    assert sorted((r.url, r.record_type, r.payload_bytes, r.payload and bytes(r.payload)) for r in got) == [
        ("http://x/%20a", "response", 3, b"one"), ("http://x/b", "response", 3, b"two"), ("http://x/c", "revisit", None, None)]
    assert {r.payload_digest for r in got} == {hashlib.sha256(b"one").hexdigest(), hashlib.sha256(b"two").hexdigest(), None}


def test_an_index_without_its_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("archive/a", b"")
        z.writestr("indexes/i.cdxj", json.dumps({"filename": "b", "offset": 0, "length": 1}))
    with pytest.raises(Exception, match="no archive"):
        warc.read_packages(spark.createDataFrame([(f"file://{tmp_path}/x.zip",)], "package string")).collect()


def test_string_identifiers_and_urls_come_back(spark, tmp_path):
    rows = [("a b", "http://x/a b%20c", "<p>1"), ("100%", "u%41\tx", "<p>2"), ("é/\n", None, "<p>3")]
    docs = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = warc.read_packages(warc.write_packages(docs, str(tmp_path)), id_type="string").collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == sorted(rows)


def test_tasks_follow_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    listed = warc.write_packages(pages(spark, [(i, "u", os.urandom(1000).hex()) for i in range(400)]).repartition(2), str(tmp_path), package_records=50)
    found = warc.read_packages(listed, span_bytes=4_000)
    size = listed.agg({"bytes": "sum"}).first()[0]
    assert size > 400_000 and found.rdd.getNumPartitions() == -(-size // 20_000)
    assert found.count() == 400


def test_empty_table(spark, tmp_path):
    listed = warc.write_packages(pages(spark, []), str(tmp_path))
    assert listed.count() == 0 and warc.read_packages(listed).count() == 0


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("comment", [b"", b"a PK\x05\x06 comment" + b"z" * 40])
def test_directory(tmp_path, monkeypatch, wide, comment):
    if wide:        # every size and offset over 10 bytes goes to ZIP64 fields
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in (("a/ü.txt", b"first" * 30), ("b", b"second" * 9), ("c", b"")):
            z.writestr(name, data)
        z.writestr("packed", b"zzzz" * 99, compress_type=zipfile.ZIP_DEFLATED)
    raw = path.read_bytes()
    assert (b"PK\x06\x06" in raw) == wide
    with pafs.LocalFileSystem().open_input_file(str(path)) as f:
        members = {m.name: m for m in warc.read_directory(f)}
        assert set(members) == {"a/ü.txt", "b", "c", "packed"}
        at = warc.member_start(f, members["b"])
        assert raw[at:at + members["b"].size] == b"second" * 9
        with pytest.raises(ValueError, match="compressed"):
            warc.member_start(f, members["packed"])


def test_not_a_package(tmp_path):
    (tmp_path / "x").write_bytes(b"PK" * 100)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f, pytest.raises(ValueError):
        warc.read_directory(f)


def test_damage_is_found(spark, tmp_path):
    record = warc.encode_record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), 7, None)
    package = warc._Package(f"file://{tmp_path}", "x.zip")
    package.add(record, "response")
    uri, n, size = package.close()
    with pytest.raises(Exception, match="digest"):
        warc.read_packages(spark.createDataFrame([(uri, n, size)], "package string, records long, bytes long")).collect()


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute("SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM (" + warc.OP4_SQL + ")").fetchall()
    assert sorted(map(tuple, warc.op4_warc(spark, sf).collect()), key=str) == sorted(want, key=str)
