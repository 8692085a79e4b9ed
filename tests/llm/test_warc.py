"""ARC to WARC: awkward archives by hand, and the round trip against plain Python."""

import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from heliospark.llm import warc
from tests.llm.fixtures import clashing, read

PAGES = "page_id long, url string, html string"


def http(body: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body


def arc_file(version: int, records: list[tuple[str, bytes]], ip: str = "10.0.0.1") -> bytes:
    """An archive by the format's description, written apart from the operator."""
    more = " 200 - - 0 a.arc" if version == 2 else ""
    names = "URL IP-address Archive-date Content-type" + (" Result-code Checksum Location Offset Filename" if version == 2 else "") + " Archive-length"
    block = f"{version} 0 someone\n{names}\n".encode()
    out = f"filedesc://a.arc 0.0.0.0 20010203040506 text/plain{more} {len(block)}\n".encode() + block + b"\n"
    for url, content in records:
        out += f"{url} {ip} 20010203040506 text/html{more} {len(content)}\n".encode() + content + b"\n"
    return out


def stored(tmp_path, name: str, data: bytes):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def brute_warc(folder: str) -> list[tuple[dict, bytes]]:
    """Records of all files, cut by Content-Length."""
    import pathlib

    out = []
    for path in sorted(pathlib.Path(folder).glob("part-*")):
        data, at = gzip.decompress(path.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(x.split(": ", 1) for x in lines[1:])
            size = int(fields["Content-Length"])
            out.append((fields, data[end + 4 : end + 4 + size]))
            at = end + 4 + size
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_declared_lengths_rule(spark, tmp_path, version):
    trap = http(b"x" * 50 + arc_file(version, [("http://inner/", http(b"no record"))]) + b"\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n")
    records = [("http://a/", trap), ("http://b/with space", http(b"")), ("dns:a", b"20010203 a 1.2.3.4"), ("http://c/", http("é日本".encode()))]
    packed = arc_file(version, records).replace(b"\nhttp://b/", b"\n\n\nhttp://b/")  # further blank lines
    folder = stored(tmp_path, "a.arc.gz", b"".join(gzip.compress(packed[i : i + 100]) for i in range(0, len(packed), 100)))
    found = warc.read_arc(spark, folder, payload=True).orderBy("offset").collect()
    assert [r.kind for r in found] == ["warcinfo", "response", "response", "resource", "response"]
    assert {r.version for r in found[1:]} == {version} and not any(r.fault for r in found)
    assert [bytes(r.payload) for r in found[1:]] == [trap.split(b"\r\n\r\n", 1)[1], b"", records[2][1], "é日本".encode()]
    assert [r.uri for r in found[1:]] == ["http://a/", "http://b/with%20space", "dns:a", "http://c/"]
    made = brute_warc(warc.convert(spark, folder).removeprefix("file:"))
    assert [b for _, b in made[1:]] == [c for _, c in records]
    for fields, block in made:
        assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and fields["WARC-Date"] == "2001-02-03T04:05:06Z"
        assert fields.get("WARC-IP-Address") == (None if fields["WARC-Type"] == "warcinfo" else "10.0.0.1")
        if fields["WARC-Type"] != "warcinfo":
            assert fields["WARC-Warcinfo-ID"] == made[0][0]["WARC-Record-ID"]
            body = block.split(b"\r\n\r\n", 1)[1] if block.startswith(b"HTTP") else block
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
    assert len({f["WARC-Record-ID"] for f, _ in made}) == len(made)


def test_faults_are_reported_and_the_rest_is_read(spark, tmp_path):
    whole = arc_file(1, [("http://a/", http(b"a" * 200)), ("http://b/", http(b"b" * 200))])
    broken = whole.replace(b"\nhttp://b/", b"\nnonsense here\nand more\nhttp://b/")
    folder = stored(tmp_path, "a.arc", broken[:-50])
    found = warc.read_arc(spark, folder).orderBy("offset").collect()
    assert [(r.kind, r.fault) for r in found] == [("warcinfo", None), ("response", None), (None, "header"), ("response", "truncated")]
    made = brute_warc(warc.convert(spark, folder).removeprefix("file:"))
    assert [f["WARC-Type"] for f, _ in made] == ["warcinfo", "response", "response"]
    assert made[2][0]["WARC-Truncated"] == "length" and "WARC-Truncated" not in made[1][0]


def test_short_dates():
    assert warc.iso_time("1996") == "1996-01-01T00:00:00Z" and warc.iso_time("199612312359") == "1996-12-31T23:59:00Z"


def test_damaged_warc_is_not_intact(spark, tmp_path):
    folder = stored(tmp_path, "a.arc", arc_file(1, [("http://a/", http(b"a" * 200))]))
    made = warc.convert(spark, folder).removeprefix("file:")
    assert [r.intact for r in warc.read_warc(spark, made).collect()] == [True]
    import pathlib

    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(pathlib.Path(made).glob("part-*")))
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "a.warc").write_bytes(data.replace(b"aaaa", b"aaab", 1))
    (bad / "b.warc").write_bytes(data[:-30])
    assert [r.intact for r in warc.read_warc(spark, str(bad)).collect()] == [False, False]


def awkward_pages(spark):
    long, same = "<p>é" + "word " * 200_000, "s" * 100
    rows = [(5, "http://a/", same), (3, None, same), (9, "", same), (None, "http://n/", same), (3, "http://a b/\n", same), (None, None, None), (1, "u", None), (2, "u", ""), (4, "u", "s" * 99), (6, "u", "s" * 99), (7, "u", long), (8, "u", long), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" + "é" * 60), (-4, "u", long)]
    return spark.createDataFrame(rows, PAGES), rows


def brute_rows(rows):
    sizes = [(k, (h or "").encode()) for k, _, h in rows]
    least = {}
    for k, b in sizes:
        if len(b) >= 100 and k is not None:
            least[b] = min(k, least.get(b, k))
    return least, sizes


@pytest.mark.parametrize("parts", [1, 7])
def test_round_trip_of_awkward_rows(spark, parts):
    pages, rows = awkward_pages(spark)
    found = warc.round_trip(clashing(pages).repartition(parts)).collect()
    least, sizes = brute_rows(rows)
    assert sorted(((r.key and int(r.key), r.payload_bytes, r.digest) for r in found), key=str) == sorted(((k, len(b), hashlib.sha256(b).hexdigest()) for k, b in sizes), key=str)
    assert all(r.intact for r in found) and len({r.record_id for r in found}) == len(rows)
    by = {hashlib.sha256(b).hexdigest(): k for b, k in least.items()}
    for digest, first in by.items():
        group = [r for r in found if r.digest == digest]
        assert [(r.key, r.refers_key) for r in group if r.kind == "response"] == [(str(first), None)]
        assert {r.refers_key for r in group if r.kind == "revisit"} in (set(), {str(first)})
    assert all(r.kind == "response" for r in found if r.digest not in by)


def test_text_keys_and_an_empty_table(spark):
    rows = [("b\n", "u", "x" * 200), ("a é", "u", "x" * 200), ("", "u", "")]
    found = warc.round_trip(spark.createDataFrame(rows, "name string, link string, body string"), "name", "link", "body").collect()
    assert sorted((r.key, r.kind, r.refers_key) for r in found) == [("", "response", None), ("a é", "response", None), ("b\n", "revisit", "a é")]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_copies_across_the_given_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 100_000)).repartition(5)
    found = warc.round_trip(twice).collect()
    again = [r for r in found if r.kind == "revisit"]
    assert len(again) == pages.count() and all(int(r.key) == int(r.refers_key) + 100_000 for r in again)
