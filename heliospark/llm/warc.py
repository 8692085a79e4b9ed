"""Legacy ARC archives converted to WARC, and both read record by record.

An ARC file opens with a block that names its version. Version 1 states five
fields before each record, version 2 ten; the last one is the record's length.
The parser follows these declared lengths, so that nothing inside a record is
taken for a header. What WARC wants besides is synthesised: record identifiers
(from archive and offset, equal in every attempt of a task), ISO times, types
and digests. Of equal payloads one stays a response, the others become
revisits that refer to it.

Archives are written by Spark's text writer with the record's end as line
separator, so they are committed like any other table. They are read as
streams, one record in memory at a time; an archive is the unit of work.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import uuid
from collections.abc import Iterator
from hashlib import sha1, sha256
from typing import BinaryIO, NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm.common import stage
from heliospark.session import new_folder

#: The fields of a record's header line, by version of the format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fixed value: the profile of revisits that are known by their payload's digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: HTTP header that carries a row's key through the archives.
KEY_HEADER = "X-Archive-Key"
#: Smaller payloads are never revisits.
LEAST_BYTES = 100
#: Bytes of records that a task hands on at a time.
HANDED_ON = 8 << 20
NO_DATE = "19700101000000"
_KEY = re.compile(rb"(?im)^" + KEY_HEADER.encode() + rb":[ \t]*([^\r\n]*)")


class Entry(NamedTuple):
    """A record of an ARC file, or a fault: ``header`` (unreadable lines, skipped) or ``truncated``."""

    offset: int
    version: int
    fields: dict[str, str]
    content: bytes
    fault: str | None

    @property
    def url(self) -> str:
        return self.fields.get("URL", "-")


def _header(line: bytes, version: int) -> dict[str, str] | None:
    """The fields of a header line; NULL if it is none. Spaces beyond those between fields belong to the URL."""
    names, parts = ARC_FIELDS[version], line.split(b" ")
    if parts[0].startswith(b"filedesc:"):  # read before the version is known: the length is last in both
        names, parts = ARC_FIELDS[1], [*parts[:4], parts[-1]]
    more = len(parts) - len(names)
    if more < 0:
        return None
    values = [b" ".join(parts[: more + 1]), *parts[more + 1 :]]
    found = {n: v.decode("utf-8", "replace") for n, v in zip(names, values, strict=True)}
    sound = re.fullmatch("[0-9]+", found["Archive-length"]) and re.fullmatch("[0-9]{4,17}", found["Archive-date"])
    return found if sound else None


def arc_entries(stream: BinaryIO) -> Iterator[Entry]:
    """The records of an uncompressed ARC stream in order.

    Blank lines between records don't count. Lines that are no header are
    skipped to the next one that is; a run of them gives one fault.
    """
    version, at, lost = 1, 0, False
    while line := stream.readline():
        start, at = at, at + len(line)
        head = line.rstrip(b"\r\n")
        if not head:
            continue
        fields = _header(head, version)
        if fields is None:
            if not lost:
                yield Entry(start, version, {}, line, "header")
            lost = True
            continue
        lost, length = False, int(fields["Archive-length"])
        content = stream.read(length)
        at += len(content)
        if fields["URL"].startswith("filedesc:"):
            named = re.match(rb"[0-9]+", content)
            version = int(named[0]) if named and int(named[0]) in ARC_FIELDS else 1
        yield Entry(start, version, fields, content, None if len(content) == length else "truncated")


def _http(content: bytes) -> tuple[bytes, bytes] | None:
    """HTTP header with its blank line, and payload; None if the content is no HTTP message."""
    if not content.startswith(b"HTTP/"):
        return None
    ends = [(content.find(b), len(b)) for b in (b"\r\n\r\n", b"\n\n")]
    at, size = min(((i, n) for i, n in ends if i >= 0), default=(len(content), 0))
    return content[: at + size], content[at + size :]


def iso_time(date: str) -> str:
    """ARC's digits (yyyymmddhhmmss or fewer) as WARC's time; days and times that are missing are the first."""
    digits = (date + NO_DATE[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


class Record(NamedTuple):
    """What WARC states of an ARC entry."""

    record_id: str
    kind: str
    date: str
    uri: str | None
    media: str
    key: str | None
    head: bytes
    payload: bytes
    digest: str


def record_of(entry: Entry, archive: str) -> Record:
    """Identifier, type, time and digest of an entry: a version block gives warcinfo, HTTP a response, all else a resource."""
    http = _http(entry.content)
    media = entry.fields.get("Content-type", "application/octet-stream")
    kind, key = "resource", None
    head, payload = b"", entry.content
    if entry.url.startswith("filedesc:"):
        kind, media = "warcinfo", "application/warc-fields"
        lines = entry.content.decode("utf-8", "replace").split("\n", 1)
        payload = f"software: heliospark\r\nformat: WARC/1.1\r\nconvertedFrom: {archive}\r\narcVersion: {lines[0].strip()}\r\n".encode()
    elif http:
        kind, media = "response", "application/http; msgtype=response"
        head, payload = http
        if found := _KEY.search(head):
            key = unquote(found[1].decode("ascii", "replace"))
    uri = None if entry.url == "-" or kind == "warcinfo" else quote(entry.url, safe=":/?#[]@!$&'()*+,;=%~-._")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{entry.offset}")
    return Record(f"<urn:uuid:{name}>", kind, iso_time(entry.fields.get("Archive-date", NO_DATE)), uri, media, key, head, payload, sha256(payload).hexdigest())


def warc_record(of: Record, ip: str | None, info: str | None, truncated: bool, refers: tuple[str, str, str] | None) -> bytes:
    """The record without its closing two empty lines. ``refers``: identifier, URI and time of the response that a revisit stands for."""
    block = of.head if refers else of.head + of.payload
    rows = [("WARC-Type", "revisit" if refers else of.kind), ("WARC-Record-ID", of.record_id), ("WARC-Date", of.date)]
    rows += [("WARC-Target-URI", of.uri)] if of.uri else []
    rows += [("WARC-IP-Address", ip)] if ip and ip != "0.0.0.0" else []
    rows += [("WARC-Warcinfo-ID", info)] if info else []
    if of.kind != "warcinfo":
        rows.append(("WARC-Payload-Digest", f"sha256:{of.digest}"))
    if refers:
        rows += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0])]
        rows += [(n, v) for n, v in (("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", refers[2])) if v]
    rows += [("WARC-Truncated", "length")] if truncated else []
    rows += [("WARC-Block-Digest", "sha1:" + base64.b32encode(sha1(block).digest()).decode()), ("Content-Type", of.media), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{n}: {v}\r\n" for n, v in rows), "\r\n"]).encode() + block


def warc_entries(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(named fields in lower case, block, whole) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields, name = {}, None
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:  # a folded line goes on
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        length = int(fields.get("content-length", "0"))
        block = stream.read(length)
        yield fields, block, len(block) == length


def open_archive(uri: str) -> BinaryIO:
    """The archive as a plain stream, unpacked if it is gzip (as one member or one for each record)."""
    if uri.startswith("file:"):
        files, path = pyarrow.fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", uri))
    else:
        files, path = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    raw = files.open_input_file(path)
    packed = raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)


def _files(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """(archive): the files of a folder, and into how many tasks to deal them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("archive"))
    return files, max(1, min(files.count(), 64 * spark.sparkContext.defaultParallelism))


def _handed_on(values: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for value in values:
        held.append(value)
        size += len(value)
        if size >= HANDED_ON:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])


def _write(records: DataFrame, ending: str, name: str) -> str:
    """The records' bytes, each followed by ``ending``, as gzip files; a file holds what a task makes, in order."""
    folder = new_folder(records.sparkSession, name)
    writer = records.select(F.col("value").cast("string")).write.option("zlib.compress.level", "BEST_SPEED")
    writer.text(folder, compression="gzip", lineSep=ending)
    return folder


def _typed_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# ---------------------------------------------------------------- ARC


def write_arc(rows: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", captured: str = "20080101000000") -> str:
    """Folder of ARC archives with one record a row, files of version 1 and 2 in turn.

    A record is an HTTP response whose body is the payload (text in UTF-8 or
    binary; NULL counts as empty) and whose header carries the key. White space
    in URLs is escaped; a NULL or empty URL is ``-``. An empty table gives
    archives without records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"archive-{part:05d}.arc"

        def records() -> Iterator[bytes]:
            at = 0

            def framed(uri: str, mime: str, content: bytes, ip: str) -> bytes:
                own = [uri, ip, captured, mime]
                if version == 2:
                    own += ["200", "-", "-", str(at), name]
                return " ".join([*own, str(len(content))]).encode() + b"\n" + content

            for batch in batches:
                for k, u, body in zip(*(batch[c].to_pylist() for c in ("key", "url", "payload")), strict=True):
                    if not at:
                        fields = f"{version} 0 heliospark\n{' '.join(ARC_FIELDS[version])}\n".encode()
                        first = framed(f"filedesc://{name}", "text/plain", fields, "0.0.0.0")
                        yield first
                        at += len(first) + 1
                    body = body or b""
                    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(body)}"]
                    lines += [f"{KEY_HEADER}: {quote(k, safe='')}"] if k is not None else []
                    record = framed(re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", u or "-"), "text/html", "\r\n".join([*lines, "", ""]).encode() + body, "127.0.0.1")
                    yield record
                    at += len(record) + 1

        yield from _handed_on(records())

    narrow = rows.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload"))
    return _write(narrow.mapInArrow(run, "value binary"), "\n", "arc")


_ENTRY = "archive string, offset long, version int, record_id string, kind string, date string, uri string, key string, payload_bytes long, digest string, fault string"


def read_arc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each record of the folder's ARC files (gzip or not): what the converter states of it, and its payload if asked.

    Faults are rows too: unreadable lines have kind NULL and fault ``header``;
    a record that ends before its declared length has fault ``truncated``.
    """
    files, tasks = _files(spark, folder)
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = _ENTRY + (", payload binary" if payload else "")
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                with open_archive(archive) as stream:
                    for entry in arc_entries(stream):
                        r = record_of(entry, archive)
                        row = (archive, entry.offset, entry.version, r.record_id, None if entry.fault == "header" else r.kind, r.date, r.uri, r.key, len(r.payload), r.digest, entry.fault)
                        rows.append((*row, r.payload) if payload else row)
                        size += len(r.payload) if payload else 400
                        if size >= HANDED_ON:
                            yield _typed_batch(rows, schema)
                            rows, size = [], 0
        yield _typed_batch(rows, schema)

    return files.repartition(tasks).mapInArrow(run, columns)


# ---------------------------------------------------------------- conversion


def revisits(entries: DataFrame, key_type: str = "long", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(archive, offset, refers_id, refers_uri, refers_date): the responses that become revisits.

    Of equal payloads (length and SHA-256) of at least ``least_bytes`` the one
    with the least key, compared as ``key_type``, stays; a missing key is greater
    than all others, ties go to archive and offset.
    """
    typed = F.col("key").cast(key_type)
    large = entries.where((F.col("kind") == "response") & F.col("fault").isNull() & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(typed.isNull().alias("none"), typed.alias("key"), "archive", "offset", "record_id", "uri", "date")
    first = large.groupBy("digest", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    equal = large.select("digest", "payload_bytes", "archive", "offset").join(first, ["digest", "payload_bytes"])
    others = equal.where((F.col("archive") != F.col("first.archive")) | (F.col("offset") != F.col("first.offset")))
    return others.select("archive", "offset", F.col("first.record_id").alias("refers_id"), F.col("first.uri").alias("refers_uri"), F.col("first.date").alias("refers_date"))


def convert(spark: SparkSession, folder: str, key_type: str = "long", least_bytes: int = LEAST_BYTES) -> str:
    """Folder of WARC archives with the records of the folder's ARC archives.

    The archives are read twice: once for the digests, by which copies are
    found, once to be rewritten beside the list of their revisits. Payloads are
    never shuffled. Unreadable lines are left out (``read_arc`` reports them);
    a truncated record is kept, marked as such, and never a revisit.
    """
    entries = stage(read_arc(spark, folder), "arc-index")
    files, tasks = _files(spark, folder)
    todo = files.select("archive", F.lit(-1).cast("long").alias("offset"), *[F.lit(None).cast("string").alias(c) for c in ("refers_id", "refers_uri", "refers_date")])
    todo = todo.unionByName(revisits(entries, key_type, least_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch[c].to_pylist() for c in ("archive", "offset", "refers_id", "refers_uri", "refers_date")), strict=True)

        def records() -> Iterator[bytes]:
            rows = lines()
            row = next(rows, None)
            while row:  # the row of a file, then those of its revisits by offset
                archive, info = row[0], None
                row = next(rows, None)
                with open_archive(archive) as stream:
                    for entry in arc_entries(stream):
                        if entry.fault == "header":
                            continue
                        refers = None
                        if row and row[0] == archive and row[1] == entry.offset:
                            refers, row = row[2:], next(rows, None)
                        made = record_of(entry, archive)
                        yield warc_record(made, entry.fields.get("IP-address"), info, entry.fault == "truncated", refers)
                        info = made.record_id if made.kind == "warcinfo" else info

        yield from _handed_on(records())

    dealt = todo.repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return _write(dealt.mapInArrow(run, "value binary"), "\r\n\r\n", "warc")


# ---------------------------------------------------------------- WARC

_RECORD = "record_id string, kind string, date string, uri string, key string, payload_bytes long, digest string, refers_id string, intact boolean"


def read_warc(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """A row for each response, revisit and resource of the folder's WARC files, and its payload if asked.

    ``payload_bytes`` and ``digest`` are reckoned from the payload that is read;
    a revisit has none and gives the digest that it states. ``intact``: the
    block is whole and the digests stated agree with it.
    """
    files, tasks = _files(spark, folder)
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    columns = _RECORD + (", payload binary" if payload else "")
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                with open_archive(archive) as stream:
                    for fields, block, whole in warc_entries(stream):
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit", "resource"):
                            continue
                        http = _http(block)
                        head, body = http or (b"", block)
                        found = _KEY.search(head)
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        read = None if kind == "revisit" else sha256(body).hexdigest()
                        intact = whole and (kind == "revisit" or not stated or stated == read)
                        if (mark := fields.get("warc-block-digest", "")).startswith("sha1:"):
                            intact = intact and mark[5:] == base64.b32encode(sha1(block).digest()).decode()
                        row = (fields.get("warc-record-id"), kind, fields.get("warc-date"), fields.get("warc-target-uri"), unquote(found[1].decode("ascii", "replace")) if found else None, None if kind == "revisit" else len(body), read or stated, fields.get("warc-refers-to"), intact)
                        rows.append((*row, None if kind == "revisit" else body) if payload else row)
                        size += len(body) if payload else 400
                        if size >= HANDED_ON:
                            yield _typed_batch(rows, schema)
                            rows, size = [], 0
        yield _typed_batch(rows, schema)

    return files.repartition(tasks).mapInArrow(run, columns)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with refers_key, and with the size of its response for each revisit.

    A response that thousands of revisits refer to is one row of one side: the
    join's skew is on the other side, which adaptive execution splits.
    """
    records = stage(records, "warc-records")
    whole = records.where("kind <> 'revisit'").withColumn("refers_key", F.lit(None).cast("string"))
    first = records.where("kind = 'response'").select(F.col("record_id").alias("refers_id"), F.col("key").alias("refers_key"), F.col("payload_bytes").alias("size"))
    again = records.where("kind = 'revisit'").join(first, "refers_id", "left")
    return whole.unionByName(again.withColumn("payload_bytes", F.col("size")).drop("size"))


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(record_id, kind, date, uri, key, payload_bytes, digest, refers_id, refers_key, intact): the rows after ARC and WARC.

    The rows are written as ARC archives, converted, and read from the WARC
    archives. A row is one record: NULL keys, repeated rows and empty payloads
    included. Columns of other names are not looked at. Keys come back as
    text. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    return resolved(read_warc(spark, convert(spark, write_arc(pages, key, url, payload), dict(pages.dtypes)[key])))
