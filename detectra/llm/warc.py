"""A deterministic sharded WARC writer, and a reader that verifies what it reads.

Payloads are the UTF-8 bytes of ``html``, null counts as empty.  Of records with equal payloads of at
least ``least`` bytes the one with the largest page_id is a response, of equal page_ids that with the
largest url, of repeated rows one; all others are revisits, which hold headers only.  Smaller
payloads are all responses.  Rows without a page_id come before all others.

Records are sorted by range: responses by the digest of their payload, other records by a hash of
their own key, each space cut in ranges of equal width.  Neither depends on the rows' partitions, and
as a payload is sent once from each batch and repeated rows are counted before they are dealt, no
range is filled by a common payload or row.  A task writes the archives of its ranges, one gzip member
for each record, and begins a new file where a record would take it beyond ``roll`` compressed bytes;
a record that alone is larger has a file of its own.  Headers, digests and record ids are made anew
from the rows, so the same rows and parameters give the same bytes.

Files are written under temporary names of one attempt; Spark commits the list of those of the
attempts that count, which are then renamed.  The manifest comes last, so archives without a
manifest are not complete, and what lost attempts have left is never read.  The folder may be
on any file system that PyArrow opens.
"""

from __future__ import annotations

import gzip
import io
import math
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterable, Iterator
from hashlib import sha1, sha256
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, wire

#: Payload bytes of a range, revisits of a range, and as many ranges of either kind as there may be.
RANGE_BYTES, RANGE_RECORDS, MOST_RANGES = 64 << 20, 100_000, 20_000
#: Repeated rows that are dealt together.
RUN = 10_000
FILES = "file string, part string, records long, bytes long, sha256 string"
RECORDS = "file string, record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary"
#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if re.match("file:/", uri):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


def record_id(page_id: int | None, url: str | None, print_: bytes, copy: int) -> str:
    """A UUID made from the row: its key, the SHA-256 of its payload, and which of the repeated rows it is."""
    x = sha256(f"{page_id}\n{url if url is None else len(url)}\n{url}\n{copy}\n".encode() + print_).digest()
    return f"urn:uuid:{uuid.UUID(bytes=x[:16], version=4)}"


def member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A record as a gzip member of its own, without a time stamp."""
    head = [VERSION, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{base32(sha1(block).digest())}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(row: dict, copy: int, date: str, level: int) -> bytes:
    """A response, or a revisit if the row has ``ref``, the (page_id, url) of its response."""
    url = quote(row["url"], safe=SAFE) if row["url"] is not None else None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    ref = row["ref"]
    headers = [("WARC-Type", "revisit" if ref else "response"), ("WARC-Record-ID", f"<{record_id(row['page_id'], row['url'], row['print'], copy)}>"), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", url)] if url is not None else []
    headers += [("Page-ID", str(row["page_id"]))] if row["page_id"] is not None else []
    if ref:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(ref['page_id'], ref['url'], row['print'], 0)}>"), ("WARC-Refers-To-Date", date)]
        headers += [("WARC-Refers-To-Target-URI", quote(ref["url"], safe=SAFE))] if ref["url"] is not None else []
        headers += [("Refers-To-Page-ID", str(ref["page_id"]))] if ref["page_id"] is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{base32(row['digest'])}"), ("Content-Type", "application/http; msgtype=response")]
    return member(headers, http if ref else http + row["payload"], level)


class Roll:
    """The archive that a task is writing, under its temporary name."""

    def __init__(self, folder: str, name: str, attempt: str, date: str, level: int):
        self.name, self.part = name, f"_parts/{attempt}-{name}"
        fs, path = opened(folder)
        fs.create_dir(f"{path}/_parts", recursive=True)
        self.out, self.records, self.bytes, self.hash = fs.open_output_stream(f"{path}/{self.part}", compression=None), 0, 0, sha256()
        own = f"urn:uuid:{uuid.UUID(bytes=sha256(name.encode()).digest()[:16], version=4)}"
        headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
        self.put(member(headers, b"software: detectra\r\nformat: WARC File Format 1.1\r\n", level))
        self.records = 0

    def put(self, body: bytes) -> None:
        self.out.write(body)
        self.hash.update(body)
        self.records, self.bytes = self.records + 1, self.bytes + len(body)

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {"file": self.name, "part": self.part, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("part", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))


def written(folder: str, prefix: str, roll: int, date: str, level: int):
    """Writes rows sorted by range and key, and yields a row for each file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        attempt, file, shard, number, last = uuid.uuid4().hex, None, None, 0, None
        for b in batches:
            for row in (r for i in range(0, b.num_rows, 64) for r in b.slice(i, 64).to_pylist()):
                if row["shard"] != shard:
                    if file:
                        yield file.close()
                    file, shard, number, last = None, row["shard"], 0, None
                if row["candidate"]:  # of the rows of a payload the first is the response
                    if row["print"] == last:
                        continue
                    last = row["print"]
                for copy in range(row["first"], row["first"] + row["times"]):
                    body = page_record(row, copy, date, level)
                    if file and file.records and file.bytes + len(body) > roll:
                        yield file.close()
                        file = None
                    if not file:
                        file = Roll(folder, f"{prefix}-{shard}-{number:05d}.warc.gz", attempt, date, level)
                        number += 1
                    file.put(body)
        if file:
            yield file.close()

    return run


def candidates(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Of the rows of a batch with equal payloads the one with the largest (page_id, url)."""
    for b in batches:
        best: dict[bytes, tuple[tuple, int]] = {}
        keys = zip(b.column("print").to_pylist(), b.column("page_id").to_pylist(), b.column("url").to_pylist())
        for i, (p, page, url) in enumerate(keys):
            own = (page is not None, page or 0, url is not None, (url or "").encode()), i
            if p not in best or best[p][0] < own[0]:
                best[p] = own
        yield b.take(pa.array(sorted(i for _, i in best.values()), pa.int64()))


def in_range(number: F.Column, ranges: int) -> F.Column:
    """Which of the ranges of equal width holds a long."""
    return F.least(F.floor((number / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int")


def write(pages: DataFrame, folder: str, least: int = 0, prefix: str = "pages", roll: int = 1 << 30, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Archives of all rows of (page_id, url, html) in a new folder; returns the manifest.

    The manifest, a Parquet table of the folder, has file, records, bytes and sha256 of each archive.
    """
    spark = pages.sparkSession
    fs, path = opened(folder)
    if fs.get_file_info(f"{path}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds archives already")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), F.unhex(F.sha1("payload")).alias("digest"), F.unhex(F.sha2("payload", 256)).alias("print"))
    small = F.when(F.col("bytes") < least, F.col("payload")).alias("small")
    slim = wire.cut(rows.groupBy("page_id", "url", "bytes", "digest", "print", small).agg(F.count(F.lit(1)).alias("times")).withColumn("own", F.xxhash64("page_id", "url", "print")))
    # Null ids sort before all others, as nulls do in a struct.
    key = F.struct("page_id", "url")
    best = graph.beside(slim.filter(F.col("bytes") >= least), "print", "own", best=F.max(key))
    first = (F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))).cast("int").cast("long")
    revisits = best.withColumn("first", first).withColumn("times", F.col("times") - F.col("first")).withColumnRenamed("best", "ref")
    singles = slim.filter(F.col("bytes") < least).withColumn("first", F.lit(0).cast("long")).withColumn("ref", F.lit(None).cast("struct<page_id:long,url:string>"))
    others = revisits.unionByName(singles.select(*revisits.columns)).filter("times > 0")
    others = others.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    others = others.withColumns({"first": F.col("first") + F.col("run") * RUN, "times": F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("run") * RUN), "own": F.xxhash64("own", "run")})
    size, records = slim.agg(F.sum("bytes"), F.sum("times")).first()
    ranges = [min(MOST_RANGES, max(1, math.ceil((x or 0) / each))) for x, each in ((size, RANGE_BYTES), (records, RANGE_RECORDS))]
    names = ["shard", "candidate", "own", "page_id", "url", "bytes", "digest", "print", "first", "times", "ref", "payload"]
    of_digest = (F.conv(F.hex(F.substring("print", 1, 7)), 16, 10).cast("long") - F.lit(2**55)) * 256
    whole = rows.filter(F.col("bytes") >= least).select("page_id", "url", "payload", "bytes", "digest", "print").mapInArrow(candidates, "page_id long, url string, payload binary, bytes long, digest binary, print binary")
    whole = whole.withColumns({"own": of_digest, "first": F.lit(0).cast("long"), "times": F.lit(1).cast("long"), "ref": F.lit(None).cast("struct<page_id:long,url:string>"), "candidate": F.lit(True)})
    whole = whole.withColumn("shard", F.format_string("response-%05d", in_range(F.col("own"), ranges[0])))
    others = others.withColumnRenamed("small", "payload").withColumn("candidate", F.lit(False)).withColumn("shard", F.format_string("revisit-%05d", in_range(F.col("own"), ranges[1])))
    dealt = whole.select(*names).unionByName(others.select(*names)).repartition(sum(ranges), "shard")
    order = ["shard", "own", "print", F.desc("page_id"), F.desc("url"), "first"]
    parts = wire.cut(dealt.sortWithinPartitions(*order).drop("own").mapInArrow(written(folder, prefix, roll, date, level), FILES))

    def publish(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fs, path = opened(folder)
        for b in batches:
            for file, part, size in zip(*(b.column(c).to_pylist() for c in ("file", "part", "bytes"))):
                if fs.get_file_info(f"{path}/{part}").type != pafs.FileType.NotFound:
                    fs.move(f"{path}/{part}", f"{path}/{file}")
                elif fs.get_file_info(f"{path}/{file}").size != size:
                    raise FileNotFoundError(f"{folder}/{part}")
            yield b.select(["file", "records", "bytes", "sha256"])

    named = parts.mapInArrow(publish, "file string, records long, bytes long, sha256 string")
    named.write.parquet(f"{folder}/manifest")
    fs.create_dir(f"{path}/_parts", recursive=True)
    fs.delete_dir(f"{path}/_parts")
    return spark.read.parquet(f"{folder}/manifest")


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; names of headers are lower-cased."""
    while line := stream.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no record here: {line[:80]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{headers.get('warc-record-id')} is cut off")
        yield headers, block


def page_of(headers: dict[str, str], block: bytes) -> dict:
    """What a response or revisit says of its page; digests are computed again and must agree."""
    if f"sha1:{base32(sha1(block).digest())}" != headers["warc-block-digest"]:
        raise ValueError(f"{headers['warc-record-id']} has another block digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(re.findall(r"(?m)^([^:\r\n]+):\s*([^\r\n]*)", head.decode()))
    digest, whole = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"] == "response"
    if whole and (base32(sha1(payload).digest()) != digest or len(payload) != int(http["Content-Length"])):
        raise ValueError(f"{headers['warc-record-id']} has another payload digest")
    number = lambda k: int(headers[k]) if k in headers else None
    return {
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_type": headers["warc-type"],
        "page_id": number("page-id"),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "refers_to": number("refers-to-page-id"),
        "refers_to_record": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "payload": payload if whole else None,
    }


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in the manifest, other than those about the archive itself.

    Columns: file, record_id, record_type, page_id, url (with control and non-ASCII characters as
    percent codes), payload_bytes, payload_digest (base32 SHA-1), refers_to (the response's page_id),
    refers_to_record, and payload, null for revisits.  A broken record fails the read.
    """
    files = spark.read.schema("file string, bytes long").parquet(f"{folder}/manifest")
    names = [x.split()[0] for x in RECORDS.split(", ")][: None if payloads else -1]
    schema = wire.empty(RECORDS).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fs, path = opened(folder)
        for b in batches:
            for file in b.column("file").to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{path}/{file}", compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw, mode="rb"), 1 << 20) as stream:
                    for headers, block in records_of(stream):
                        if headers["warc-type"] in ("response", "revisit"):
                            held.append(page_of(headers, block) | {"file": file})
                            if not payloads:
                                held[-1]["payload"] = None
                            size += 500 + len(held[-1]["payload"] or b"")
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema).select(names)
                            held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema).select(names)

    n = max(1, min(100_000, files.count()))
    return files.select("file").repartition(n, "file").mapInArrow(run, RECORDS if payloads else RECORDS.removesuffix(", payload binary"))
