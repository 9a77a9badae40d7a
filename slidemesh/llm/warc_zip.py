"""WARC archives packaged in ZIP files: written by tasks, read back by ranges without extraction.

A package holds one stored member archive/data.warc.gz (a gzip member per record) and one stored member indexes/index.cdxj (a line per record
with its offset and length). The reader parses the end record, the ZIP64 records and the central directory itself, finds where the stored
members' bytes begin, reads the index, and then each record by its range. Packages lie below spark.checkpoint.dir, or a folder given, in
any store that pyarrow's file systems open. A task writes under a name of its own and reports it; the written report lists what counts, so
a lost or repeated task leaves at most a file that nobody reads."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidemesh.llm.common import Scratch, query, ship, table

PACKAGE_BYTES = 256_000_000     # of payload, then a task begins another package
DATE = "2020-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ_BYTES = 8_000_000          # neighbouring records are read together up to this


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. A revisit has the HTTP head only, and names the record with the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = head if revisit else head + payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields in lower case, payload) of one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a WARC record is cut")
    return fields, block.partition(b"\r\n\r\n")[2]


class PackageWriter:
    """Streams records into the data member; the index follows when it is closed."""

    def __init__(self, uri: str):
        self.uri = uri
        fs, path = _store(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.payload, self.lines = 0, 0, []

    def add(self, page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packer.compress(record(page_id, url, payload, refers_to, revisit)) + packer.flush()
        self.member.write(data)
        self.lines.append(json.dumps({"url": url, "id": page_id, "offset": self.at, "length": len(data)}))
        self.at += len(data)
        self.payload += len(payload)

    def close(self) -> tuple[str, int]:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX, (2020, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
            f.write("".join(x + "\n" for x in self.lines).encode())
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines)


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """{name: (method, local header offset, stored size)} from the central directory of an open random-access file; ZIP64 where used."""
    tail = f.read_at(min(size, 65_557), max(0, size - 65_557))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    at = max(0, size - 65_557) + end
    if (count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and at >= 20:
        mark, _, where, _ = struct.unpack("<4sIQI", f.read_at(20, at - 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, = struct.unpack("<4s", f.read_at(4, where))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", f.read_at(24, where + 32))
    directory, out, p = f.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[p:p + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, name_len, extra_len, note_len = struct.unpack_from("<IIHHH", directory, p + 20)
        offset, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46:p + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        e, stop = p + 46 + name_len, p + 46 + name_len + extra_len
        while e + 4 <= stop:
            kind, n = struct.unpack_from("<HH", directory, e)
            if kind == 1:       # ZIP64: only the fields that do not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", directory, e + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            e += 4 + n
        out[name] = (method, offset, packed)
        p = stop + note_len
    return out


def data_start(f, offset: int) -> int:
    """Where the bytes of a member begin, from its local header."""
    head = f.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return offset + 30 + name_len + extra_len


def read_index(uri: str) -> list[tuple[int, int]]:
    """(absolute offset, length) of all records of a package, in order."""
    fs, path = _store(uri)
    with fs.open_input_file(path) as f:
        found = members(f, f.size())
        for name in (DATA, INDEX):
            if name not in found or found[name][0] != 0:
                raise ValueError(f"{name} is not a stored member")
        base = data_start(f, found[DATA][1])
        lines = f.read_at(found[INDEX][2], data_start(f, found[INDEX][1])).decode().splitlines()
    return [(base + x["offset"], x["length"]) for x in map(json.loads, lines)]


def written(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per page; returns (package, records). Of pages with equal payloads of `min_bytes` or more, that with the smallest id is the
    response and the others revisit it; rows that repeat the id of the response are responses as well. Only the digests of payloads are
    grouped, combined map-side; pages are joined to the digests that occur more than once."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("mark", F.sha2("payload", 256))
    repeated = src.where(F.octet_length("payload") >= min_bytes).groupBy("mark").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", "first")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    plan = src.join(repeated, "mark", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers_to"), revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []
        for b in batches:
            for i, url, data, to, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                open_ = open_ or PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                open_.add(i, url, data, to, again)
                if open_.payload >= package_bytes:
                    done.append(open_.close())
                    open_ = None
        if open_:
            done.append(open_.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["package", "records"])

    return plan.mapInArrow(write, "package string, records long")


def read_records(packages: DataFrame) -> DataFrame:
    """(id, url, record_type, refers_to, digest, payload) of all records of the listed packages (package). The ranges are dealt out anew, so that
    a large package is read by many tasks; each reads its ranges only. A digest that does not match its payload raises."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                spans = read_index(uri)
                for at in range(0, len(spans), 50_000):
                    part = spans[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part)), pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["package", "start", "length"])

    names = ["id", "url", "record_type", "refers_to", "digest", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = sorted(zip(*(c.to_pylist() for c in b.columns)))
            k = 0
            while k < len(spans):
                uri, begin, n = spans[k]
                stop, end = k, begin
                while stop < len(spans) and spans[stop][0] == uri and (stop == k or spans[stop][1] == end and end + spans[stop][2] - begin <= READ_BYTES):
                    end = spans[stop][1] + spans[stop][2]
                    stop += 1
                fs, path = _store(uri)
                with fs.open_input_file(path) as f:
                    data = f.read_at(end - begin, begin)
                rows = []
                for _, at, length in spans[k:stop]:
                    fields, payload = parse_record(zlib.decompress(data[at - begin:at - begin + length], 31))
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                    if kind == "response" and payload_digest(payload) != digest:
                        raise ValueError(f"payload digest differs in {uri} at {at}")
                    ids = [x.removeprefix("<urn:page:").removesuffix(">") or None if x is not None else None for x in (fields["warc-record-id"], fields.get("warc-refers-to"))]
                    rows.append((ids[0], fields.get("warc-target-uri"), kind, ids[1], digest, payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "payload" else pa.string()) for x, c in zip(names, zip(*rows))], names)
                k = stop

    spread = packages.select("package").repartition(packages.sparkSession.sparkContext.defaultParallelism).mapInArrow(ranges, "package string, start long, length long")
    n = max(1, packages.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.repartitionByRange(n, "package", "start").mapInArrow(read, "id string, url string, record_type string, refers_to string, digest string, payload binary")


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from packages it has just been written to.

    A null html is an empty payload; a null url is left out of the record; a null id is written without a name and read as null. Ids may repeat.
    Revisits take the size from the response they name. An empty table gives an empty result; other columns are not looked at."""
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc")
    report = scratch.save(written(pages, folder or scratch.path("packages"), min_bytes, id_col, url_col, html_col), "report")
    kind = pages.schema[id_col].dataType
    rows = read_records(report).select(F.col("id").cast(kind).alias("id"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("bytes"))
    rows = scratch.save(rows, "read")
    sizes = rows.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("d"), F.col("id").alias("to")).agg(F.max("bytes").alias("full"))
    out = rows.join(sizes, (F.col("payload_digest") == F.col("d")) & (F.col("refers_to") == F.col("to")), "left")
    return out.select("id", F.coalesce("bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


@query("op8_warc_zip")
def op8_warc_zip(spark, sf):
    """One row per page, from the archives it was written to."""
    return archived(table(spark, sf, "pages")).withColumnRenamed("id", "page_id")
