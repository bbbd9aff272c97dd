"""WARC archives as a Spark data source, written in Python.

Writing: every task writes gzip archives, one member per record, rolled at a
size limit; the files become visible through the manifest that the commit
writes, so files of failed or repeated tasks are never read. Each member
carries its compressed length in a gzip extra field ('sl').

Reading: the manifest gives the files, which are grouped into partitions by
size. Predicates on record type and the other header fields are pushed into
the source. For each member only the first bytes are inflated, until the
header ends; a record that a predicate rejects, or whose payload is not in the
requested schema, is skipped by its length without inflating the rest.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
                                    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
                                    WriterCommitMessage)

from geotrail.session import scratch_path, store

# Names of the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = "<4sIBBH2sHII"     # gzip header with the 'sl' extra field
MEMBER_SIZE = struct.calcsize(MEMBER)
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

HEADER_SCHEMA = ("record_id string, record_type string, target_uri string, record_date string, refers_to string, "
                 "payload_digest string, payload_length long")
SCHEMA = HEADER_SCHEMA + ", payload binary"
FIELDS = ("record_id", "record_type", "target_uri", "record_date", "refers_to", "payload_digest", "payload_length")


def _file_system(path: str):
    """(pyarrow file system, path on it) of a local path or a URI."""
    from pyarrow import fs

    if re.match(r"file:/(?!/)", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


# --- one record ------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value without control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(r: dict, level: int) -> bytes:
    """A gzip member holding one record; r has the fields of SCHEMA."""
    head = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{_clean(r['record_id'])}>"),
            ("WARC-Date", r["record_date"])]
    if r["target_uri"] is not None:
        head.append(("WARC-Target-URI", _clean(r["target_uri"])))
    if r["payload_digest"] is not None:
        digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
        head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head.append(("X-Payload-Length", str(r["payload_length"])))
    body = HTTP_HEAD
    if r["record_type"] == "revisit":
        head.append(("WARC-Profile", REVISIT_PROFILE))
        if r["refers_to"] is not None:
            head.append(("WARC-Refers-To", f"<{_clean(r['refers_to'])}>"))
    else:
        body += r["payload"] or b""
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head)]) + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    data = z.compress(raw) + z.flush()
    size = MEMBER_SIZE + len(data) + 8
    return (struct.pack(MEMBER, b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(raw)) + data
            + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF))


def _plain(value: str | None) -> str | None:
    return value[1:-1] if value and value[0] == "<" and value[-1] == ">" else value


def parse_header(block: bytes) -> dict:
    """The header lines of a record -> the fields of HEADER_SCHEMA."""
    lines = block.decode("utf-8").split("\r\n")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    digest = h.get("warc-payload-digest")
    if digest and digest.startswith("sha1:"):
        digest = base64.b32decode(digest[5:]).hex()
    length = h.get("x-payload-length")
    return {"record_id": _plain(h.get("warc-record-id")), "record_type": h.get("warc-type"),
            "target_uri": h.get("warc-target-uri"), "record_date": h.get("warc-date"),
            "refers_to": _plain(h.get("warc-refers-to")), "payload_digest": digest,
            "payload_length": int(length) if length else None,
            "_content_length": int(h.get("content-length", 0))}


class MemberReader:
    """Records of one archive, header first."""

    def __init__(self, stream):
        self.stream, self.inflated = stream, 0

    def records(self, wanted, with_payload: bool) -> Iterator[dict]:
        at, size = 0, self.stream.size()
        while at < size:
            first = self.stream.read_at(min(2048, size - at), at)
            magic, _, _, _, _, tag, _, length, _ = struct.unpack(MEMBER, first[:MEMBER_SIZE])
            if magic != b"\x1f\x8b\x08\x04" or tag != b"sl":
                raise ValueError(f"no record starts at byte {at}")
            z = zlib.decompressobj(-15)
            data, fed = b"", MEMBER_SIZE
            chunk = first[MEMBER_SIZE:length - 8]
            while b"\r\n\r\n" not in data:
                if not chunk:
                    chunk = self.stream.read_at(min(2048, length - 8 - fed), at + fed)
                    if not chunk:
                        raise ValueError(f"the record at byte {at} has no header end")
                data += z.decompress(chunk, 4096)
                fed += len(chunk) - len(z.unconsumed_tail)
                chunk = z.unconsumed_tail
            block, _, body = data.partition(b"\r\n\r\n")
            record = parse_header(block)
            if wanted(record):
                record["payload"] = None
                if with_payload and record["record_type"] != "revisit":
                    rest = self.stream.read_at(length - fed - 8, at + fed)
                    body = (body + z.decompress(rest) + z.flush())[:record["_content_length"]]
                    record["payload"] = body.partition(b"\r\n\r\n")[2]
                    self.inflated += 1
                yield record
            at += length


# --- predicates ------------------------------------------------------------

def predicate(f):
    """A pushed filter as a function of the header fields, or None."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in FIELDS:
        return None
    if isinstance(f, IsNotNull):
        return lambda r: r[name] is not None
    if isinstance(f, IsNull):
        return lambda r: r[name] is None
    if isinstance(f, EqualNullSafe):
        return lambda r: r[name] == f.value
    tests = {EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
             LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
             StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
             StringContains: lambda x, v: v in x}
    test = tests.get(type(f))
    return None if test is None else lambda r: r[name] is not None and test(r[name], f.value)


# --- the data source -------------------------------------------------------

class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.names, self.schema = [f.name for f in schema.fields], to_arrow_schema(schema)
        self.path, self.tests = options["path"], []
        self.split = int(options.get("split_bytes", 32 << 20))

    def pushFilters(self, filters):
        for f in filters:
            test = predicate(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        fs, root = _file_system(self.path)
        with fs.open_input_stream(f"{root}/manifest.json") as s:
            files = json.loads(s.read())
        limit = min(self.split, max(1 << 20, sum(f["bytes"] for f in files) // 64))
        groups, room = [], 0
        for f in files:
            if not groups or room < f["bytes"]:
                groups.append([])
                room = limit
            groups[-1].append(f"{root}/{f['name']}")
            room -= f["bytes"]
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        fs, _ = _file_system(self.path)
        wanted = lambda r: all(t(r) for t in self.tests)
        rows, held = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as stream:
                for r in MemberReader(stream).records(wanted, "payload" in self.names):
                    rows.append({n: r[n] for n in self.names})
                    held += len(r["payload"] or b"") + 300
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=self.schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.schema)


class Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.roll = int(options.get("file_bytes", 64 << 20))
        self.level = int(options.get("level", 3))

    def write(self, iterator):
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    if out is None:
                        files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "bytes": 0})
                        out = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    member = encode_record(r, self.level)
                    out.write(member)
                    files[-1]["bytes"] += len(member)
                    if files[-1]["bytes"] >= self.roll:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        with fs.open_output_stream(f"{root}/manifest.json", compression=None) as s:
            s.write(json.dumps(files).encode())

    def abort(self, messages):
        fs, root = _file_system(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            fs.delete_file(f"{root}/{f['name']}")


class WarcSource(DataSource):
    """format("warc"): option path (shared by driver and executors)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


# --- the operators ---------------------------------------------------------

def write_warc(records: DataFrame, path: str) -> str:
    """Write records (columns of SCHEMA) as archives under a new folder."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.select(*SCHEMA_NAMES).write.format("warc").mode("append").option("path", path).save()
    return path


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under ``path``; without ``payload`` only headers are inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return (spark.read.format("warc").schema(SCHEMA if payload else HEADER_SCHEMA).option("path", path).load())


SCHEMA_NAMES = [*FIELDS, "payload"]


def archive_records(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of all pages, equal payloads being stored once.

    The payload is the page in UTF-8 (null: empty). Of pages with equal
    payloads of at least ``min_bytes`` bytes the one with the largest id is a
    response and the others are revisits of it; smaller pages are always
    responses. Rows that repeat that largest id with the same payload are
    responses too; a null id is the smallest, and if all ids of a group are
    null each is a response. Record ids are 'urn:page:<id>' ('urn:page:' for
    null). Digests that several pages share are found with partial
    aggregation, and only those are joined back.
    """
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = (pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("target_uri"),
                         payload.alias("payload"))
            .withColumn("payload_digest", F.sha1("payload"))
            .withColumn("payload_length", F.octet_length("payload").cast("long")))
    shared = store(rows.filter(F.col("payload_length") >= min_bytes).groupBy("payload_digest", "payload_length")
                   .agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1").drop("n"), "shared")
    out = rows.join(shared, ["payload_digest", "payload_length"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return out.select(urn(F.col("id")).alias("record_id"),
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                      F.lit(date).alias("record_date"), F.when(revisit, urn(F.col("first"))).alias("refers_to"),
                      "payload_digest", "payload_length", F.when(~revisit, F.col("payload")).alias("payload"))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write ``pages`` as archives (see archive_records); returns the folder,
    a new one under the shared checkpoint folder by default."""
    path = path or scratch_path(pages.sparkSession, "warc")
    return write_warc(archive_records(pages, **options), path)
