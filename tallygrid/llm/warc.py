"""WARC archives as a PySpark data source.

Writing: each task writes compressed archives of limited size under names of its own attempt,
and the commit adds a list of the files of successful attempts, so that retries leave nothing
behind that is read. Appending adds a list beside the others; overwriting adds its own, then
removes the earlier lists and their files. Every record is one gzip member whose extra field
holds the member's length.

Reading: partitions are planned from the listed files by size. Equality filters on record
headers are pushed down. A record's headers are inflated first; where they fail a filter or the
payload is not asked for, the reader goes on at the next member without inflating the rest.
Members without the length field, from other writers, are inflated in steps to find their end.

A folder with lists has what they name; a folder without one, as other writers leave it, has all
its ``.warc.gz`` files but for those whose names begin with ``_``, which are of writes under way.

Files are reached through Arrow's file systems, so a shared folder may be local, HDFS or an
object store.

Defined results: a null payload is an empty one and a null header is left out and read back as
null; line ends inside headers become blanks; payloads of any length are written and read
whole, one record at a time; records without rows make an empty archive folder, which is read
as no rows; repeated rows are repeated records; columns of a written frame beyond the schema's
are refused by Spark. For pages see ``archived_pages``.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage,
)

from tallygrid.llm.common import shared_folder, stored

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary")
HEADERS = [c.split()[0] for c in SCHEMA.split(", ")][:-1]
#: Bytes of one archive, of one partition of small archives, and of one batch of payloads.
ARCHIVE, PARTITION, BATCH = 64 << 20, 32 << 20, 8 << 20
#: Lists of committed files begin with this name, files of writes with ``_part``.
LISTING = "_archives-"
#: Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_HEAD = struct.Struct("<4sIBBH2sHII")
_GAP = b"\r\n\r\n"


def file_system(path: str):
    """Arrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# ---- records ----

def record_bytes(record: dict) -> bytes:
    """One record: WARC headers, HTTP headers and, but for revisits, the payload."""
    payload = record["payload"] or b""
    revisit = record["record_type"] == "revisit"
    size = record["payload_bytes"] if revisit else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Payload-Digest", record["payload_digest"] and f"sha256:{record['payload_digest']}"),
        ("WARC-Refers-To", record["refers_to"] and f"<{record['refers_to']}>"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + _GAP


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def member(data: bytes) -> bytes:
    """A gzip member that says its own length in its extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = GZIP_HEAD.size + len(body) + 8
    head = GZIP_HEAD.pack(b"\x1f\x8b\x08\x04", 0, 4, 255, 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(start: bytes) -> int | None:
    """Length of the member that begins with these bytes, if it says so."""
    if len(start) < GZIP_HEAD.size or not start[3] & 4:
        return None
    fields = GZIP_HEAD.unpack_from(start)
    return fields[7] if fields[5] == b"sl" else None


def headers(block: bytes | bytearray) -> dict[str, str]:
    """Header fields by lower-case name; the status or version line is left out."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k.strip()}


class Archive:
    """Records of one open archive, headers first."""

    def __init__(self, stream):
        self.stream = stream

    def records(self, wanted, with_payload: bool) -> Iterator[tuple[dict, bytes | None]]:
        """(fields, payload) of the records for which ``wanted(fields)`` holds."""
        at = 0
        while True:
            self.stream.seek(at)
            first = self.stream.read(8192)
            if not first:
                return
            length = member_length(first)
            inflate = zlib.decompressobj(31)
            text = bytearray(inflate.decompress(first, 1 << 16))
            pending = inflate.unconsumed_tail

            def more() -> bool:
                nonlocal text, pending
                if inflate.eof:
                    return False
                pending = pending or self.stream.read(1 << 18)
                if not pending:
                    raise ValueError(f"archive ends within the record at {at}")
                text += inflate.decompress(pending, 1 << 20)
                pending = inflate.unconsumed_tail
                return True

            while text.count(_GAP, 0, 1 << 20) < 2 and more():
                pass
            warc, _, rest = text.partition(_GAP)
            fields = record_fields(headers(warc), headers(rest.partition(_GAP)[0]))
            take = wanted(fields)
            payload = None
            if take and with_payload and fields["record_type"] != "revisit" or length is None:
                while more():
                    pass
                if take and with_payload and fields["record_type"] != "revisit":
                    block = text[len(warc) + 4:]
                    size = int(headers(warc).get("content-length", len(block)))
                    payload = bytes(block[:size].partition(_GAP)[2])
            if take:
                yield fields, payload
            at = at + length if length else self.stream.tell() - len(inflate.unused_data) - len(pending)


def record_fields(warc: dict[str, str], http: dict[str, str]) -> dict:
    digest = warc.get("warc-payload-digest")
    size = http.get("content-length")
    return {
        "record_id": warc.get("warc-record-id", "").strip("<>") or None, "record_type": warc.get("warc-type"),
        "target_uri": warc.get("warc-target-uri"), "payload_digest": digest and digest.rpartition(":")[2],
        "payload_bytes": int(size) if size and size.isdigit() else None,
        "refers_to": warc.get("warc-refers-to", "").strip("<>") or None,
    }


# ---- lists of committed files ----

def listings(system, folder: str) -> list[str]:
    from pyarrow import fs

    infos = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(i.path for i in infos if i.type == fs.FileType.File and i.base_name.startswith(LISTING))


def listed(system, path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files that a list names."""
    with system.open_input_stream(path) as f:
        found = [line.rsplit("\t", 1) for line in f.read().decode().splitlines()]
    return [(name, int(size)) for name, size in found]


# ---- the data source ----

class Archives(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.with_payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((name, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        system, folder = file_system(self.path)
        lists = listings(system, folder)
        if lists:
            sized = [(f"{folder}/{name}", size) for path in lists for name, size in listed(system, path)]
        else:
            infos = system.get_file_info(fs.FileSelector(folder, recursive=True))
            sized = [(i.path, i.size) for i in infos
                     if i.type == fs.FileType.File and i.path.endswith(".warc.gz") and not i.base_name.startswith("_")]
        out, held, size = [], [], 0
        for name, more in sorted(sized):
            if held and size + more > PARTITION:
                out.append(Archives(held))
                held, size = [], 0
            held.append(name)
            size += more
        return out + ([Archives(held)] if held or not out else [])

    def wanted(self, fields: dict) -> bool:
        return all(fields[name] in values for name, values in self.tests)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows: list[tuple] = []
        size = 0
        for name in partition.value:
            with system.open_input_file(name) as stream:
                for fields, payload in Archive(stream).records(self.wanted, self.with_payload):
                    rows.append((*(fields[c] for c in HEADERS), payload))
                    size += 500 + len(payload or b"")
                    if size > BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*HEADERS, "payload"])


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        stem = f"_part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                if out is None:
                    name = f"{stem}-{len(files)}.warc.gz"
                    out, size = system.open_output_stream(f"{folder}/{name}", compression=None), 0
                data = member(record_bytes({c: batch.column(c)[k].as_py() for c in (*HEADERS, "payload")}))
                out.write(data)
                size += len(data)
                if size >= ARCHIVE:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        before = listings(system, folder) if self.overwrite else []
        lines = "".join(f"{name}\t{size}\n" for m in messages if m is not None for name, size in m.files)
        with system.open_output_stream(f"{folder}/{LISTING}{uuid.uuid4().hex}") as f:
            f.write(lines.encode())
        old = [name for path in before for name, _ in listed(system, path)]
        for path in (*before, *(f"{folder}/{name}" for name in old)):
            system.delete_file(path)

    def abort(self, messages) -> None:
        system, folder = file_system(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- pages ----

def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A record per page: of equal payloads of at least ``least`` bytes, that of the smallest page_id
    holds the payload and the others revisit it."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"),
        payload.alias("payload")).withColumns({"payload_digest": F.sha2("payload", 256),
                                               "payload_bytes": F.octet_length("payload").cast("long")})
    # Written, so that its size is known when the join is planned: small, it is broadcast and no
    # payload is shuffled; otherwise payloads meet their digests in a shuffle.
    first = stored(
        rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("digest", "first"),
        "copied_digests")
    joined = rows.join(first, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))
    return joined.select(
        name.alias("record_id"), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        "target_uri", "payload_digest", "payload_bytes",
        F.when(revisit, F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    page_records(pages).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives of the pages.

    Responses are read with their payloads, of which size and digest are taken; of revisits only
    the headers are read. Both reads push their record type down, so that the other type's payloads
    are never inflated. Defined results: a null html is an empty payload; a html of any length is
    archived whole; rows that repeat the smallest page_id of a payload are all responses; rows
    without a page_id revisit where any equal page has one; an empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_pages(pages, path)
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    responses = read_archives(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    revisits = read_archives(spark, path, payload=False).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
    return responses.union(revisits)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, MIN(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND payload_bytes >= 100
"""
