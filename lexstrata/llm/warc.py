"""WARC archives as a PySpark data source, ``spark.read.format("warc")``.

Reading: the driver lists the archives and packs them into partitions by size. Predicates
on ``record_type`` and other header columns are handed to the source with ``where``; a task
walks from record to record, parses the header block first, and when the header fails a
predicate, or no payload column is asked for, it skips the block without decoding it. Each
set of predicates is a relation of its own, so one archive can be read in several ways in
one query. Archives may be plain or compressed by gzip, one member a record. The members
written here carry their lengths in the header, so that a skipped block is not even
inflated; other members are inflated to their end.

Writing: each task writes archives of its own, rolled over at ``rollBytes``, under names no
other attempt uses, and reports them; the commit lists the finished archives in
``_archives.json``. Reading a folder with that list ignores what lost attempts left behind.
Paths go through ``pyarrow.fs``, so any store it can open will do.

Defined cases: a null payload is written as an empty one; header values lose line breaks; a
record without a length, or cut short, raises an error that names archive and offset (of
the inflated bytes); an empty table gives a folder with no archives, read as no rows. Rows
that repeat id and payload are alike: if their payload stays, each is a response. A null id
never stays before another id; a group of null ids alone is all responses.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import id_filter, materialize, work_path

LIST_NAME = "_archives.json"
PARTITION_BYTES = 64 << 20
ROLL_BYTES = 256 << 20
SMALL_PAYLOAD = 1000
SALTS = 16

# Column <-> header field.
HEADER_FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADER_FIELDS) + ", content_length long, archive string, offset long, payload binary"
RECORD_END = b"\r\n\r\n"
# The head of a gzip member with an extra field "sl" of eight bytes, and its trailer.
MEMBER_HEAD = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + b"\x0c\x00" + b"sl" + b"\x08\x00"
LENGTHS, TRAILER = struct.Struct("<II"), struct.Struct("<II")


def filesystem(path: str):
    """(file system, path inside it) of a URI or plain path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` as every task must see it: with the scheme and authority that Spark itself
    would use for it, in the spelling of the file systems opened by tasks."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = target.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    scheme, colon, rest = uri.partition(":")
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest


def record_bytes(header: dict[str, str], payload: bytes) -> bytes:
    lines = ["WARC/1.0"] + [f"{k}: {' '.join(str(v).split())}" for k, v in header.items() if v is not None]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + RECORD_END + payload + RECORD_END


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose extra field ``sl`` holds its compressed and inflated lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = len(MEMBER_HEAD) + LENGTHS.size + len(body) + TRAILER.size
    if max(total, len(data)) > 0xFFFFFFFF:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(data) + packer.flush()
    return MEMBER_HEAD + LENGTHS.pack(total, len(data)) + body + TRAILER.pack(zlib.crc32(data), len(data))


class _Inflated:
    """Concatenated gzip members as one stream. ``skip`` seeks over the rest of a member
    where the member's header tells its lengths."""

    def __init__(self, raw):
        self.raw, self.unit, self.rest = raw, None, b""
        self.held, self.taken, self.at = bytearray(), 0, 0  # held[taken:] is inflated and not yet read
        self.member: tuple[int, int] | None = None  # (compressed end, inflated end) of the member being inflated
        self.made = 0  # bytes inflated so far

    def _begin(self) -> bool:
        self.rest += self.raw.read(max(0, 64 - len(self.rest)))
        if not self.rest:
            return False
        self.unit, self.member = zlib.decompressobj(31), None
        if self.rest.startswith(MEMBER_HEAD) and len(self.rest) >= len(MEMBER_HEAD) + LENGTHS.size:
            packed, plain = LENGTHS.unpack_from(self.rest, len(MEMBER_HEAD))
            self.member = self.raw.tell() - len(self.rest) + packed, self.made + plain
        return True

    def _more(self) -> bool:
        if self.unit is None and not self._begin():
            return False
        data = self.rest or self.raw.read(1 << 16)
        self.rest = b""
        if not data:
            return False
        out = self.unit.decompress(data)
        self.made += len(out)
        self.held += out
        if self.unit.eof:
            self.rest, self.unit = self.unit.unused_data, None
        return True

    def _take(self, n: int) -> bytes:
        out = bytes(memoryview(self.held)[self.taken : self.taken + n])
        self.taken += len(out)
        self.at += len(out)
        if 2 * self.taken >= len(self.held):  # moves at most as many bytes as it frees
            del self.held[: self.taken]
            self.taken = 0
        return out

    def read(self, n: int) -> bytes:
        while len(self.held) - self.taken < n and self._more():
            pass
        return self._take(n)

    def skip(self, n: int) -> bool:
        end = self.at + n
        while self.at < end:
            inside = self.unit is not None and self.member is not None and self.made < end <= self.member[1]
            if inside and end + len(RECORD_END) >= self.member[1] and self.member[0] <= self.raw.size():
                # The block ends with this member: go to its last bytes without inflating.
                self.raw.seek(self.member[0])
                self.held = bytearray(RECORD_END[len(RECORD_END) - (self.member[1] - end) :])
                self.taken, self.at, self.made = 0, end, self.member[1]
                self.unit, self.rest = None, b""
            elif not self.read(min(end - self.at, 1 << 16)):
                break
        return self.at == end

    def readline(self) -> bytes:
        seen = self.taken
        while (cut := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                break
        return self._take(cut + 1 - self.taken if cut >= 0 else len(self.held) - self.taken)


class _Plain:
    def __init__(self, raw):
        self.size, self.at, self.buffer = raw.size(), 0, io.BufferedReader(raw, 1 << 18)

    def skip(self, n: int) -> bool:
        self.at = self.buffer.seek(min(self.at + n, self.size))
        return self.at < self.size  # a record ends before the file does, with two line ends

    def read(self, n: int) -> bytes:
        out = self.buffer.read(n)
        self.at += len(out)
        return out

    def readline(self) -> bytes:
        out = self.buffer.readline()
        self.at += len(out)
        return out


def walk(stream, name: str) -> Iterator[tuple[int, dict[str, str], int]]:
    """(offset, header fields in lower case, block length); the caller reads the block and
    calls nothing else: what it leaves unread is skipped here."""
    while True:
        offset = stream.at
        first = stream.readline()
        while first in (b"\r\n", b"\n"):
            offset = stream.at
            first = stream.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at {offset} of {name}")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        if not fields.get("content-length", "").isdigit():
            raise ValueError(f"record without a length at {offset} of {name}")
        length = int(fields["content-length"])
        end = stream.at + length
        yield offset, fields, length
        if stream.at < end and not stream.skip(end - stream.at):
            raise ValueError(f"record cut short at {offset} of {name}")


@dataclass
class ArchivePartition(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns, self.path = [f.name for f in schema.fields], options["path"]
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.with_payload = "payload" in self.columns
        where = json.loads(options.get("where", "{}"))
        if unknown := set(where) - set(HEADER_FIELDS):
            raise ValueError(f"not header columns: {sorted(unknown)}")
        self.tests = [(HEADER_FIELDS[c].lower(), None if ok is None else frozenset(ok)) for c, ok in where.items()]

    def archives(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        store, path = filesystem(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        if store.get_file_info(f"{path}/{LIST_NAME}").type == fs.FileType.File:
            listed = json.loads(store.open_input_stream(f"{path}/{LIST_NAME}").read())
            return [(f"{path}/{name}", n) for name, n in listed]
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        return [(x.path, x.size) for x in found if x.type == fs.FileType.File and ".warc" in x.base_name and not x.base_name.startswith(("_", "."))]

    def partitions(self):
        """Archives of similar total size together, the largest first."""
        parts: list[list[str]] = []
        room = 0
        for path, n in sorted(self.archives(), key=lambda x: (-x[1], x[0])):
            if n > room or not parts:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(path)
            room -= n
        return [ArchivePartition(tuple(p)) for p in parts] or [ArchivePartition(())]

    def read(self, partition):
        store, _ = filesystem(self.path)
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c in ("content_length", "offset") else pa.string()) for c in self.columns])
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with store.open_input_file(path) as raw:
                zipped = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = _Inflated(raw) if zipped else _Plain(raw)
                for offset, fields, length in walk(stream, path):
                    if not all((v := fields.get(name)) is not None and (ok is None or v in ok) for name, ok in self.tests):
                        continue
                    values = {"content_length": length, "archive": path.rpartition("/")[2], "offset": offset}
                    if self.with_payload:
                        values["payload"] = stream.read(length)
                        held += length
                    rows.append(tuple(values[c] if c in values else fields.get(HEADER_FIELDS[c].lower()) for c in self.columns))
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    archives: list


class WarcWriter(DataSourceArrowWriter):
    """Rows need ``payload`` and any header columns; other columns are not written."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite
        self.zipped = options.get("compression", "gzip") == "gzip"
        self.roll = int(options.get("rollbytes", ROLL_BYTES))

    def write(self, iterator):
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        done, out, name, size = [], None, "", 0
        for batch in iterator:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names if c in HEADER_FIELDS or c == "payload"}
            payloads = columns.pop("payload")
            for i, payload in enumerate(payloads):
                data = record_bytes({HEADER_FIELDS[c]: v[i] for c, v in columns.items()}, payload or b"")
                data = gzip_member(data) if self.zipped else data
                if out is None or size + len(data) > self.roll and size:
                    if out is not None:
                        out.close()
                        done.append((name, size))
                    name, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.zipped, 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages):
        store, path = filesystem(self.path)
        store.create_dir(path, recursive=True)
        target = f"{path}/{LIST_NAME}"
        before = []
        if not self.overwrite and store.get_file_info(target).is_file:
            before = json.loads(store.open_input_stream(target).read())
        with store.open_output_stream(target) as out:
            out.write(json.dumps(before + sorted(a for m in messages if m for a in m.archives)).encode())

    def abort(self, messages):
        store, path = filesystem(self.path)
        for m in messages:
            for name, _ in m.archives if m else ():
                store.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict[str, list[str] | None] | None = None) -> DataFrame:
    """Records of the archives in ``path``.

    ``where``: header column -> allowed values, or None for "is present"; tasks test it
    before they touch a block. Naming ``columns`` without ``payload`` makes them skip every
    block.
    """
    register(spark)
    reader = spark.read.format("warc").option("where", json.dumps(where or {}))
    if columns is not None:
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(shared_uri(spark, path))


def capture_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", small: int = SMALL_PAYLOAD) -> DataFrame:
    """Header columns and payload of a record for each page.

    Of pages with equal payloads of at least ``small`` bytes that with the largest id is a
    response and the others are revisits that refer to it; smaller payloads are responses.
    SHA-256 and length stand for payloads.

    Pages whose digest occurs once, told by a bitmap of the digests that repeat, are written
    where they were read. Of the others only ids and digests meet in a join, salted by id;
    bodies are dealt by (digest, id), so a digest with a third of the pages is spread.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("body"))
    rows = rows.select("*", F.sha1("body").alias("sha1"), F.unhex(F.sha2("body", 256)).alias("sha256"), F.octet_length("body").cast("long").alias("n"))
    large = F.col("n") >= small
    counted = rows.filter(large).groupBy("sha256", "n").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("k"))
    copies = materialize(counted.filter("k > 1 and keep is not null").select("sha256", "n", "keep"), "warc-copies")
    repeats = id_filter(copies, "sha256")
    repeated = rows.filter(large & repeats(F.col("sha256")))

    heads = repeated.drop("body").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    salted = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    revisits = heads.join(salted, ["sha256", "n", "salt"]).filter(~F.col("id").eqNullSafe(F.col("keep"))).drop("salt")
    revisits = materialize(revisits, "warc-revisits")
    gone = revisits.select(F.col("id").alias("_id"), F.col("sha256").alias("_sha")).distinct()
    staying = repeated.join(gone, repeated["id"].eqNullSafe(gone["_id"]) & (repeated["sha256"] == gone["_sha"]), "left_anti")
    responses = rows.filter(~large | ~repeats(F.col("sha256"))).unionByName(staying).withColumn("keep", F.lit(None).cast(pages.schema[id_col].dataType))

    revisit = F.col("record_type") == "revisit"
    both = responses.withColumn("record_type", F.lit("response")).unionByName(revisits.withColumns({"body": F.lit(b""), "record_type": F.lit("revisit")}))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return both.select(
        "record_type", urn(F.col("id")).alias("record_id"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), "sha1").alias("payload_digest"), F.when(revisit, urn(F.col("keep"))).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.col("n").cast("string").alias("payload_length"), F.col("body").alias("payload"),
    )


def write_warc(records: DataFrame, path: str, **options: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").options(**options).mode("append").save(shared_uri(records.sparkSession, path))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive all pages and read them back: id, payload_bytes, payload_digest, record_type,
    refers_to. Length and digest of a response are taken from the payload read; those of a
    revisit from its header, its block is never read."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(capture_records(pages, id_col, url_col, html_col), path)
    heads = ["record_type", "record_id", "payload_digest", "refers_to", "payload_length"]
    full = read_warc(spark, path, [*heads, "payload"], {"record_type": ["response"]})
    full = full.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("sha1")).drop("payload")
    short = read_warc(spark, path, heads, {"record_type": ["revisit"]})
    short = short.select("*", F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("sha1"))
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as {pages.schema[id_col].dataType.simpleString()})")
    return full.unionByName(short).select(
        page("record_id").alias(id_col), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to")
    )
