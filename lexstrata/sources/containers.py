"""Law containers as a Spark source: zip archives or plain XML, read as streams.

``law_container`` reads a folder of files. A file that begins as a zip archive gives its first
member that ends in ``.xml``, inflated as it is read; one that names its root element within the
first 512 bytes is read as it is. Parsing is by events, so a task holds one norm at a time,
however long the file. Each child ``norm`` of the root gives a row: path, slug (the file's name),
document_id (of the root), position (0 is the header), xml.

A file that is neither, an archive without XML, broken XML, or a law without norms gives a row
whose ``error`` says so; norms read before the break stand beside it, and ``operators.laws`` drops
them. Written rows (slug, xml) become one archive each, named by the slug; a task that runs twice
writes the same file again. Rows with a null slug or text are left out.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..shipping import ship_package
from .files import opened, shared_uri

SCHEMA = "path string, slug string, document_id string, position int, xml string, error string"
PARTITION_BYTES = 4 << 20  # of archives, which inflate several times
CHUNK = 1 << 16
# The first bytes of a zip archive, and how a law's root element begins.
ZIP_START = b"PK\x03\x04"
ROOT_START = b"<dokumente"
HEAD_BYTES = 512


class NormStream:
    """Cuts a law's XML into its norms while it is fed. ``ready`` holds finished ones."""

    def __init__(self) -> None:
        self.ready: list[str] = []
        self.document_id: str | None = None
        self.depth, self.parts = 0, None
        self.parser = expat.ParserCreate()
        self.parser.buffer_text, self.parser.ordered_attributes = True, True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._text

    def _start(self, tag: str, attributes: list[str]) -> None:
        self.depth += 1
        pairs = list(zip(attributes[::2], attributes[1::2]))
        if self.depth == 1:
            self.document_id = dict(pairs).get("doknr") or None
        elif self.depth == 2 and tag == "norm":
            self.parts = []
        if self.parts is not None:
            self.parts.append(f"<{tag}{''.join(f' {k}={quoteattr(v)}' for k, v in pairs)}>")

    def _end(self, tag: str) -> None:
        if self.parts is not None:
            self.parts.append(f"</{tag}>")
            if self.depth == 2:
                self.ready.append("".join(self.parts))
                self.parts = None
        self.depth -= 1

    def _text(self, text: str) -> None:
        if self.parts is not None:
            self.parts.append(escape(text, {"\r": "&#13;"}))

    def norms(self, raw) -> Iterator[str]:
        while chunk := raw.read(CHUNK):
            self.parser.Parse(chunk, False)
            yield from self.ready
            self.ready.clear()
        self.parser.Parse(b"", True)
        yield from self.ready


def law_stream(raw):
    """The stream of a container's XML; ValueError where there is none."""
    head = raw.read(HEAD_BYTES)
    raw.seek(0)
    if not head.startswith(ZIP_START):
        if ROOT_START not in head:
            raise ValueError("neither an archive nor a law")
        return raw
    archive = zipfile.ZipFile(raw)
    name = next((n for n in archive.namelist() if n.lower().endswith(".xml")), None)
    if name is None:
        raise ValueError("no XML in the archive")
    return archive.open(name)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class ContainerReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.partition_bytes = options["path"], int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self):
        from pyarrow import fs

        store, path = opened(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        parts, room = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: (-f.size, f.path)):
            if f.size > room or not parts:
                parts.append([])
                room = self.partition_bytes
            parts[-1].append(f.path)
            room -= f.size
        return [Files(tuple(p)) for p in parts] or [Files(())]

    def read(self, partition):
        store, _ = opened(self.path)
        for path in partition.paths:
            slug, stream, position = path.rsplit("/", 1)[-1].rsplit(".", 1)[0], NormStream(), 0
            try:
                with store.open_input_file(path) as raw:
                    for position, xml in enumerate(stream.norms(law_stream(raw)), 1):
                        yield path, slug, stream.document_id, position - 1, xml, None
                if not position:
                    raise ValueError("no norms")
            except (ValueError, expat.ExpatError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as problem:
                yield path, slug, None, None, None, str(problem) or type(problem).__name__


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class ContainerWriter(DataSourceWriter):
    def __init__(self, options, columns: list[str]) -> None:
        self.path, self.columns = options["path"], columns

    def write(self, iterator):
        store, path = opened(self.path)
        store.create_dir(path)
        names = []
        for row in iterator:
            if row["slug"] is None or row["xml"] is None:
                continue
            name = f"{row['slug']}.zip"
            with store.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(zipfile.ZipInfo(f"{row['slug']}.xml"), row["xml"], zipfile.ZIP_DEFLATED)
            names.append(name)
        return Written(tuple(names))

    def commit(self, messages):
        store, path = opened(self.path)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/_written.json") as out:
            out.write(json.dumps({"containers": sum(len(m.names) for m in messages if m)}).encode())


class LawContainers(DataSource):
    @classmethod
    def name(cls):
        return "law_container"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ContainerReader(self.options)

    def writer(self, schema, overwrite):
        return ContainerWriter(self.options, [f.name for f in schema.fields])


def read_containers(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(LawContainers)
    return spark.read.format("law_container").option("partitionbytes", str(partition_bytes)).load(shared_uri(spark, path))


def write_containers(laws: DataFrame, path: str) -> None:
    """One archive for each row (slug, xml) in ``path``."""
    ship_package(laws.sparkSession)
    laws.sparkSession.dataSource.register(LawContainers)
    laws.select("slug", "xml").write.format("law_container").mode("append").save(shared_uri(laws.sparkSession, path))
