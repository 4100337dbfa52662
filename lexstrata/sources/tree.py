"""A versioned tree of files as a log of commits in a shared folder.

A commit is a Parquet folder of changed paths and a manifest that names it. Manifests are numbered
without gaps, and a writer creates that after its parent with a create-if-absent of the file system:
of two writers on one parent one is refused (``Conflict``) and its folder stays unnamed. The state at
a commit is the last entry of each path up to it; a snapshot, written with ``compact``, bounds how
far back a reader goes. Nothing is ever changed in place, so every commit stays readable.

Defined cases: paths lose leading slashes; one with ``..``, a blank or a null one is refused; of rows
that repeat a path in one commit the largest content counts; a null content deletes, and deleting
what is not there changes nothing; a commit without changes is none; an unknown ref has no files.

Creation without overwriting must be atomic, as it is on HDFS and local disks; a bare object store
needs a committer for that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import shared_folder, shared_uri

ENTRY = "path string, content string, content_hash string, deleted boolean, commit long"


class Conflict(Exception):
    """Another commit has the same parent."""


def safe_path(path: str) -> str:
    """A path inside the tree, without leading slashes; ValueError for one that leaves it."""
    path = path.lstrip("/")
    if ".." in path or not path.strip():
        raise ValueError(f"not a path inside the tree: {path!r}")
    return path


def _safe(path: Column) -> Column:
    bare = F.ltrim(path, F.lit("/"))
    return F.when(F.contains(bare, F.lit("..")) | bare.isNull() | (F.trim(bare) == ""), F.raise_error(F.concat(F.lit("not a path inside the tree: "), F.coalesce(path, F.lit("null"))))).otherwise(bare)


class Tree:
    """``Tree(spark, folder)``; a new folder is an empty tree at commit 0."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.root = shared_uri(spark, folder or shared_folder(spark, "tree")).rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._store = self._path("log").getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def head(self) -> int:
        """The number of the last commit."""
        return max((n for n, _ in self._listed("log")), default=0)

    def _listed(self, kind: str) -> list[tuple[int, str]]:
        folder = self._path(kind)
        if not self._store.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._store.listStatus(folder)]
        return sorted((int(n.removesuffix(".json")), n) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def _create(self, name: str, record: dict) -> None:
        out = self._store.create(self._path(name), False)  # fails if it is there
        out.write(bytearray(json.dumps(record).encode()))
        out.close()

    def _manifests(self, kind: str, ref: int) -> list[dict]:
        wanted = [f"{self.root}/{kind}/{name}" for n, name in self._listed(kind) if n <= ref]
        if not wanted:
            return []
        rows = self.spark.read.schema("number long, parent long, message string, folder string, base long").json(wanted)
        return [r.asDict() for r in rows.orderBy("number").collect()]  # a row a commit since the log began

    def log(self, limit: int = 50, ref: int | None = None) -> DataFrame:
        """number, parent, message of the newest commits up to ``ref``."""
        rows = [(m["number"], m["parent"], m["message"]) for m in self._manifests("log", self.head() if ref is None else ref)][::-1][: max(0, limit)]
        return self.spark.createDataFrame(rows, "number long, parent long, message string")

    # reading

    def entries(self, ref: int | None = None, since: int = 0) -> DataFrame:
        """All entries of the commits behind ``since`` up to ``ref``."""
        ref = self.head() if ref is None else ref
        folders = [f"{self.root}/{m['folder']}" for m in self._manifests("log", ref) if m["number"] > since]
        if not folders:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*folders)

    def at(self, ref: int | None = None, content: bool = True) -> DataFrame:
        """path, content, content_hash, commit (that wrote it) of each file at ``ref``. Without
        ``content`` only paths and hashes move."""
        ref = self.head() if ref is None else ref
        base = max(self._manifests("snapshots", ref), key=lambda m: m["number"], default=None)
        rows = self.entries(ref, base["number"] if base else 0)
        if base:
            rows = rows.unionByName(self.spark.read.schema(ENTRY).parquet(f"{self.root}/{base['folder']}"))
        fields = [*["content"] * content, "content_hash", "commit"]
        last = rows.groupBy("path").agg(F.max_by(F.struct(*fields, "deleted"), "commit").alias("e"))
        return last.filter("not e.deleted").select("path", *[f"e.{c}" for c in fields])

    def read(self, path: str, ref: int | None = None) -> str | None:
        """One file's content; None where it is not there."""
        row = self.at(ref).filter(F.col("path") == safe_path(path)).select("content").first()
        return row.content if row else None

    def exists(self, path: str, ref: int | None = None) -> bool:
        return not self.at(ref, content=False).filter(F.col("path") == safe_path(path)).isEmpty()

    def directory_exists(self, path: str, ref: int | None = None) -> bool:
        return not self.at(ref, content=False).filter(F.startswith("path", F.lit(safe_path(path).rstrip("/") + "/"))).isEmpty()

    def found(self, paths: DataFrame, path: str = "path", ref: int | None = None) -> DataFrame:
        """``paths`` with the content and content_hash at ``ref``, null where there is none."""
        files = self.at(ref).select(F.col("path").alias("_path"), "content", "content_hash")
        return paths.join(files, _safe(paths[path]) == files["_path"], "left").drop("_path")

    def list_files(self, prefix: str = "", ref: int | None = None) -> DataFrame:
        """Sorted paths below a directory; all of them for an empty one."""
        files = self.at(ref, content=False).select("path")
        if prefix.strip("/"):
            files = files.filter(F.startswith("path", F.lit(safe_path(prefix).rstrip("/") + "/")))
        return files.orderBy("path")

    # writing

    def commit(self, changes: DataFrame, message: str, parent: int | None = None) -> int | None:
        """Put (path, content) rows, delete where the content is null. The new number, or None
        where nothing differs from ``parent`` (default: the head)."""
        parent = self.head() if parent is None else parent
        if parent != self.head():
            raise Conflict(f"{parent} is not the last commit")
        wanted = changes.select(_safe(F.col("path")).alias("path"), F.col("content").cast("string").alias("content")).groupBy("path").agg(F.max("content").alias("content"))
        wanted = wanted.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
        held = self.at(parent, content=False).select("path", F.col("content_hash").alias("_held"))
        fresh = wanted.join(held, "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_held"))).drop("_held")
        folder = f"entries/{shared_folder(self.spark, 'commit').rsplit('/', 1)[-1]}"
        fresh.select("path", "content", "content_hash", F.col("content").isNull().alias("deleted"), F.lit(parent + 1).cast("long").alias("commit")).write.parquet(f"{self.root}/{folder}")
        if self.spark.read.schema(ENTRY).parquet(f"{self.root}/{folder}").isEmpty():
            return None
        try:
            self._create(f"log/{parent + 1:012d}.json", {"number": parent + 1, "parent": parent, "message": message, "folder": folder})
        except Exception as problem:
            if self._store.exists(self._path(f"log/{parent + 1:012d}.json")):
                raise Conflict(f"{parent} has a commit after it already") from problem
            raise
        return parent + 1

    def move_directory(self, source: str, target: str, message: str, parent: int | None = None) -> int | None:
        """All files below ``source`` go below ``target``, over what is there."""
        source, target = safe_path(source).rstrip("/"), safe_path(target).rstrip("/")
        parent = self.head() if parent is None else parent
        moved = self.at(parent).filter(F.startswith("path", F.lit(source + "/")))
        gone = moved.select("path", F.lit(None).cast("string").alias("content"))
        put = moved.select(F.concat(F.lit(target), F.substr("path", F.lit(len(source) + 1))).alias("path"), "content")
        return self.commit(gone.unionByName(put), message, parent)

    def compact(self, ref: int | None = None) -> None:
        """Write the state at ``ref`` as one folder; readers from there on begin with it."""
        ref = self.head() if ref is None else ref
        folder = f"entries/{shared_folder(self.spark, 'snapshot').rsplit('/', 1)[-1]}"
        self.at(ref).withColumn("deleted", F.lit(False)).select("path", "content", "content_hash", "deleted", "commit").write.parquet(f"{self.root}/{folder}")
        if not self._store.exists(self._path(f"snapshots/{ref:012d}.json")):
            self._create(f"snapshots/{ref:012d}.json", {"number": ref, "folder": folder})
