"""Files that tasks open themselves: paths as all of them must see them, and a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared_uri(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark would use for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = target.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    scheme, colon, rest = uri.partition(":")
    return ("s3" if scheme in ("s3a", "s3n") else scheme) + colon + rest


def opened(uri: str):
    """(file system, path inside it) of a qualified path, in a task or the driver."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: the one that
    ``spark.checkpoint.dir`` names, or, on a local master only, one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
    return f"{root.rstrip('/')}/lexstrata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
