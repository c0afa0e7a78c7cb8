"""Small files in the shared storage: the driver's side through Spark's file
systems, the executors' through pyarrow's."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, sorted; none where there is no folder."""
    p, fs = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _open(spark, path)
    fs.delete(p, True)


def publish(spark: SparkSession, written: str, path: str) -> bool:
    """Move a finished folder to its name.  False (and the folder removed) where
    the name is taken: another writer was first."""
    src, fs = _open(spark, written)
    dst, _ = _open(spark, path)
    fs.mkdirs(dst.getParent())
    if not fs.exists(dst) and fs.rename(src, dst):
        return True
    fs.delete(src, True)
    return False


def temporary(path: str) -> str:
    """A hidden sibling of ``path`` to write it under before it is published."""
    base, _, name = path.rstrip("/").rpartition("/")
    return f"{base}/.{name}-{uuid.uuid4().hex[:12]}"


def mark(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False where it exists."""
    p, fs = _open(spark, path)
    fs.mkdirs(p.getParent())
    return fs.createNewFile(p)


def file_system(uri: str):
    """pyarrow file system and path of a file or folder that Spark names by URI
    (for code in tasks)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))
