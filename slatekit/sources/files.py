"""File sources and sinks.

Paths for intermediate tables come from the shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temp folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatekit.session import scratch_dir
from slatekit.sources import shared

# FIXED VALUES: positional columns of the impression log CSV.
LOG_COLUMNS = (
    "user_id", "user_os", "user_gender", "user_age_level", "user_purchase_level", "user_hour",
    "cand_item_pos", "cand_item_pagenum", "cand_item_sex", "cand_item_price_level",
    "cand_item_age_level", "cand_item_bc_type",
    "exp_item_pos_seq", "exp_item_pagenum_seq", "exp_item_sex_seq", "exp_item_price_level_seq",
    "exp_item_age_level_seq", "exp_item_bc_type_seq",
    "ipv_item_pos_seq", "ipv_item_pagenum_seq", "ipv_item_sex_seq", "ipv_item_price_level_seq",
    "ipv_item_age_level_seq", "ipv_item_bc_type_seq",
    "label", "score",
)


def log_schema() -> T.StructType:
    """Explicit schema (no inference pass): strings, then label int and
    score double."""
    fields = [T.StructField(c, T.StringType()) for c in LOG_COLUMNS[:-2]]
    return T.StructType(fields + [T.StructField("label", T.IntegerType()),
                                  T.StructField("score", T.DoubleType())])


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared scratch area."""
    return scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def read_impression_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV impression log with the positional schema; the row
    key keeps file order (``row_key``, increasing within a file)."""
    df = spark.read.csv(path, header=True, schema=log_schema(), mode="PERMISSIVE")
    return df.withColumn("row_key", F.monotonically_increasing_id())


def write_impression_csv(log: DataFrame, path: str) -> None:
    """Write a log with the positional columns as headered CSV."""
    log.select(*LOG_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite Parquet sink (optionally partitioned, e.g. by split)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """The one-row stats record as JSON."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def fingerprint(*parts) -> str:
    return hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(df: DataFrame, base: str, *key_parts) -> DataFrame:
    """Write ``df`` once under ``base/<fingerprint of key_parts>`` and
    read it back; a later call with the same key reuses the written table.
    ``reuse`` makes the key from the inputs themselves."""
    return _published(df.sparkSession, f"{base.rstrip('/')}/{fingerprint(*key_parts)}", lambda: df, ())


def _published(spark: SparkSession, path: str, build: Callable[[], DataFrame],
               partition_by: Sequence[str]) -> DataFrame:
    """The table at ``path``, written aside and moved into place if it is not
    there: a reader, or a second writer, never sees part of it."""
    if not shared.exists(spark, path):
        tmp = shared.temporary(path)
        write_parquet(build(), tmp, list(partition_by))
        shared.publish(spark, tmp, path)
    return spark.read.parquet(path)


def input_files(*sources: DataFrame) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the files that ``sources`` read, by
    one listing per folder."""
    out = []
    for df in sources:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        folders: dict[str, dict] = {}
        for uri in df.inputFiles():
            p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
            parent = p.getParent()
            if str(parent) not in folders:
                folders[str(parent)] = {s.getPath().getName(): s for s in parent.getFileSystem(conf).listStatus(parent)}
            s = folders[str(parent)][p.getName()]
            out.append((uri, s.getLen(), s.getModificationTime()))
    return sorted({*out})


@lru_cache(maxsize=1)
def code_fingerprint() -> str:
    """Of the library's sources: a table that an older version built is not reused."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sha = hashlib.sha1()
    for folder, _, files in sorted(os.walk(root)):
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                sha.update(name.encode() + f.read())
    return sha.hexdigest()[:16]


def reuse(name: str, sources: Sequence[DataFrame], build: Callable[[], DataFrame], *params,
          base: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table ``build()`` makes of ``sources``, built once.

    Its version is a fingerprint of the parameters, the plans of the sources, the
    library's code, and the names, sizes and modification times of the files they
    read: where any of them changes, the table is built anew, and the versions of
    the same files and parameters that it replaces are removed.  ``base`` is a
    folder shared by the cluster, the scratch area unless given."""
    spark = sources[0].sparkSession
    files = input_files(*sources)
    plans = [df.semanticHash() for df in sources]
    folder = (f"{(base or scratch_dir(spark, 'prepared')).rstrip('/')}/"
              f"{name}/{fingerprint([f for f, _, _ in files], params)}")
    version = fingerprint(files, plans, params, code_fingerprint())
    out = _published(spark, f"{folder}/{version}", build, partition_by)
    for old in shared.names(spark, folder):
        if old != version and not old.startswith("."):
            shared.delete(spark, f"{folder}/{old}")
    return out


_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table in a fresh folder of the shared
    scratch area and read it back: later jobs (including driver-side size
    checks) read the table instead of recomputing its lineage, and a lost
    executor cannot force the upstream plan to rerun.  ``drop_stages`` and
    ``staging`` remove such tables when their results have been written."""
    spark = df.sparkSession
    path = run_path(spark, name)
    write_parquet(df, path, partition_by)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables staged by this application, from the ``since``-th on."""
    paths = _STAGED.get(spark.sparkContext.applicationId, [])
    while len(paths) > since:
        shared.delete(spark, paths.pop())


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end (of a job that has written
    its results)."""
    since = len(_STAGED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_stages(spark, since)
