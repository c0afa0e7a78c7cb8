"""Helpers shared by the corpus operators: scratch tables in the shared
checkpoint folder, running sums over any order, and id filters that spare the
texts a shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatekit.session import scratch_dir, ship_package
from slatekit.sources.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Hash buckets of `in_buckets`; a broadcast bucket set never exceeds this.
ID_BUCKETS = 1 << 20
# Bytes of an Arrow batch of texts, about: JVM and worker hold several of each task.
BATCH_BYTES = 4 << 20

__all__ = ["BATCH_BYTES", "ID_BUCKETS", "Scratch", "arrow_batches", "ascii_lower", "bucket", "drop_ids", "free_name", "in_buckets", "keep_ids", "maybe_ids", "null_safe",
           "row_key", "running", "ship_package", "shuffle_partitions", "shuffled_joins", "table", "unique_rows", "word_count"]


class Scratch:
    """Tables of one run, written once under ``spark.checkpoint.dir`` and read
    back, so that a lost executor costs a re-read and not the lineage.  A table
    that later steps no longer read is removed with ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs started inside send Arrow batches of at most ``size`` bytes, about, or
    of one row, to Python; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if 0 < now <= size:
        yield
        return
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside broadcast a side of a join only where a hint asks for it:
    short steps over small tables in a loop would each build their relations on the
    driver."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, was in before.items():
            if was is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, was)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: str | Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: str | Column) -> Column:
    """Number of runs outside space, tab, LF, VT, FF and CR; null text: 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def null_safe(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on a nullable key (null meets null), keeping the left key column."""
    r = right.withColumnRenamed(key, "_rk")
    return left.join(r, left[key].eqNullSafe(F.col("_rk")), how).drop("_rk")


def running(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
            sums: dict[str, Column], scratch: Scratch, name: str) -> DataFrame:
    """Inclusive running sums in ``order`` within ``group`` (whole table when
    empty).  Rows are range-partitioned on (group, order), so a group or a
    table of any size is spread over all tasks; the piece of each row is
    written once with it, and the sums of earlier pieces (one row per piece
    and group) are added to the sums inside the piece."""
    keys = [*[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    vals = {n: f"_v_{n}" for n in sums}
    ranged = (df.withColumns({vals[n]: e.cast("long") for n, e in sums.items()})
              .repartitionByRange(shuffle_partitions(df.sparkSession), *keys)
              .withColumn("_piece", F.spark_partition_id()))
    t = scratch.write(ranged, name)
    inside = (Window.partitionBy("_piece", *group).orderBy(*keys[len(group):])
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = t.withColumns({n: F.sum(v).over(inside) for n, v in vals.items()}).drop(*vals.values())
    pieces = t.groupBy("_piece", *group).agg(*[F.sum(v).alias(v) for v in vals.values()])
    before = (Window.partitionBy(*group).orderBy("_piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = pieces.select(F.col("_piece").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group],
                         *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o_{n}")
                           for n, v in vals.items()])
    cond = F.col("_piece") == F.col("_p")
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = local.join(offs, cond, "left")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_o_{n}")).alias(n) for n in sums])


def bucket(id_col: str) -> Column:
    """Hash bucket of an id; null ids have bucket -1, which is never listed."""
    return F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(id_col), F.lit(ID_BUCKETS)).cast("int"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def in_buckets(ids: DataFrame, id_col: str, out_col: str = "_b") -> DataFrame:
    """The distinct hash buckets (at most ID_BUCKETS rows) of ``ids``."""
    return ids.where(F.col(id_col).isNotNull()).select(bucket(id_col).alias(out_col)).distinct()


def maybe_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id bucket holds a listed id: every listed row and
    few others, found without a shuffle by a broadcast of at most ID_BUCKETS
    bucket numbers."""
    b = free_name(docs, "_b")
    some = docs.withColumn(b, bucket(id_col))
    return some.join(F.broadcast(in_buckets(ids, id_col, b)), b, "left_semi").drop(b)


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``: only rows that pass the bucket
    test are shuffled to the exact join."""
    return maybe_ids(docs, ids, id_col).join(ids.select(id_col).distinct(), id_col, "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``ids`` (null ids stay).  Rows in
    buckets without a listed id pass without a shuffle; only the others meet
    the exact anti join."""
    b = free_name(docs, "_b")
    buckets = F.broadcast(in_buckets(ids, id_col, b))
    tagged = docs.withColumn(b, bucket(id_col))
    clear = tagged.join(buckets, b, "left_anti").drop(b)
    doubt = tagged.join(buckets, b, "left_semi").drop(b)
    listed = ids.select(id_col).distinct()
    return clear.unionByName(doubt.join(listed, id_col, "left_anti"))


def row_key(*cols: str) -> Column:
    """A string that tells rows apart by the given columns (nulls included)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("\u0001", *parts).cast("binary"))


def unique_rows(docs: DataFrame, repeated: DataFrame, key: str) -> DataFrame:
    """One row for each key listed in ``repeated``; all other rows pass without
    a shuffle."""
    at = free_name(docs, "_at")
    first = Window.partitionBy(key).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    one = (keep_ids(docs, repeated, key).withColumn(at, F.row_number().over(first))
           .where(F.col(at) == 1).drop(at))
    return drop_ids(docs, repeated, key).unionByName(one)
