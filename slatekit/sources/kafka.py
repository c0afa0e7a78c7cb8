"""Kafka-shaped request streams.

The Kafka connector jar is optional; everything that touches Kafka options
lives here, and the same operators run on a file stream of rows with the
Kafka columns ``key value topic partition offset timestamp``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatekit.functions.exprs import hash60
from slatekit.plans.indexing import dense_index, split_rows
from slatekit.sources.files import stage

# FIXED VALUES: topic name and record columns of the request stream.
TOPIC = "user-tracking"
KAFKA_SCHEMA = ("key binary, value binary, topic string, partition int, offset bigint, "
                "timestamp timestamp")
# Most records of a partition that one task sorts: they hold whole payloads (some
# kilobytes each), so the limit is far below that of narrow rows.
SORTED_RECORDS = 1 << 15
BOUND_CHARS = 64         # start of a payload in the bounds of a range


def kafka_options(bootstrap: str, starting_offsets: str = "latest", **extra) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "startingOffsets": starting_offsets, **extra}


def read_kafka_stream(spark: SparkSession, topics: str, options: dict[str, str]) -> DataFrame:
    """Subscribe to ``topics`` (needs the spark-sql-kafka package)."""
    return spark.readStream.format("kafka").option("subscribe", topics).options(**options).load()


def read_request_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None
                       ) -> DataFrame:
    """File stream with the Kafka columns (tests, replays; T7 pacing via
    ``maxFilesPerTrigger``)."""
    r = spark.readStream.schema(KAFKA_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def to_kafka_records(df: DataFrame, key_col: str, value_col: str, topic: str = TOPIC,
                     n_partitions: int = 1, ts_col: str | None = None) -> DataFrame:
    """Records with binary key/value, the partition from the key's hash
    and a dense per-partition offset in order of key, then value (skew-safe
    scan).  Topics have few partitions, so a larger one is cut into ranges of a
    quarter of ``SORTED_RECORDS``; payloads are made once and written before that."""
    part = (hash60(key_col) % n_partitions).cast("int")
    x = df.select(F.col(key_col).alias("_k"), F.col(value_col).alias("_v"), part.alias("partition"),
                  (F.col(ts_col) if ts_col else F.current_timestamp()).alias("timestamp"))
    x = stage(x, "payloads")
    x = dense_index(x, ["_k", "_v"], ["partition"], "offset", min(SORTED_RECORDS, split_rows(df)),
                    ["_k", F.substring("_v", 1, BOUND_CHARS)])
    return x.select(F.col("_k").cast("string").cast("binary").alias("key"),
                    F.col("_v").cast("binary").alias("value"), F.lit(topic).alias("topic"),
                    "partition", "offset", F.col("timestamp").cast("timestamp").alias("timestamp"))


def write_kafka(df: DataFrame, options: dict[str, str], topic: str = TOPIC) -> None:
    """S8 sink: publish ``key``/``value`` records (needs the Kafka package)."""
    df.select("key", "value").write.format("kafka").options(**options).option("topic", topic).save()
