"""Paced replay of recorded requests as a stream, a Python data source.

``write_replay`` numbers the records (0, 1, ...) and writes them in that order
with a list of its files; ``RequestReplay`` streams them.  The offset is the
number of records released so far.  Two things hold it back:

* pace: a record is released when its time has come, ``rowsPerSecond`` after the
  first start, which is written down once, so a restarted stream keeps the pace;
* admission: a micro-batch takes at most ``maxRowsPerBatch`` records beyond the
  last one that Spark has committed, so a late stream catches up in steps.

Where to go on is Spark's business (the offsets of its checkpoint); the marks of
commits only serve admission, and one that was lost in a crash cannot move an
offset back, as both bounds only grow.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from slatekit.plans.indexing import dense_index
from slatekit.session import ship_package
from slatekit.sources import shared

REPLAY_SCHEMA = ("key binary, value binary, topic string, partition int, offset bigint, "
                 "timestamp timestamp")
COLUMNS = ("key", "value", "topic", "partition", "offset", "timestamp")


def write_replay(records: DataFrame, path: str, order: tuple[str, ...] = ("partition", "offset")) -> None:
    """Records (Kafka columns) in replay order, and the range of each file."""
    spark = records.sparkSession
    n = dense_index(records.select(*COLUMNS), list(order), (), "n")
    n.repartitionByRange("n").sortWithinPartitions("n").write.parquet(f"{path}/records")
    (spark.read.parquet(f"{path}/records").groupBy(F.col("_metadata.file_name").alias("file"))
     .agg(F.min("n").alias("first"), F.max("n").alias("last")).coalesce(1).write.parquet(f"{path}/files"))


@dataclass
class Slice(InputPartition):
    """Records ``first`` to ``stop`` (exclusive), all in ``file``."""

    file: str
    first: int
    stop: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.progress = options["path"], options["progress"]
        self.rate = float(options.get("rowsPerSecond", options.get("rowspersecond", "1")))
        self.most = int(options.get("maxRowsPerBatch", options.get("maxrowsperbatch", str(1 << 20))))
        self.planned = 0
        self._files: list[dict] | None = None

    def files(self) -> list[dict]:
        if self._files is None:
            fs, base = shared.file_system(f"{self.path}/files")
            rows = pq.read_table(base, filesystem=fs).to_pylist()
            self._files = sorted(rows, key=lambda r: r["first"])
        return self._files

    def _marks(self, kind: str) -> list[int]:
        fs, base = shared.file_system(f"{self.progress}/{kind}")
        from pyarrow.fs import FileSelector
        return [int(f.base_name) for f in fs.get_file_info(FileSelector(base, allow_not_found=True))]

    def _mark(self, kind: str, value: int) -> None:
        fs, base = shared.file_system(f"{self.progress}/{kind}")
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{value:020d}", compression=None):
            pass

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        if not self._marks("start"):
            self._mark("start", int(time.time() * 1000))
        began = min(self._marks("start")) / 1000
        total = self.files()[-1]["last"] + 1 if self.files() else 0
        due = int((time.time() - began) * self.rate)
        done = max(self._marks("commit"), default=0)
        # never behind what has been planned: clocks may be set back
        self.planned = max(self.planned, min(total, due, done + self.most))
        return {"n": self.planned}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.planned = max(self.planned, end["n"])
        return [Slice(f["file"], max(f["first"], start["n"]), min(f["last"] + 1, end["n"]))
                for f in self.files() if f["first"] < end["n"] and f["last"] >= start["n"]]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, base = shared.file_system(f"{self.path}/records/{partition.file}")
        f = pq.ParquetFile(base, filesystem=fs, coerce_int96_timestamp_unit="us")
        for batch in f.iter_batches(columns=["n", *COLUMNS]):
            n = batch.column("n")
            inside = pc.and_(pc.greater_equal(n, partition.first), pc.less(n, partition.stop))
            batch = batch.filter(inside)
            stamp = batch.column("timestamp").cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in COLUMNS[:-1]], stamp], names=list(COLUMNS))

    def commit(self, end: dict) -> None:
        self._mark("commit", end["n"])


class RequestReplay(DataSource):
    """``readStream.format("request_replay")`` with the options ``path`` (of
    ``write_replay``), ``progress`` (a folder of the replay's own, shared like the
    checkpoint), ``rowsPerSecond`` and ``maxRowsPerBatch``."""

    @classmethod
    def name(cls) -> str:
        return "request_replay"

    def schema(self) -> str:
        return REPLAY_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def read_replay(spark: SparkSession, path: str, progress: str, rows_per_second: float,
                max_rows_per_batch: int) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(RequestReplay)
    return (spark.readStream.format("request_replay").option("path", path).option("progress", progress)
            .option("rowsPerSecond", str(rows_per_second)).option("maxRowsPerBatch", str(max_rows_per_batch)).load())


def run_until(source: DataFrame, path: str, checkpoint: str, rows: int, pause: str = "200 milliseconds",
              seconds: float = 300.0) -> None:
    """Write the stream to ``path``, starting from the checkpoint, until at least
    ``rows`` records are there; an error after so many ``seconds``."""
    late = time.time() + seconds
    q = (source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(processingTime=pause).start())
    spark = source.sparkSession
    try:
        while q.isActive and (not shared.exists(spark, f"{path}/_spark_metadata")
                              or spark.read.schema(source.schema).parquet(path).count() < rows):
            if time.time() > late:
                raise TimeoutError(f"fewer than {rows} records after {seconds} s")
            time.sleep(0.2)
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
