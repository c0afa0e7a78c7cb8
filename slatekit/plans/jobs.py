"""The read -> process -> write job template.  The session is injected
(never created here); read/process/write are plain callables.  Tables staged on
the way are removed when the result has been written."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from slatekit.sources.files import staging


def _identity(df: DataFrame) -> DataFrame:
    return df


@dataclass
class Job:
    read: Callable[[SparkSession], DataFrame]
    write: Callable[[DataFrame], None]
    process: Callable[[DataFrame], DataFrame] = field(default=_identity)

    def run(self, spark: SparkSession) -> None:
        with staging(spark):
            out = self.process(self.read(spark))
            self.write(out)

