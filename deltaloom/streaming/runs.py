"""What the batches of a stream leave behind: tables that grow by a folder a batch, and the seconds that batches took."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from deltaloom.sources.tables import remove, rewritten

#: Batches whose folders become one.
FOLD = 16


@dataclass(frozen=True)
class History:
    """A table that batches add to, never read by a later batch. Every `fold` batches their folders become one.

    A fold reads the folders of its own batches only, so all folds together copy each row once. They
    go one fold later: a batch that runs again after its fold finds what it folds.
    """

    path: str
    schema: str
    fold: int = FOLD
    #: The rows, as an SQL condition, that a fold keeps.
    keep: str = "true"

    def at(self, batch: int) -> str:
        return f"{self.path}/v={batch}"

    def write(self, df: DataFrame, batch: int) -> DataFrame:
        """df as what the batch adds, in place of what an earlier run of it did, read back."""
        return rewritten(df, self.at(batch))

    def _rows(self, spark: SparkSession, batches: list[int]) -> DataFrame:
        return spark.read.option("basePath", self.path).schema(f"{self.schema}, v int").parquet(*map(self.at, batches))

    def folded(self, spark: SparkSession, batch: int) -> None:
        """To be called after each batch; folds if the batch is the last of its `fold` ones."""
        upto = batch + 1
        if upto % self.fold == 0:
            self._rows(spark, list(range(upto - self.fold, upto))).where(self.keep).write.mode("overwrite").parquet(f"{self.path}/part={upto}")
            for old in range(max(0, upto - 2 * self.fold), upto - self.fold):
                remove(spark, self.at(old))

    def _folders(self, spark: SparkSession) -> tuple[list[int], list[int]]:
        """Batches with a folder of their own, and the ends of the folds that are complete."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        parts = [int(n[5:]) for n in names if n.startswith("part=") and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=")), sorted(parts)

    def batches(self, spark: SparkSession) -> int:
        """The number of batches so far."""
        own, parts = self._folders(spark)
        return max([0, *(b + 1 for b in own), *parts])

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows so far, with their batch."""
        own, parts = self._folders(spark)
        rest = [b for b in own if not any(p - self.fold <= b < p for p in parts)]
        rows = spark.createDataFrame([], f"{self.schema}, v int")
        if rest:
            rows = self._rows(spark, rest)
        if parts:
            packed = spark.read.schema(f"{self.schema}, v int").parquet(*(f"{self.path}/part={p}" for p in parts))
            rows = rows.unionByName(packed) if rest else packed
        return rows.withColumnRenamed("v", "batch")


def latencies(root: str, fold: int = FOLD) -> History:
    """(results, seconds) of each batch: the changes of results that it wrote, and the time from its start until they could be read."""
    return History(f"{root}/latency", "results bigint, seconds double", fold)


def timed(take: Callable[[DataFrame, int], None], results: Callable[[SparkSession, int], int], history: History) -> Callable[[DataFrame, int], None]:
    """What a stream calls with each batch: take, and a row of `history` on it."""

    def run(rows: DataFrame, batch: int) -> None:
        spark, began = rows.sparkSession, time.monotonic()
        take(rows, batch)
        seconds = time.monotonic() - began
        history.write(spark.range(1).select(F.lit(results(spark, batch)).cast("bigint").alias("results"), F.lit(seconds).alias("seconds")), batch)
        history.folded(spark, batch)

    return run


def stopped_after(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream run for so many seconds at most; whether it ended by itself. A later start goes on: a batch that was cut short runs again, and replaces what it had written."""
    if query.awaitTermination(seconds):
        return True
    query.stop()
    return False
