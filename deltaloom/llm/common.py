"""What the corpus operators share: the shared folder, written cuts, Arrow limits."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from deltaloom.sources.tables import shared_dir

#: Rows and bytes of one Arrow batch that a Python worker holds; texts can be long.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    return cut_at(df, name)[0]


def cut_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As cut(), with the path, for callers that remove the table once it is used up."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches within a Python worker's memory, for texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `limit` bytes of `column` each; one row at least."""
    for batch in batches:
        values = batch.column(column)
        sizes = np.frombuffer(values.buffers()[1], np.int32)[values.offset :] if batch.num_rows else np.zeros(1)
        sizes = sizes[: batch.num_rows + 1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + limit, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def crc_mod(column: str, n: int) -> str:
    """SQL for crc32(column as text) mod n; a null id counts as the text ''."""
    return f"crc32(CAST(coalesce(CAST({column} AS STRING), '') AS BINARY)) % {n}"
