"""Profile of a stream: the value counts add up over micro-batches.

Each micro-batch writes its own counts under its batch number, replacing what an
earlier attempt at the same batch left: a batch that runs twice counts once. Every
batch profile operator reads the summed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.freq import value_freq


def append_batch_counts(batch: DataFrame, batch_id: int, path: str, columns: list[str] | None = None) -> None:
    counts = value_freq(batch, columns)
    counts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def stream_value_freq(stream: DataFrame, path: str, columns: list[str] | None = None) -> DataStreamWriter:
    """A writer to `.option("checkpointLocation", ...)` and `.start()`."""
    return stream.writeStream.foreachBatch(
        lambda batch, batch_id: append_batch_counts(batch, batch_id, path, columns)
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(column, value, cnt) over all batches so far."""
    parts = spark.read.schema("column string, value string, cnt bigint").parquet(f"{path.rstrip('/')}/*")
    return parts.groupBy("column", "value").agg(F.sum("cnt").alias("cnt"))


def compact_counts(spark: SparkSession, path: str, target: str) -> None:
    """Write the summed counts as one batch of a new folder, when batches become many."""
    read_counts(spark, path).write.mode("errorifexists").parquet(f"{target.rstrip('/')}/batch_id=-1")
