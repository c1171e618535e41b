"""Row identity. Spark tables have no order, so it is carried as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stringify
from ..session import materialize

ROW_ID = "_row_id"
POSITION_BITS = 40


def name(column: str) -> Column:
    """Column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def data_columns(df: DataFrame, columns: list[str] | None = None, row_id: str | None = None) -> list[str]:
    """The columns that are data: the row id is metadata and never profiled."""
    if columns is not None:
        return list(columns)
    return [c for c in df.columns if c not in (ROW_ID, row_id)]


def text_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    return [stringify(name(c), df.schema[c].dataType).alias(c) for c in columns]


def with_row_id(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Add `_row_id`.

    With `order_by` a unique bigint column of the table is used. Otherwise ids follow
    the scan order; they are written out with the rows, because an id that is computed
    again after a lost executor need not be the same.
    """
    if order_by is not None:
        return df.withColumn(ROW_ID, name(order_by).cast("bigint"))
    return materialize(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "row-id")


def file_uri(path: Column) -> Column:
    """One spelling for local files, which Spark names with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_parquet_with_row_id(spark, path: str) -> DataFrame:
    """Parquet rows with an id made of (file number, row number in the file).

    Needs no extra pass: both parts come from the scan's metadata column and are the
    same however often the file is read. The file list is the one the scan already
    holds on the driver.
    """
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    numbers = spark.createDataFrame(list(enumerate(files)), "_file_no bigint, _file string")
    numbers = numbers.select("_file_no", file_uri(F.col("_file")).alias("_file"))
    rows = df.select(
        "*",
        file_uri(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.row_index").alias("_pos"),
    )
    return (
        rows.join(numbers, "_file", "left")
        .withColumn(ROW_ID, F.shiftleft("_file_no", POSITION_BITS) + F.col("_pos"))
        .select(*df.columns, ROW_ID)
    )


def row_digest(columns: list[Column]) -> Column:
    """SHA-256 of a whole row, null counted as empty text.

    The lengths go in front of the texts, so no choice of cell contents makes two
    different rows alike. Grouping on 32 bytes instead of the row keeps the shuffle
    small on wide tables.
    """
    texts = [F.coalesce(c, F.lit("")) for c in columns]
    lengths = [F.length(t).cast("string") for t in texts]
    return F.unhex(F.sha2(F.concat_ws("|", *lengths, *texts), 256))
