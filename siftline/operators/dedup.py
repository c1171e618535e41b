"""Duplicate rows: counting, flagging, removing.

A row is a duplicate when all its cells, as text with null as "", equal those of
another row. Only digests of rows that occur more than once are kept for the join; on
clean data that table is tiny and the rows themselves are never shuffled. When it is
not, AQE splits a digest that holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rowid import data_columns, name, row_digest, text_columns
from .stats import any_missing

DIGEST = "_row_digest"


def _digest(df: DataFrame, columns: list[str]) -> Column:
    return row_digest(text_columns(df, columns))


def row_totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: row_count, duplicate_row_count, incomplete_row_count, in one pass.

    Copies of a row have the same missing cells, so completeness is part of the key.
    """
    cols = data_columns(df, columns)
    keyed = df.select(
        _digest(df, cols).alias("d"), any_missing(text_columns(df, cols)).alias("incomplete")
    )
    per_row = keyed.groupBy("d", "incomplete").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("bigint")
    return per_row.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_row_count"),
        F.coalesce(F.sum(F.when(F.col("incomplete"), F.col("n"))), zero).alias(
            "incomplete_row_count"
        ),
    )


def duplicate_row_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return row_totals(df, columns).select("duplicate_row_count")


def repeated_rows(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """(digest, first_row, last_row, copies) of rows that occur more than once."""
    cols = data_columns(df, columns, row_id)
    return (
        df.select(_digest(df, cols).alias(DIGEST), name(row_id).alias("r"))
        .groupBy(DIGEST)
        .agg(F.min("r").alias("first_row"), F.max("r").alias("last_row"), F.count("*").alias("copies"))
        .where("copies > 1")
    )


def with_duplicate_flag(
    df: DataFrame, row_id: str, columns: list[str] | None = None, keep: str = "first", flag: str = "is_duplicate"
) -> DataFrame:
    """Flag every copy but the first (or last) one."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    cols = data_columns(df, columns, row_id)
    return _flagged(df, repeated_rows(df, row_id, cols), row_id, cols, keep, flag)


def _flagged(df: DataFrame, repeated: DataFrame, row_id: str, cols: list[str], keep: str, flag: str) -> DataFrame:
    kept = repeated.select(DIGEST, F.col(f"{keep}_row").alias("_kept_row"))
    return (
        df.withColumn(DIGEST, _digest(df, cols))
        .join(kept, DIGEST, "left")
        .withColumn(flag, F.coalesce(name(row_id) != F.col("_kept_row"), F.lit(False)))
        .drop(DIGEST, "_kept_row")
    )


def remove_duplicates(
    df: DataFrame, row_id: str, columns: list[str] | None = None, keep: str = "first"
) -> DataFrame:
    flagged = with_duplicate_flag(df, row_id, columns, keep, "_duplicate")
    return flagged.where(~F.col("_duplicate")).drop("_duplicate")


def remove_repeated(df: DataFrame, repeated: DataFrame, row_id: str, keep: str = "first") -> DataFrame:
    """`remove_duplicates` with `repeated_rows` of the same table given, so that a count of them costs no other pass."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first' or 'last', not {keep!r}")
    flagged = _flagged(df, repeated, row_id, data_columns(df, None, row_id), keep, "_duplicate")
    return flagged.where(~F.col("_duplicate")).drop("_duplicate")
