"""Previews of a cleaning step: a few rows in row order, by bounded top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as rules
from .clean import _text, apply_text_forms, outlier_flag
from .dedup import with_duplicate_flag
from .freq import number
from .rowid import name

# Rows shown per preview.
PREVIEW_DUPLICATES = 10
PREVIEW_CELLS = 8
PREVIEW_OUTLIERS = 20


def preview_duplicates(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    flagged = with_duplicate_flag(df, row_id, columns)
    return (
        flagged.where("is_duplicate")
        .select(name(row_id).alias("row_id"))
        .orderBy("row_id")
        .limit(PREVIEW_DUPLICATES)
    )


def preview_fill(df: DataFrame, column: str, value: str, row_id: str) -> DataFrame:
    text = _text(df, column)
    return (
        df.where(rules.is_missing(text))
        .select(name(row_id).alias("row_id"), F.lit("").alias("before"), F.lit(value).alias("after"))
        .orderBy("row_id")
        .limit(PREVIEW_CELLS)
    )


def preview_normalize(df: DataFrame, column: str, forms: list[str], row_id: str) -> DataFrame:
    text = _text(df, column)
    return (
        df.where(~rules.is_missing(text))
        .select(
            name(row_id).alias("row_id"),
            text.alias("before"),
            apply_text_forms(text, forms).alias("after"),
        )
        .orderBy("row_id")
        .limit(PREVIEW_CELLS)
    )


def preview_outliers(
    df: DataFrame, column: str, row_id: str, method: str = "interpolated"
) -> DataFrame:
    """First outlier rows. The bounds still come from every row."""
    return (
        df.where(outlier_flag(df, column, method))
        .select(name(row_id).alias("row_id"), number(df, column).alias("value"))
        .orderBy("row_id")
        .limit(PREVIEW_OUTLIERS)
    )
