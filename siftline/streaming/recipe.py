"""The part of a recipe that runs on a stream, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.rowid import ROW_ID, data_columns, row_digest, text_columns
from ..plans.recipe import Step, apply_recipe

ROW_WISE = ("normalize_text", "convert_type", "remove_column")


def check_streaming_safe(steps: list[Step]) -> None:
    """Raise for a step that needs to see the whole table first."""
    for step in steps:
        literal_fill = step.type == "fill_missing" and step.config.get("strategy") not in ("mean", "median")
        by_id = step.type == "remove_outlier_rows" and "row_ids" in step.config
        if not (step.type in ROW_WISE or literal_fill or by_id):
            raise ValueError(f"step {step.type!r} needs the whole table; it cannot run on a stream")


def stream_recipe(stream: DataFrame, steps: list[Step], row_id: str = ROW_ID) -> DataFrame:
    check_streaming_safe(steps)
    return apply_recipe(stream, steps, row_id)


def dedup_within(
    stream: DataFrame, event_time: str, delay: str, columns: list[str] | None = None, row_id: str = ROW_ID
) -> DataFrame:
    """Keep the first of equal rows that arrive within `delay` of each other.

    Rows are equal as in the batch step: the texts of all data columns, event time included, null
    counting as "". The watermark bounds the state; keep-last cannot be known on a stream.
    """
    keys = data_columns(stream, columns, row_id)
    digest = row_digest(text_columns(stream, keys))
    marked = stream.withColumn("_row_digest", digest).withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark(["_row_digest"]).drop("_row_digest")
