"""Before/after report of a cleaning recipe, as one nested row for a JSON sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cleaning_summary(before: DataFrame, after: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per dataset: name, rows and score before and after, applied operations.

    `before` and `after` are profile rows, `steps` the recipe table. The column count
    is the original's, even when the recipe removed a column.
    """
    operations = steps.agg(
        F.sort_array(
            F.collect_list(F.struct("step", "type", "description", "affected_count", "column"))
        ).alias("operations")
    ).scalar()
    b, a = before.alias("b"), after.alias("a")
    return b.join(a, F.col("b.dataset") == F.col("a.dataset")).select(
        F.struct(
            F.col("b.dataset").alias("name"),
            F.col("b.row_count").alias("rows_before"),
            F.col("a.row_count").alias("rows_after"),
            F.col("b.column_count").alias("columns"),
        ).alias("dataset"),
        F.struct(
            F.col("b.quality_score").alias("before"), F.col("a.quality_score").alias("after")
        ).alias("quality"),
        operations.alias("operations"),
    )


def write_summary(summary: DataFrame, path: str, exported_at=None) -> None:
    stamp = F.lit(exported_at) if exported_at else F.current_timestamp()
    summary.withColumn("exported_at", stamp).write.json(path)
