"""The full profile of a table: statistics, issues and quality score in one row.

The cell table of distinct values is the only large intermediate; it is written once
to the shared folder and then read by each statistic. The per-column counters (one row
per column) are written too, since inferred types steer everything after them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, stats
from ..operators.freq import long_texts, value_keys
from ..operators.rowid import data_columns
from ..session import materialize
from . import issues as issue_rules

NUMERIC_FIELDS = [
    "num_count", "sum", "mean", "median", "min", "max", "range", "q1", "q3", "iqr",
    "variance", "std_dev", "p10", "p90", "p95", "p99",
]


class Profiler:
    """Statistics of one table that share the same two written intermediates."""

    def __init__(self, df: DataFrame, name: str = "dataset", columns=None, row_id: str | None = None):
        self.df = df
        self.name = name
        self.columns = data_columns(df, columns, row_id)

    @cached_property
    def values(self) -> DataFrame:
        """Distinct values with what each one is: every pattern runs here, once per value, long texts by digest."""
        return materialize(value_keys(self.df, self.columns), "values")

    def texts(self, keys: DataFrame, trimmed: bool = False) -> DataFrame:
        """The whole texts of long values (`freq.long_texts`)."""
        return long_texts(self.df, keys, trimmed)

    @cached_property
    def counters(self) -> DataFrame:
        return materialize(stats.column_counters(self.values), "counters")

    def infer_types(self) -> DataFrame:
        return self.counters.select("column", "inferred_type")

    def numeric_stats(self) -> DataFrame:
        return stats.numeric_stats(self.values, self.counters)

    def percentiles(self, probs=stats.PROBS) -> DataFrame:
        return stats.percentiles(self.values, self.counters, probs)

    def outlier_counts(self, method: str = "interpolated") -> DataFrame:
        return stats.outlier_counts(self.values, self.counters, method)

    def date_stats(self) -> DataFrame:
        return stats.date_stats(self.counters)

    def boolean_stats(self) -> DataFrame:
        return stats.boolean_stats(self.counters)

    @cached_property
    def _mode_bounds(self) -> DataFrame:
        return materialize(stats.mode_bounds(self.values, self.counters), "mode-bounds")

    def top_values(self) -> DataFrame:
        return stats.top_values(self.values, self.counters, self._mode_bounds, self.texts)

    def modes(self) -> DataFrame:
        return stats.modes(self.values, self.counters, self._mode_bounds, self.texts)

    def inconsistent_groups(self) -> DataFrame:
        return stats.inconsistent_groups(self.values, self.counters, lambda keys: self.texts(keys, trimmed=True))

    def type_summary(self) -> DataFrame:
        return stats.type_summary(self.counters)

    def column_profile(self) -> DataFrame:
        """One row per column, statistics as nested structs (null where they do not apply).

        Modes and inconsistent groups can be as many as the values, so here they are
        counts; `modes()` and `inconsistent_groups()` list them in full.
        """
        c = F.col
        numeric = self.numeric_stats().select(
            "column",
            F.struct(*NUMERIC_FIELDS).alias("numeric_stats"),
            "outlier_count",
        )
        dates = self.date_stats().select(
            "column", F.struct("earliest", "latest", "range_days").alias("date_stats")
        )
        booleans = self.boolean_stats().select(
            "column",
            F.struct(
                "true_count", "false_count", "true_percentage", "false_percentage"
            ).alias("boolean_stats"),
        )
        # ten values per column at most
        tops = (
            self.top_values()
            .groupBy("column")
            .agg(F.sort_array(F.collect_list(F.struct("place", "value", "count", "percentage"))).alias("top_values"))
            .join(self._mode_bounds.select("column", "n_modes", "mode_count"), "column")
            .select("column", F.struct("n_modes", "mode_count", "top_values").alias("categorical_stats"))
        )
        spellings = stats.inconsistency_counts(self.values, self.counters)
        zero = F.lit(0).cast("bigint")
        joined = self.counters
        for part in (numeric, dates, booleans, tops, spellings):
            joined = joined.join(F.broadcast(part), "column", "left")
        return stats.with_ordinal(joined, self.columns).select(
            "ordinal",
            c("column").alias("name"),
            "inferred_type",
            "total_values",
            "missing_count",
            "unique_count",
            F.when(c("total_values") > 0, c("unique_count") / c("total_values"))
            .otherwise(0.0)
            .alias("unique_ratio"),
            "is_empty",
            "numeric_stats",
            "date_stats",
            "categorical_stats",
            "boolean_stats",
            F.coalesce("inconsistent_groups", zero).alias("inconsistent_groups"),
            F.coalesce("inconsistent_spellings", zero).alias("inconsistent_spellings"),
            F.coalesce("outlier_count", zero).alias("outlier_count"),
        )

    def score(self) -> DataFrame:
        """One row: dataset, row_count, column_count, quality_score. Of the profile, only what the score is made of."""
        spellings = stats.inconsistency_counts(self.values, self.counters).select("column", "inconsistent_groups")
        outliers = self.outlier_counts().select("column", "outlier_count")
        columns = self.counters.join(F.broadcast(spellings), "column", "left").join(F.broadcast(outliers), "column", "left")
        totals = columns.agg(*_score_parts())
        rows = dedup.row_totals(self.df, self.columns)  # one row, as the totals are
        scored = rows.join(F.broadcast(totals)).withColumn("quality_score", quality_score())
        return scored.select(F.lit(self.name).alias("dataset"), "row_count", "column_count", "quality_score")

    @cached_property
    def profile(self) -> DataFrame:
        return materialize(self.dataset_profile(), "profile")

    def dataset_profile(self) -> DataFrame:
        """One row: totals, `columns`, `issues`, quality score. Width of the table, not
        its length, bounds the two arrays."""
        columns = self.column_profile()
        rows = dedup.row_totals(self.df, self.columns).withColumn("dataset", F.lit(self.name))
        per_table = columns.withColumn("dataset", F.lit(self.name)).groupBy("dataset").agg(
            *_score_parts(),
            F.sort_array(F.collect_list(F.struct(*columns.columns))).alias("columns"),
        )
        whole = rows.join(per_table, "dataset")
        scored = whole.withColumn("issues", issue_rules.issue_list()).withColumn(
            "quality_score", quality_score()
        )
        return scored.select(
            "dataset",
            "row_count",
            "column_count",
            "incomplete_row_count",
            "duplicate_row_count",
            "empty_column_count",
            "total_missing",
            "columns",
            "issues",
            "quality_score",
            score_label().alias("score_label"),
        )


def _score_parts() -> list[Column]:
    """Sums over the columns of a table that its score needs."""
    return [
        F.count("*").alias("column_count"),
        F.count(F.when(F.col("is_empty"), 1)).alias("empty_column_count"),
        F.sum(F.when(~F.col("is_empty"), F.col("missing_count")).otherwise(0)).alias("total_missing"),
        F.count(F.when(F.col("inconsistent_groups") > 0, 1)).alias("inconsistent_columns"),
        F.sum(F.when(F.col("inferred_type") == "number", F.col("total_values")).otherwise(0)).alias("numeric_cells"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outlier_cells"),
    ]


def profile_dataset(df: DataFrame, name: str = "dataset", columns=None, row_id: str | None = None) -> DataFrame:
    return Profiler(df, name, columns, row_id).dataset_profile()


# Points a fault may cost, and the limits of the labels.
MISSING_POINTS = 30.0
DUPLICATE_POINTS = 20.0
OUTLIER_POINTS = 10.0
INCONSISTENT_POINTS_PER_COLUMN = 5.0
EMPTY_POINTS_PER_COLUMN = 2.5
COUNTED_COLUMNS = 4


def quality_score() -> Column:
    """100 minus the penalties, between 0 and 100, rounded half up."""
    filled_cells = "(row_count * (column_count - empty_column_count))"

    def share(part: str, whole: str) -> str:
        return f"if({whole} > 0, {part} / {whole}, 0)"

    penalties = " + ".join([
        f"{share('total_missing', filled_cells)} * {MISSING_POINTS}D",
        f"{share('duplicate_row_count', 'row_count')} * {DUPLICATE_POINTS}D",
        f"least(inconsistent_columns, {COUNTED_COLUMNS}) * {INCONSISTENT_POINTS_PER_COLUMN}D",
        f"{share('outlier_cells', 'numeric_cells')} * {OUTLIER_POINTS}D",
        f"least(empty_column_count, {COUNTED_COLUMNS}) * {EMPTY_POINTS_PER_COLUMN}D",
    ])
    points = f"100.0D - ({penalties})"
    return F.expr(f"bigint(floor(greatest(0.0D, least(100.0D, {points})) + 0.5D))")


def score_label() -> Column:
    score = F.col("quality_score")
    return (
        F.when(score >= 90, "Good quality")
        .when(score >= 70, "Acceptable quality")
        .otherwise("Needs attention")
    )
