"""A cleaning recipe: a list of steps replayed over the untouched original.

Folding the list builds a plan; a step that needs figures of the data (mean, median, outlier
bounds) or reads it twice (duplicates) gets its input written first, so no earlier step runs
again for it. Undo and reset are list slices, because nothing is ever changed in place.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, dedup, stats
from ..operators.rowid import ROW_ID, data_columns
from ..session import materialize
from .profile import Profiler

STEP_TYPES = (
    "remove_duplicates",
    "fill_missing",
    "normalize_text",
    "convert_type",
    "remove_outlier_rows",
    "remove_column",
)


@dataclass(frozen=True)
class Step:
    type: str
    column: str | None = None
    config: dict[str, Any] = field(default_factory=dict)
    id: str = ""
    description: str = ""
    affected_count: int = 0

    def __post_init__(self):
        if self.type not in STEP_TYPES:
            raise ValueError(f"unknown step type {self.type!r}")
        strategy = self.config.get("strategy")
        if self.type == "fill_missing" and strategy and strategy not in (*clean.FILLS, "custom"):
            raise ValueError(f"unknown fill strategy {strategy!r}")
        if strategy == "custom" and self.config.get("fill_value") is None:
            raise ValueError("a custom fill needs a fill_value")

    def reads_twice(self) -> bool:
        """Whether the step looks at the whole table before it changes it."""
        by_figures = self.type == "fill_missing" and self.config.get("strategy") in ("mean", "median")
        by_bounds = self.type == "remove_outlier_rows" and "row_ids" not in self.config
        return self.type == "remove_duplicates" or by_figures or by_bounds


def _fill(df: DataFrame, step: Step) -> DataFrame:
    strategy = step.config.get("strategy")
    if strategy and strategy != "custom":
        return clean.FILLS[strategy](df, step.column) if step.column in df.columns else df
    value = step.config.get("fill_value")
    return clean.fill_missing(df, step.column, None if value is None else str(value))


def _outliers(df: DataFrame, step: Step, row_id: str) -> DataFrame:
    """Rows by predicate (`column`), or by id: a list, or a one-column table."""
    if "row_ids" not in step.config:
        return clean.remove_outliers(df, step.column, step.config.get("method", "interpolated"))
    ids = step.config["row_ids"]
    if isinstance(ids, DataFrame):
        return clean.remove_rows(df, ids, row_id)
    if not ids:
        return df
    table = df.sparkSession.createDataFrame([(int(i),) for i in ids], "id bigint")
    return clean.remove_rows(df, table, row_id)


def apply_step(df: DataFrame, step: Step, row_id: str = ROW_ID) -> DataFrame:
    if step.type == "remove_duplicates":
        return dedup.remove_duplicates(df, row_id, keep=step.config.get("keep", "first"))
    if step.type == "remove_outlier_rows":
        return _outliers(df, step, row_id)
    column = step.column or step.config.get("column")
    if column is None or column == row_id:
        return df
    if step.type == "fill_missing":
        return _fill(df, step)
    if step.type == "normalize_text":
        return clean.normalize_text(df, column, list(step.config.get("normalizations", [])))
    if step.type == "convert_type":
        return clean.convert_type(df, column, step.config.get("target_type", ""))
    return clean.remove_column(df, column)


def apply_recipe(df: DataFrame, steps: list[Step], row_id: str = ROW_ID) -> DataFrame:
    """All steps in order; an empty list returns the original itself."""
    written = True  # the original is read as it is
    for step in steps:
        if step.reads_twice() and not written:
            df, written = materialize(df, "step"), True
        after = apply_step(df, step, row_id)
        written = written and after is df
        df = after
    return df


def undo(steps: list[Step]) -> list[Step]:
    return steps[:-1]


def reset(steps: list[Step]) -> list[Step]:
    return []


def recipe_table(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """The recipe as a table (one row per step), to store or to report."""
    rows = [
        (i, s.id, s.type, s.column, s.description, int(s.affected_count))
        for i, s in enumerate(steps, 1)
    ]
    schema = (
        "step bigint, id string, type string, column string, description string, "
        "affected_count bigint"
    )
    return spark.createDataFrame(rows, schema)


def affected_count(df: DataFrame, step: Step, row_id: str = ROW_ID) -> int:
    """What a step touches in the version of the data that it is applied to.

    Duplicates: extra rows. Fill: missing cells. Normalise: spellings of inconsistent
    forms. Convert: present cells. Outliers: outlier cells. Column removal: 0. Only the step's
    own column is profiled, and only as far as its figure needs.
    """
    if step.type == "remove_duplicates":
        return dedup.row_totals(df, data_columns(df, None, row_id)).first()["duplicate_row_count"]
    if step.type == "remove_column" or step.column not in df.columns:
        return 0
    column = Profiler(df, "step", [step.column], row_id)
    if step.type == "normalize_text":
        figure = stats.inconsistency_counts(column.values, column.counters).select("inconsistent_spellings")
    elif step.type == "remove_outlier_rows":
        figure = column.outlier_counts().select("outlier_count")
    else:
        figure = column.counters.select("missing_count" if step.type == "fill_missing" else "total_values")
    found = figure.first()
    return int(found[0] or 0) if found else 0


def step_of(row: dict[str, Any]) -> Step:
    """The step of a mapped suggestion (`step_type`, `step_column`, `setting`) or of a stored `as_dict`."""
    if "step_type" not in row:
        return Step(**row)
    kind, setting = row["step_type"], row["setting"]
    config = {
        "remove_duplicates": {"keep": setting}, "fill_missing": {"fill_value": setting},
        "normalize_text": {"normalizations": (setting or "").split(",")}, "convert_type": {"target_type": setting},
    }.get(kind)
    if config is None:
        raise ValueError(f"a suggestion can't become a step of type {kind!r}")
    return Step(kind, row["step_column"], config, str(row.get("id") or ""), row.get("description") or "", int(row.get("affected_count") or 0))


def as_dict(step: Step) -> dict[str, Any]:
    return asdict(step)
