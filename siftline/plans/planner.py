"""Counting and running a recipe with as many readings of the table as its steps really need.

What depends on what: a step changes cells of its own column, or removes rows. Figures of a
step (its affected count, a mean, a median, outlier bounds) come from the values of its column alone. So a
recipe falls into stages, each ended by a step that removes rows. A stage counts the values of all columns
it touches in one scan; its steps are then carried out on these small tables for their figures, columns independent
of each other, and on the rows as one lazy projection, written once when the stage ends.
A column that a later step drops is no longer written once nothing reads it.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as rules
from ..operators import clean, dedup, ranks, stats
from ..operators.freq import FACTS, classified, number, numbers, value_freq
from ..operators.rowid import ROW_ID, name
from ..session import materialize
from .recipe import Step, affected_count, apply_step


def _column(step: Step) -> str | None:
    return step.column or step.config.get("column")


def _by_bounds(step: Step) -> bool:
    return step.type == "remove_outlier_rows" and "row_ids" not in step.config


def stages(steps: list[Step]) -> list[list[int]]:
    """The steps' numbers, cut after every step that removes rows; one that reads whole rows stands alone."""
    out: list[list[int]] = [[]]
    for i, step in enumerate(steps):
        if step.type == "remove_duplicates" or (step.type == "remove_outlier_rows" and not _by_bounds(step)):
            out += [[i], []]
        else:
            out[-1].append(i)
            if _by_bounds(step):
                out.append([])
    return [s for s in out if s]


def unread(columns: list[str], steps: list[Step]) -> list[str]:
    """The columns that `steps` drop before any of them reads them; removing duplicates reads all."""
    gone = []
    for c in columns:
        first = next((s for s in steps if s.type == "remove_duplicates" or _column(s) == c), None)
        if first is not None and first.type == "remove_column":
            gone.append(c)
    return gone


def _values(table: DataFrame, column: str) -> DataFrame:
    """A stage's table (the column, cnt, and what its cells are, while that is known) as the statistics read it."""
    facts = [f for f in FACTS if f in table.columns]
    return table.select(F.lit(column).alias("column"), name(column).alias("value"), "cnt", *facts)


def _after(table: DataFrame, column: str, step: Step) -> DataFrame:
    """A stage's table after a step on its column; what is known of the cells stays known through a fill."""
    known = set(FACTS) <= set(table.columns) and column not in FACTS
    if step.type != "fill_missing" or not known or step.config.get("fill_value") is None:
        return apply_step(table.select(name(column), "cnt"), step)
    text = str(step.config["fill_value"])
    one = classified(table.sparkSession.createDataFrame([(text,)], "value string")).first()
    filled = {f: F.when(F.col("missing"), F.lit(one[f]).cast(table.schema[f].dataType)).otherwise(F.col(f)) for f in FACTS}
    cell = F.when(F.col("missing"), F.lit(text)).otherwise(name(column))
    return table.select(cell.alias(column), "cnt", *[filled[f].alias(f) for f in FACTS])


def _count(step: Step, values: DataFrame, bounds: tuple | None) -> DataFrame:
    """One row `n`: what the step touches."""
    zero = F.lit(0).cast("long")
    if step.type == "normalize_text":
        found = stats.inconsistency_counts(values, stats.column_counters(values)).agg(F.max("inconsistent_spellings").alias("n"))
    elif step.type == "remove_outlier_rows":
        if bounds is None:
            return values.agg(zero.alias("n"))
        numeric = stats.of_type(values, stats.column_counters(values), "number")
        found = numbers(numeric).where((F.col("x") < bounds[0]) | (F.col("x") > bounds[1])).agg(F.sum("cnt").alias("n"))
    else:
        figure = "missing_count" if step.type == "fill_missing" else "total_values"
        found = stats.column_counters(values).agg(F.max(figure).alias("n"))
    return found.select(F.coalesce(F.col("n").cast("long"), zero).alias("n"))


def _literal_fill(step: Step, column: str, values: DataFrame) -> Step:
    """A fill by mean or median as a fill with that value."""
    points = numbers(values)
    if step.config["strategy"] == "mean":
        one = points.agg(rules.round_half_up(F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt"), 2).alias("v"))
    else:
        one = ranks.quantiles(points, {"median": 0.5}).select(F.col("median").alias("v"))
    return replace(step, config={"fill_value": clean.figure(one)})


def _stage(version: DataFrame, steps: list[tuple[int, Step]]) -> tuple[DataFrame, dict[int, int]]:
    """The rows after the stage, lazy, and its steps' counts."""
    touched = [c for c in dict.fromkeys(_column(s) for _, s in steps if s.type != "remove_column") if c in version.columns]
    tables: dict[str, DataFrame] = {}
    if touched:
        values = materialize(classified(value_freq(version, touched)), "stage-values")
        kept = {c: [] if c in FACTS else FACTS for c in touched}
        tables = {c: values.where(F.col("column") == c).select(F.col("value").alias(c), "cnt", *kept[c]) for c in touched}
    counts: list[DataFrame] = []
    for i, step in steps:
        c = _column(step)
        if c not in tables:
            version = apply_step(version, step) if c in version.columns else version
            continue
        if step.type == "remove_column":
            version = apply_step(version, step)
            del tables[c]
            continue
        values, bounds = _values(tables[c], c), None
        if _by_bounds(step):
            found = ranks.fences(numbers(values), method=step.config.get("method", "interpolated")).first()
            bounds = None if found is None or found["lower"] is None else (found["lower"], found["upper"])
        counts.append(_count(step, values, bounds).select(F.lit(i).alias("i"), "n"))
        if _by_bounds(step):
            version = version if bounds is None else version.where(~clean.outside(number(version, c), *bounds))
            continue
        if step.type == "fill_missing" and step.config.get("strategy") in ("mean", "median"):
            step = _literal_fill(step, c, values)  # its value is a literal from here on
        tables[c] = _after(tables[c], c, step)
        version = apply_step(version, step)
    found = reduce(DataFrame.unionByName, counts).collect() if counts else []
    return version, {r["i"]: r["n"] for r in found}


def counted_recipe(df: DataFrame, steps: list[Step], row_id: str = ROW_ID) -> tuple[DataFrame, list[Step]]:
    """(cleaned rows, steps with their affected counts).

    Each step is counted on the version of the data it is applied to, as when a recipe is put together step by
    step (`recipe.affected_count`). Columns are taken as text; other types are counted step by step.
    """
    counts: dict[int, int] = {}
    written = True
    for stage in stages(steps):
        own = [(i, steps[i]) for i in stage]
        first = own[0][1]
        if not written:
            df, written = materialize(df.drop(*unread(df.columns, steps[stage[0] :])), "version"), True
        if first.type == "remove_duplicates":
            repeated = materialize(dedup.repeated_rows(df, row_id), "repeated")
            counts[stage[0]] = repeated.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
            df = dedup.remove_repeated(df, repeated, row_id, first.config.get("keep", "first"))
        elif len(own) == 1 and first.type == "remove_outlier_rows" and not _by_bounds(first):
            counts[stage[0]] = affected_count(df, first, row_id)
            df = apply_step(df, first, row_id)
        elif all(df.schema[c].dataType == T.StringType() for c in {_column(s) for _, s in own} & set(df.columns)):
            df, found = _stage(df, [(i, s) for i, s in own if _column(s) not in (None, row_id)])
            counts.update(found)
        else:
            for i, step in own:
                counts[i] = affected_count(df, step, row_id)
                df = materialize(apply_step(df, step, row_id), "version")
        written = False
    return materialize(df, "version"), [replace(s, affected_count=counts.get(i, 0)) for i, s in enumerate(steps)]
