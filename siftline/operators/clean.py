"""Cleaning steps: DataFrame -> DataFrame, lazy, the input untouched.

Cells are text, as the loaders deliver them; a step on a typed column works on its
text form. A step that changes nothing returns its input unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as rules
from ..session import materialize
from . import ranks
from .freq import number, typed_numbers
from .rowid import ROW_ID, name

TEXT_FORMS = {
    "trim": rules.js_trim,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "titlecase": rules.title_case,
}


def _text(df: DataFrame, column: str) -> Column:
    return rules.stringify(name(column), df.schema[column].dataType)


def _replace(df: DataFrame, column: str, new: Column) -> DataFrame:
    return df.select(*[new.alias(c) if c == column else name(c) for c in df.columns])


def fill_missing(df: DataFrame, column: str, value: str | Column | None) -> DataFrame:
    """Put `value` into the missing cells; None leaves them."""
    if value is None or column not in df.columns:
        return df
    fill = value if isinstance(value, Column) else F.lit(value)
    text = _text(df, column)
    return _replace(df, column, F.when(rules.is_missing(text), fill).otherwise(text))


def figure(one_row: DataFrame) -> str:
    """The single number of a one-row table, as cell text; "0" when there is none.

    One value comes to the driver and becomes a literal of the next step. A recipe then
    grows by one projection per step; kept as a subquery, each such step would repeat
    the plan of all steps before it.
    """
    row = one_row.toDF("v").select(rules.number_text(F.col("v")).alias("v")).first()
    return row["v"] if row and row["v"] is not None else "0"


def fill_with_mean(df: DataFrame, column: str) -> DataFrame:
    """Fill with the mean of the current numbers, two decimals."""
    mean = typed_numbers(df, [column]).agg(rules.round_half_up(F.avg("x"), 2))
    return fill_missing(df, column, figure(mean))


def _written_numbers(df: DataFrame, column: str) -> DataFrame:
    """The column's numbers as a written table.

    The quantile passes then read one narrow column; the steps before this one, which
    may hold joins, run once.
    """
    return materialize(typed_numbers(df, [column]), "numbers")


def fill_with_median(df: DataFrame, column: str) -> DataFrame:
    """Fill with the exact median of the current numbers."""
    points = _written_numbers(df, column)
    return fill_missing(df, column, figure(ranks.quantiles(points, {"median": 0.5}).select("median")))


FILLS = {
    "leave": lambda df, c: df,
    "unknown": lambda df, c: fill_missing(df, c, "Unknown"),
    "zero": lambda df, c: fill_missing(df, c, "0"),
    "mean": fill_with_mean,
    "median": fill_with_median,
}


def apply_text_forms(text: Column, forms: list[str]) -> Column:
    """The forms in the order given; unknown names do nothing."""
    return reduce(lambda t, f: TEXT_FORMS[f](t) if f in TEXT_FORMS else t, forms, text)


def normalize_text(df: DataFrame, column: str, forms: list[str]) -> DataFrame:
    if not forms or column not in df.columns:
        return df
    text = _text(df, column)
    new = F.when(rules.is_missing(text), text).otherwise(apply_text_forms(text, forms))
    return _replace(df, column, new)


CONVERSIONS = {
    "number": lambda t: rules.number_text(rules.parse_numeric(t)),
    "date": rules.to_iso_date,
    "boolean": rules.to_bool_token,
}
TYPED = {
    "number": rules.parse_numeric,
    "date": lambda t: rules.parse_date(t).cast("date"),
    "boolean": lambda t: rules.to_bool_token(t).try_cast("boolean"),
}


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """Rewrite the cells that convert; leave missing and unconvertible ones as they are."""
    if column not in df.columns or target not in CONVERSIONS:
        return df
    text = _text(df, column)
    new = F.when(rules.is_missing(text), text).otherwise(
        F.coalesce(CONVERSIONS[target](text), text)
    )
    return _replace(df, column, new)


def convert_typed(df: DataFrame, column: str, target: str, reject: str | None = None) -> DataFrame:
    """Give the column a real type; text that does not convert moves to a reject column."""
    text = _text(df, column)
    value = F.when(~rules.is_missing(text), TYPED[target](text))
    rejected = F.when(~rules.is_missing(text) & value.isNull(), text)
    return _replace(df.withColumn(reject or f"{column}_rejected", rejected), column, value)


def outlier_flag(df: DataFrame, column: str, method: str = "interpolated") -> Column:
    """True where the cell's number lies outside the column's bounds.

    The two bounds are one row; they become literals, as in `figure`.
    """
    limits = ranks.fences(_written_numbers(df, column), method=method).first()
    if limits is None or limits["lower"] is None:
        return F.lit(False)
    return outside(number(df, column), limits["lower"], limits["upper"])


def outside(x: Column, lower: float, upper: float) -> Column:
    """True for a number outside the bounds; names `x` once, see `rules.bounded`."""
    return F.exists(F.array(x), lambda v: F.coalesce((v < lower) | (v > upper), F.lit(False)))


def remove_outliers(df: DataFrame, column: str, method: str = "interpolated") -> DataFrame:
    if column not in df.columns:
        return df
    return df.where(~outlier_flag(df, column, method))


def remove_rows(df: DataFrame, ids: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Drop the rows whose id is in the one-column table `ids`."""
    unwanted = ids.select(name(ids.columns[0]).alias(row_id))
    return df.join(unwanted, row_id, "left_anti").select(*[name(c) for c in df.columns])


def remove_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(name(column)) if column in df.columns else df
