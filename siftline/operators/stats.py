"""Column statistics over the cell table (see `freq`).

Every function takes a table (column, value, cnt), so each works on raw cells and on
the distinct values alike. Per-column results have one row per column; they are the
only thing broadcast here, and the table's own width bounds them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as rules
from ..session import materialize
from . import ranks
from .freq import cells, classified, numbers, ordinal_of
from .rowid import data_columns, name, text_columns

TYPE_SHARE = 0.8
TOP_VALUES = 10
PROBS = {
    "p10": 0.1, "q1": 0.25, "median": 0.5, "q3": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99,
}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))


def _total(condition: str) -> str:
    return f"sum(if({condition}, cnt, 0))"


# boolean before date before number: 0/1 columns are boolean
_INFERRED = f"""
    case when total_values = 0 then 'unknown'
         when (true_count + false_count) / total_values >= {TYPE_SHARE} then 'boolean'
         when date_like / total_values >= {TYPE_SHARE} then 'date'
         when number_like / total_values >= {TYPE_SHARE} then 'number'
         else 'text' end
"""


def column_counters(table: DataFrame) -> DataFrame:
    """One row per column with everything that adds up, in a single aggregation.

    Map-side combine leaves one row per column and task to shuffle. Callers select
    what they need; Catalyst drops the rest, patterns included.
    `unique_count` is right only for a table of distinct values.
    """
    aggs = {
        "row_count": "sum(cnt)",
        "missing_count": _total("missing"),
        "total_values": _total("not missing"),
        "unique_count": "sum(if(missing, 0L, 1L))",
        "true_count": _total("is_true"),
        "false_count": _total("is_false"),
        "number_like": _total("is_number"),
        "date_like": _total("is_date"),
        "num_count": _total("x is not null"),
        "num_sum": "sum(x * cnt)",
        "num_min": "min(x)",
        "num_max": "max(x)",
        "first_ts": "min(ts)",
        "last_ts": "max(ts)",
    }
    sums = classified(table).groupBy("column").agg(
        *[F.expr(f"{e} as {k}") for k, e in aggs.items()]
    )
    return sums.selectExpr("*", "total_values = 0 as is_empty", f"{_INFERRED} as inferred_type")


def of_type(table: DataFrame, counters: DataFrame, *types: str) -> DataFrame:
    """Keep the columns of the given inferred types and add the table's row count."""
    chosen = counters.where(F.col("inferred_type").isin(*types)).select("column", "row_count")
    return table.join(F.broadcast(chosen), "column")


def missing_counts(table: DataFrame) -> DataFrame:
    return column_counters(table).select("column", "missing_count", "total_values", "is_empty")


def infer_types(table: DataFrame) -> DataFrame:
    return column_counters(table).select("column", "inferred_type")


def unique_counts(distinct: DataFrame) -> DataFrame:
    return column_counters(distinct).select(
        "column",
        "unique_count",
        _ratio(F.col("unique_count"), F.col("total_values")).alias("unique_ratio"),
    )


def empty_columns(table: DataFrame) -> DataFrame:
    return column_counters(table).where("is_empty").select("column")


def completeness(table: DataFrame) -> DataFrame:
    """Share of present cells in percent (one decimal), with its band."""
    present = F.col("total_values")
    rows = F.col("row_count")
    pct = F.when(rows > 0, rules.round_half_up(present / rows * 100, 1)).otherwise(F.lit(100.0))
    band = F.when(pct >= 95, "good").when(pct >= 80, "fair").otherwise("poor")
    return column_counters(table).select("column", pct.alias("completeness"), band.alias("band"))


def type_summary(counters: DataFrame) -> DataFrame:
    return (
        counters.groupBy("inferred_type")
        .agg(F.count("*").alias("n_columns"))
        .orderBy(F.desc("n_columns"), "inferred_type")
    )


def boolean_stats(counters: DataFrame) -> DataFrame:
    c = F.col
    return counters.where("inferred_type = 'boolean'").select(
        "column",
        "true_count",
        "false_count",
        _percent(c("true_count"), c("row_count")).alias("true_percentage"),
        _percent(c("false_count"), c("row_count")).alias("false_percentage"),
    )


def date_stats(counters: DataFrame) -> DataFrame:
    seconds = F.unix_micros("last_ts") / 1e6 - F.unix_micros("first_ts") / 1e6
    return counters.where("inferred_type = 'date' and first_ts is not null").select(
        "column",
        F.date_format("first_ts", "yyyy-MM-dd").alias("earliest"),
        F.date_format("last_ts", "yyyy-MM-dd").alias("latest"),
        F.floor(seconds / 86400 + 0.5).alias("range_days"),
    )


def numeric_stats(table: DataFrame, counters: DataFrame) -> DataFrame:
    """All numeric statistics per number column, outlier count included.

    Sums and ends are already in the counters. One pass finds the quantiles, a second
    takes the mean and the outlier bounds as given: so the variance is the two-pass
    one, and outliers cost no pass of their own.
    """
    points = numbers(of_type(table, counters, "number"))
    q = ranks.quantiles(points, PROBS)
    sums = counters.selectExpr(
        "column", "num_sum", "num_min", "num_max", "num_sum / num_count as num_mean"
    )
    known = ranks.with_fences(q).join(F.broadcast(sums), "column")
    spread = (
        points.join(F.broadcast(known), "column")
        .groupBy("column")
        .agg(
            F.expr("sum(pow(x - num_mean, 2) * cnt) as squares"),
            F.expr("sum(if(x < lower or x > upper, cnt, 0)) as outlier_count"),
            # the column's own figures ride along, so nothing is joined again
            *[F.expr(f"max({k}) as {k}") for k in ("num_count", "num_sum", "num_mean", "num_min", "num_max", *PROBS)],
        )
    )
    return spread.selectExpr(
        "column",
        "num_count",
        "num_sum as sum",
        "num_mean as mean",
        "median",
        "num_min as min",
        "num_max as max",
        "num_max - num_min as range",
        "q1",
        "q3",
        "q3 - q1 as iqr",
        "squares / num_count as variance",
        "sqrt(squares / num_count) as std_dev",
        "p10",
        "p90",
        "p95",
        "p99",
        "outlier_count",
    )


def percentiles(table: DataFrame, counters: DataFrame, probs: dict[str, float] = PROBS) -> DataFrame:
    return ranks.quantiles(numbers(of_type(table, counters, "number")), probs)


def approx_percentiles(
    table: DataFrame, counters: DataFrame, probs: dict[str, float] = PROBS, accuracy: int = 10000
) -> DataFrame:
    """One-pass sketch instead of exact ranks. Opt-in; nothing else calls it."""
    points = numbers(of_type(table, counters, "number"))
    sketch = F.percentile_approx("x", list(probs.values()), accuracy)
    at = points.groupBy("column").agg(sketch.alias("at"))
    return at.select("column", *[F.col("at")[i].alias(k) for i, k in enumerate(probs)])


def outlier_counts(table: DataFrame, counters: DataFrame, method: str = "interpolated") -> DataFrame:
    points = numbers(of_type(table, counters, "number"))
    bounds = ranks.fences(points, method=method)
    return (
        points.join(F.broadcast(bounds.select("column", "lower", "upper")), "column")
        .groupBy("column")
        .agg(F.expr("sum(if(x < lower or x > upper, cnt, 0)) as outlier_count"))
    )


def _text_values(distinct: DataFrame, counters: DataFrame) -> DataFrame:
    present = classified(distinct).where(~F.col("missing"))
    return of_type(present, counters, "text")


def mode_bounds(distinct: DataFrame, counters: DataFrame) -> DataFrame:
    """Per text column: highest count, how many values share it, and the count that
    the tenth place has. Read off the (column, count) table, which is small."""
    sizes = (
        _text_values(distinct, counters)
        .groupBy("column", "cnt")
        .agg(F.count("*").alias("n_values"))
    )
    w = Window.partitionBy("column").orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("above", F.coalesce(F.sum("n_values").over(w), F.lit(0)))
    return (
        ranked.where(F.col("above") < TOP_VALUES)
        .groupBy("column")
        .agg(
            F.max("cnt").alias("mode_count"),
            F.sum(F.when(F.col("above") == 0, F.col("n_values"))).alias("n_modes"),
            F.min("cnt").alias("floor_cnt"),
        )
    )


#: Gives the whole texts (column, key, text) of the (column, key) rows of a written table.
Texts = Callable[[DataFrame], DataFrame]


def _with_texts(found: DataFrame, texts: Texts | None, key: str = "key") -> DataFrame:
    """Whole texts in place of the starts of long ones; `found` is small or is the result itself."""
    if texts is None or "long" not in found.columns:
        return found
    found = materialize(found, "found")
    wanted = found.where("long").select("column", F.col(key).alias("key"))
    if wanted.isEmpty():
        return found
    whole = texts(wanted).withColumnsRenamed({"key": key, "text": "_text"})
    return found.join(whole, ["column", key], "left").withColumn("value", F.when(F.col("long"), F.col("_text")).otherwise(F.col("value"))).drop("_text")


def top_values(distinct: DataFrame, counters: DataFrame, bounds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """The ten most frequent values per text column, ties in locale order.

    Values below the tenth place's count are dropped first; the rest goes through a
    ranking that keeps ten rows per column and task before its shuffle. Of long texts, only those that
    reach the ten by the letters they start with are fetched whole.
    """
    bounds = mode_bounds(distinct, counters) if bounds is None else bounds
    near = _text_values(distinct, counters).join(
        F.broadcast(bounds.select("column", "floor_cnt")), "column"
    ).where(F.col("cnt") >= F.col("floor_cnt"))
    if texts is not None and "long" in near.columns:
        by_start = Window.partitionBy("column").orderBy(F.desc("cnt"), F.collate("value", "UNICODE_CI_AI"))
        near = _with_texts(near.withColumn("_start", F.rank().over(by_start)).where(F.col("_start") <= TOP_VALUES), texts)
    w = Window.partitionBy("column").orderBy(
        F.desc("cnt"), F.collate("value", "UNICODE"), F.col("value")
    )
    return (
        near.withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= TOP_VALUES)
        .select(
            "column",
            F.col("place").cast("bigint").alias("place"),
            "value",
            F.col("cnt").alias("count"),
            _percent(F.col("cnt"), F.col("row_count")).alias("percentage"),
        )
    )


def modes(distinct: DataFrame, counters: DataFrame, bounds: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """Every value that shares the highest count of its text column.

    In a column of unique values that is all of them, so the rows stay distributed.
    """
    bounds = mode_bounds(distinct, counters) if bounds is None else bounds
    found = _text_values(distinct, counters).join(F.broadcast(bounds.select("column", "mode_count")), "column")
    return _with_texts(found.where(F.col("cnt") == F.col("mode_count")), texts).select(
        "column",
        "value",
        F.col("cnt").alias("count"),
        _percent(F.col("cnt"), F.col("row_count")).alias("percentage"),
    )


def _spellings(distinct: DataFrame, counters: DataFrame) -> DataFrame:
    """(column, normal_form, spelling, count); keys of `value_keys` stand for long texts."""
    keyed = "form" in distinct.columns
    form = F.col("form") if keyed else rules.normal_form(F.col("value"))
    spelling = F.col("spelling") if keyed else rules.js_trim(F.col("value"))
    values = _text_values(distinct, counters)
    return values.groupBy("column", form.alias("normal_form"), spelling.alias("spelling")).agg(F.sum("cnt").alias("count"))


def inconsistent_forms(distinct: DataFrame, counters: DataFrame) -> DataFrame:
    """(column, normal_form, n_spellings) for forms with two or more spellings."""
    return (
        _spellings(distinct, counters)
        .groupBy("column", "normal_form")
        .agg(F.count("*").alias("n_spellings"))
        .where("n_spellings >= 2")
    )


def inconsistent_groups(distinct: DataFrame, counters: DataFrame, texts: Texts | None = None) -> DataFrame:
    """One row per spelling of an inconsistent form; `texts` gives the trimmed text of a spelling's key.

    Flat on purpose: a form can have any number of spellings, and a row per spelling
    never has to fit into one task.
    """
    spellings = _spellings(distinct, counters)
    forms = (
        spellings.groupBy("column", "normal_form")
        .agg(F.count("*").alias("n_spellings"))
        .where("n_spellings >= 2")
    )
    found = spellings.join(forms, ["column", "normal_form"])
    if texts is None:
        return found
    marked = found.withColumns({"value": F.col("spelling"), "long": F.col("spelling").startswith("\0") & (F.length("spelling") == 33)})
    whole = _with_texts(marked, texts, "spelling")
    form = F.when(F.col("long"), F.lower("value")).otherwise(F.col("normal_form"))
    return whole.withColumn("normal_form", form).withColumn("spelling", F.col("value")).select(*found.columns)


def inconsistency_counts(distinct: DataFrame, counters: DataFrame) -> DataFrame:
    return (
        inconsistent_forms(distinct, counters)
        .groupBy("column")
        .agg(
            F.count("*").alias("inconsistent_groups"),
            F.sum("n_spellings").alias("inconsistent_spellings"),
        )
    )


def any_missing(columns: list[Column]) -> Column:
    flag = F.lit(False)
    for c in columns:
        flag = flag | rules.is_missing(c)
    return flag


def incomplete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = data_columns(df, columns)
    flag = any_missing(text_columns(df, cols))
    return df.agg(
        F.count("*").alias("row_count"),
        F.count(F.when(flag, 1)).alias("incomplete_row_count"),
    )


# Sample size, share and patterns of the fill-type hint.
HINT_SAMPLE = 50
HINT_SHARE = 0.7
HINT_NUMBER = r"^-?\d+(\.\d+)?$"


def fill_type_hint(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Kind of fill value to offer per column, from its first 50 present cells.

    One scan: the place within the column is limited before the shuffle and after it, so at
    most 50 cells per column and task are shuffled and nothing is sorted as a whole.
    """
    present = cells(df, columns, row_id).where(~rules.is_missing(F.col("value")))
    first = present.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("row_id")))
    text = F.col("value")
    seen = (
        first.where(F.col("place") <= HINT_SAMPLE)
        .groupBy("column")
        .agg(
            F.count("*").alias("n"),
            F.count(F.when(rules.js_trim(text).rlike(HINT_NUMBER), 1)).alias("nums"),
            F.count(F.when(rules.looks_date(text) & text.contains("-"), 1)).alias("dates"),
        )
    )
    need = F.col("n") * HINT_SHARE
    kind = (
        F.when((F.col("nums") >= need) & (need > 0), "number")
        .when((F.col("dates") >= need) & (need > 0), "date")
        .otherwise("text")
    )
    # a column without a present cell has no row here
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(F.broadcast(seen.select("column", kind.alias("fill_type"))), "column", "left").select(
        "column", F.coalesce("fill_type", F.lit("text")).alias("fill_type")
    )


def with_ordinal(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumn("ordinal", ordinal_of(columns).cast("bigint"))
