"""Row inspection: issue flags, filters, search, pages, cell differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as rules
from ..functions import stringify
from ..session import materialize
from . import ranks, stats
from .clean import outside
from .dedup import with_duplicate_flag
from .freq import number, text_key
from .rowid import data_columns, name, text_columns

# Page sizes on offer.
PAGE_SIZES = (25, 50, 100)

FLAGS = {
    "missing_values": "has_missing",
    "duplicate_rows": "is_duplicate",
    "inconsistent_values": "has_inconsistent",
    "potential_outliers": "has_outlier",
}


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


#: Forms up to which they are sent to all tasks.
SENT_FORMS = 100_000


def with_inconsistent_flag(df: DataFrame, profiler, flag: str, row_id: str) -> DataFrame:
    """Flag rows holding a value whose form is spelled in more than one way.

    The forms are written and counted. Few are sent to all tasks, and no row moves. Many are joined with narrow
    cells (row id, form) of all columns at once, of which only the ids that hit come back to the rows;
    cells without a form take no part, so they do not meet in one task.
    """
    forms = materialize(
        stats.inconsistent_forms(profiler.values, profiler.counters).select("column", "normal_form").distinct(), "forms"
    )
    sizes = {r["column"]: r["n"] for r in forms.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = [c for c in profiler.columns if c in sizes]
    if not columns:
        return df.withColumn(flag, F.lit(False))
    texts = {c: stringify(name(c), df.schema[c].dataType) for c in columns}
    keys = {c: F.when(~rules.is_missing(t), text_key(rules.normal_form(t))) for c, t in texts.items()}
    if sum(sizes.values()) <= SENT_FORMS:
        hits = []
        for i, column in enumerate(columns):
            form, hit = f"_form{i}", f"_hit{i}"
            mine = forms.where(F.col("column") == column).select(F.col("normal_form").alias(form), F.lit(True).alias(hit))
            df = df.withColumn(form, keys[column]).join(F.broadcast(mine), form, "left").drop(form)
            hits.append(F.col(hit).isNotNull())
        return df.withColumn(flag, _any(hits)).drop(*[f"_hit{i}" for i in range(len(columns))])
    cell = df.select(name(row_id).alias("_row"), *[keys[c].alias(c) for c in columns]).unpivot(["_row"], [name(c) for c in columns], "column", "normal_form")
    rows = cell.where("normal_form is not null").join(forms, ["column", "normal_form"], "left_semi").select("_row").distinct()
    found = df.join(rows.withColumn("_hit", F.lit(True)), name(row_id).eqNullSafe(F.col("_row")), "left")
    return found.withColumn(flag, F.col("_hit").isNotNull()).drop("_row", "_hit")


def outlier_limits(distinct: DataFrame, counters: DataFrame, method: str) -> DataFrame:
    """(column, lower, upper) of the number columns, as counted by the profile."""
    points = stats.numbers(stats.of_type(distinct, counters, "number"))
    return ranks.fences(points, method=method).select("column", "lower", "upper")


def row_flags(
    df: DataFrame,
    profiler,
    row_id: str,
    types: tuple[str, ...] = tuple(FLAGS),
    method: str = "interpolated",
    keep_columns: bool = False,
) -> DataFrame:
    """One row per input row with the flags of the given issue types, and `has_any`.

    Missing is an expression. Outliers are tested on number columns only, against bounds
    fetched once. Duplicate and inconsistent are left joins on unique keys. A type
    that is not asked for costs nothing.
    """
    columns = profiler.columns
    flagged = df
    if "duplicate_rows" in types:
        flagged = with_duplicate_flag(flagged, row_id, columns)
    if "inconsistent_values" in types:
        flagged = with_inconsistent_flag(flagged, profiler, "has_inconsistent", row_id)
    if "missing_values" in types:
        flagged = flagged.withColumn("has_missing", stats.any_missing(text_columns(df, columns)))
    if "potential_outliers" in types:
        limits = outlier_limits(profiler.values, profiler.counters, method).where("lower is not null").collect()
        # one row per number column; its bounds become literals
        tests = [outside(number(df, r["column"]), r["lower"], r["upper"]) for r in limits]
        flagged = flagged.withColumn("has_outlier", _any(tests))
    flags = [F.col(FLAGS[t]) for t in FLAGS if t in types]
    shown = [name(c) for c in columns] if keep_columns else []
    return flagged.select(name(row_id), *shown, *flags, _any(flags).alias("has_any"))


def rows_with(df: DataFrame, profiler, row_id: str, issue_type: str) -> DataFrame:
    """The rows flagged with one issue type, columns included ("all" keeps every row)."""
    if issue_type == "all":
        return df
    flags = row_flags(df, profiler, row_id, (issue_type,), keep_columns=True)
    return flags.where("has_any").select(name(row_id), *[name(c) for c in profiler.columns])


def any_issue_count(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count(F.when(F.col("has_any"), 1)).alias("rows_with_any_issue"))


def search_rows(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any cell contains the trimmed text, whatever its case."""
    q = query.strip(rules.WHITESPACE).lower()
    if not q:
        return df
    texts = text_columns(df, data_columns(df, columns))
    hit = _any([F.coalesce(F.contains(F.lower(t), F.lit(q)), F.lit(False)) for t in texts])
    return df.where(hit)


def page_rows(df: DataFrame, row_id: str, page: int = 1, size: int = 50) -> DataFrame:
    """One page of rows in row order; a page past the end gives the last one.

    The first page is a bounded top-k. A later page is found by rank: its first and
    last row id are looked up, then the rows between are read. An offset would carry
    every row before the page through one task.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"page size must be one of {PAGE_SIZES}")
    if page <= 1:
        return df.orderBy(name(row_id)).limit(size)
    points = df.select(
        F.lit(0).alias("g"), name(row_id).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("cnt")
    )
    start = f"((least({page}, ceil(total / {size})) - 1) * {size})"
    ends = f"array({start}, least({start} + {size}, total) - 1)"
    found = ranks.select_ranks(points, ends, ["g"])
    between = found.agg(F.expr("struct(min(x) as lo, max(x) as hi) as ends")).scalar()
    return df.where(name(row_id).between(between["lo"], between["hi"])).orderBy(name(row_id))


def find_page(
    df: DataFrame, profiler, row_id: str, issue_type: str = "all", query: str = "", page: int = 1, size: int = 50
) -> DataFrame:
    """One page of the rows that have an issue and contain a text, with the number of such rows and pages.

    The filtered rows are written once, as counting, finding the page and reading it all need them.
    """
    found = materialize(search_rows(rows_with(df, profiler, row_id, issue_type), query, profiler.columns), "found")
    rows = found.count()
    shown = page_rows(found, row_id, page, size)
    return shown.withColumn("row_count", F.lit(rows).cast("bigint")).withColumn("page_count", F.lit(max(1, -(-rows // size))).cast("bigint"))


def cell_diff(original: DataFrame, cleaned: DataFrame, row_id: str) -> DataFrame:
    """Changed cells: (row id, column, before, after, change).

    Rows are matched by id, not by position. `change` is "changed", or "removed" /
    "added" for a row that only one side has. Only columns both sides have are
    compared, null counting as "". Nothing is unpivoted: each joined row yields just
    its changed cells.
    """
    columns = [c for c in data_columns(original, None, row_id) if c in cleaned.columns]

    def side(df: DataFrame, label: str) -> DataFrame:
        texts = [F.coalesce(t, F.lit("")).alias(c) for t, c in zip(text_columns(df, columns), columns)]
        return df.select(name(row_id), F.struct(*texts).alias(label))

    both = side(original, "b").join(side(cleaned, "a"), row_id, "full_outer")
    change = (
        F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("changed")
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.col("b").getField(c), F.lit("")).alias("before"),
                F.coalesce(F.col("a").getField(c), F.lit("")).alias("after"),
            )
            for c in columns
        ]
    )
    differing = F.filter(pairs, lambda p: p["before"] != p["after"])
    return both.select(name(row_id), change.alias("change"), F.explode(differing).alias("p")).select(
        row_id, "p.column", "p.before", "p.after", "change"
    )
