"""Data-quality issues: built from the profile row, and views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Share of rows from which a fault is high or medium.
MISSING_HIGH, MISSING_MEDIUM = 0.2, 0.05
DUPLICATE_HIGH, DUPLICATE_MEDIUM = 0.1, 0.02
PROBLEM_COLUMNS = 6
DEFAULT_COLUMNS = 20


def _severity(share: str, high: float, medium: float) -> str:
    return f"case when {share} >= {high} then 'high' when {share} >= {medium} then 'medium' else 'low' end"


def _counted(n: str, word: str) -> str:
    """SQL text for "3 words" or "1 word" without grouping of digits."""
    return f"concat({n}, ' {word}', if({n} = 1, '', 's'))"


def _grouped(n: str, word: str) -> str:
    """The same with thousands grouped."""
    return f"concat(format_number({n}, 0), ' {word}', if({n} = 1, '', 's'))"


def _issue(id_: str, type_: str, severity: str, column: str, count: str, text: str) -> str:
    return (
        f"named_struct('id', {id_}, 'type', '{type_}', 'severity', {severity}, "
        f"'column', {column}, 'count', bigint({count}), 'description', {text})"
    )


def _per_column(prefix: str, type_: str, keep: str, severity: str, count: str, text: str) -> str:
    issue = _issue(f"concat('{prefix}_', c.name)", type_, severity, "c.name", count, text)
    return f"transform(filter(columns, c -> {keep}), c -> {issue})"


def issue_list() -> Column:
    """Array of issues in their fixed order, as one expression over the profile row.

    Order: missing, duplicates, inconsistent, outliers, empty; columns by position.
    """
    copies = "duplicate_row_count"
    duplicates = _issue(
        "'duplicate_rows'",
        "duplicate_rows",
        _severity(f"{copies} / row_count", DUPLICATE_HIGH, DUPLICATE_MEDIUM),
        "cast(null as string)",
        copies,
        f"concat({_grouped(copies, 'duplicate row')}, ' detected')",
    )
    parts = [
        _per_column(
            "missing",
            "missing_values",
            "c.missing_count > 0 and not c.is_empty",
            _severity("c.missing_count / row_count", MISSING_HIGH, MISSING_MEDIUM),
            "c.missing_count",
            f"concat({_grouped('c.missing_count', 'missing value')}, ' in `', c.name, '`')",
        ),
        # a filter on the row's own count would still evaluate the ratio of an empty table
        f"if({copies} > 0, array({duplicates}), array())",
        _per_column(
            "inconsistent",
            "inconsistent_values",
            "c.inconsistent_groups > 0",
            "'medium'",
            "c.inconsistent_spellings",
            f"concat('`', c.name, '` contains ', {_counted('c.inconsistent_groups', 'group')}, "
            "' of values that differ only in case or whitespace')",
        ),
        _per_column(
            "outliers",
            "potential_outliers",
            "c.outlier_count > 0",
            "'low'",
            "c.outlier_count",
            f"concat({_counted('c.outlier_count', 'potential outlier')}, ' detected in `', c.name, '`')",
        ),
        _per_column(
            "empty_column",
            "empty_column",
            "c.is_empty",
            "'medium'",
            "row_count",
            "concat('`', c.name, '` contains no values — the column is entirely empty')",
        ),
    ]
    return F.expr(f"concat({', '.join(parts)})")


def columns_of(profile: DataFrame) -> DataFrame:
    return profile.select("dataset", "row_count", F.explode("columns").alias("c")).select(
        "dataset", "row_count", "c.*"
    )


def issues_of(profile: DataFrame) -> DataFrame:
    """(dataset, ordinal, id, type, severity, column, count, description)."""
    return profile.select("dataset", F.posexplode("issues").alias("ordinal", "i")).select(
        "dataset", (F.col("ordinal") + 1).cast("bigint").alias("ordinal"), "i.*"
    )


def _rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def issues_ranked(issues: DataFrame, type_: str | None = None) -> DataFrame:
    """High before medium before low, otherwise in issue order; optionally one type."""
    kept = issues if type_ is None else issues.where(F.col("type") == type_)
    return kept.orderBy("dataset", _rank(F.col("severity")), "ordinal")


def issue_type_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("dataset", "type").agg(F.count("*").alias("n_issues"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Per type: total count and the affected columns in order (bounded by table width)."""
    named = F.sort_array(
        F.collect_list(F.when(F.col("column").isNotNull(), F.struct("ordinal", "column")))
    )
    return issues.groupBy("dataset", "type").agg(
        F.sum("count").alias("total_count"),
        F.transform(named, lambda s: s["column"]).alias("columns"),
    )


def problem_columns(profile: DataFrame, limit: int = PROBLEM_COLUMNS) -> DataFrame:
    """The first columns with missing or inconsistent values, per dataset."""
    bad = F.filter(
        "columns", lambda c: (c["missing_count"] > 0) | (c["inconsistent_groups"] > 0)
    )
    return profile.select("dataset", F.explode(F.slice(bad, 1, limit)).alias("c")).select(
        "dataset",
        F.col("c.ordinal").alias("ordinal"),
        F.col("c.name").alias("column"),
        F.col("c.missing_count").alias("missing_count"),
        F.col("c.inconsistent_groups").alias("inconsistent_groups"),
    )


def column_search(
    profile: DataFrame, text: str = "", type_: str | None = None, has_issue: bool | None = None
) -> DataFrame:
    """Columns by name part, inferred type and presence of an issue."""
    found = columns_of(profile)
    if text:
        found = found.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if type_:
        found = found.where(F.col("inferred_type") == type_)
    if has_issue is not None:
        named = issues_of(profile).where("column is not null").select("dataset", F.col("column").alias("name"))
        found = found.join(named, ["dataset", "name"], "left_semi" if has_issue else "left_anti")
    return found


def default_columns(profile: DataFrame, limit: int = DEFAULT_COLUMNS) -> DataFrame:
    """Columns to show at first: all if few, else those with issues first, by position."""
    named = F.transform("issues", lambda i: i["column"])
    keyed = F.transform(
        "columns",
        lambda c: F.struct(
            (~F.coalesce(F.array_contains(named, c["name"]), F.lit(False))).alias("no_issue"),
            c["ordinal"].alias("ordinal"),
            c["name"].alias("column"),
        ),
    )
    first = F.slice(F.array_sort(keyed), 1, limit)
    return profile.select("dataset", F.explode(first).alias("c")).select(
        "dataset", F.col("c.ordinal").alias("ordinal"), F.col("c.column").alias("column")
    )
