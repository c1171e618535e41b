"""Chart-ready series: aggregate over all rows, return a bounded result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as rules
from . import ranks
from .freq import NUMERIC_KINDS
from .rowid import name

# Sizes of a chart.
MAX_CATEGORIES = 30
HISTOGRAM_BINS = 20
MAX_SCATTER_POINTS = 500

AGGREGATES = {
    "count": lambda y: F.count(y),
    "sum": lambda y: F.sum(y),
    "mean": lambda y: F.avg(y),
    "min": lambda y: F.min(y),
    "max": lambda y: F.max(y),
}


def _text(df: DataFrame, column: str) -> Column:
    return rules.stringify(name(column), df.schema[column].dataType)


def _with_numbers(df: DataFrame, numbers: dict[str, str], **keep: Column) -> DataFrame:
    """Select `keep` and, under the given names, columns as chart numbers.

    Trimming, parsing and the check for infinity are steps of their own, so that each
    text is trimmed and parsed once. Numeric columns are taken as they are.
    """
    typed = {a for a, c in numbers.items() if df.schema[c].dataType.typeName() in NUMERIC_KINDS}
    kept = list(keep)
    out = df.select(
        *[c.alias(a) for a, c in keep.items()],
        *[
            name(c).cast("double").alias(a) if a in typed else rules.js_trim(_text(df, c)).alias(a)
            for a, c in numbers.items()
        ],
    )
    out = out.select(
        *kept, *[F.col(a) if a in typed else rules.chart_number_of_text(F.col(a)).alias(a) for a in numbers]
    )
    return out.select(*kept, *[rules.finite(F.col(a)).alias(a) for a in numbers])


def _labelled(df: DataFrame, x: str, y: str | None, row_id: str | None) -> DataFrame:
    """(label, r, y) of the rows that have a label; without `y` each row counts as 1."""
    order = (name(row_id) if row_id else F.lit(0)).cast("bigint")
    out = _with_numbers(df, {"y": y} if y else {}, label=rules.js_trim(_text(df, x)), r=order)
    out = out if y else out.withColumn("y", F.lit(1.0))
    return out.where(~(F.col("label").isNull() | rules.short_lower(F.col("label")).isin(rules.MISSING_TOKENS)))


def group_aggregate(
    df: DataFrame, x: str, y: str | None = None, fn: str = "count", row_id: str | None = None
) -> DataFrame:
    """(label, value, first_row): rows with a label, grouped by its trimmed text.

    Without `y` each row counts as 1. A label with no valid `y` stays, with 0.
    """
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregation {fn!r}")
    return _labelled(df, x, y, row_id).groupBy("label").agg(
        F.coalesce(AGGREGATES[fn](F.col("y")).cast("double"), F.lit(0.0)).alias("value"),
        F.min("r").alias("first_row"),
    )


def top_categories(
    groups: DataFrame, other: str = "sum", df: DataFrame | None = None, x: str | None = None,
    y: str | None = None, fn: str = "count",
) -> DataFrame:
    """(position, label, value): all groups if at most 30, else the top 29 and "Other".

    Order: value descending, ties by first appearance. "Other" adds up the aggregates
    of the remaining groups. `other="recompute"` aggregates the remaining rows instead
    (give `df`, `x`, `y`, `fn`), which is the meaningful figure for mean, min and max.

    The top is a bounded top-k; no window over all groups.
    """
    order = [F.desc("value"), F.asc("first_row"), F.asc("label")]
    # 31 rows at most: the kept ones and the sign that there are more
    head = groups.orderBy(*order).limit(MAX_CATEGORIES + 1).agg(
        F.expr(
            "transform(array_sort(collect_list(struct(-value as v, first_row, label))), "
            "s -> struct(s.label as label, -s.v as value)) as t"
        )
    )
    kept = head.selectExpr(
        f"posexplode(if(size(t) > {MAX_CATEGORIES}, slice(t, 1, {MAX_CATEGORIES - 1}), t)) as (p, s)"
    ).selectExpr("bigint(p + 1) as position", "s.label as label", "s.value as value")
    rest_labels = (
        head.where(f"size(t) > {MAX_CATEGORIES}")
        .selectExpr(f"transform(slice(t, 1, {MAX_CATEGORIES - 1}), s -> s.label) as top")
    )
    top = rest_labels.scalar()
    # array_contains is null when there are at most 30 groups: nothing remains then
    if other == "recompute":
        remaining = _labelled(df, x, y, None).where(~F.array_contains(top, F.col("label")))
        total = AGGREGATES[fn](F.col("y")).cast("double")
    else:
        remaining = groups.where(~F.array_contains(top, F.col("label")))
        total = F.sum("value")
    rest = (
        remaining.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0.0)).alias("value"))
        .where("n > 0")
        .select(
            F.lit(MAX_CATEGORIES).cast("bigint").alias("position"),
            F.lit("Other").alias("label"),
            rules.round_half_up(F.col("value"), 2).alias("value"),
        )
    )
    return kept.unionByName(rest)


def y_label(y: str | None, fn: str) -> str:
    return f"{fn[:1].upper()}{fn[1:]} of {y}" if y else "Count"


def chart_bar(df: DataFrame, x: str, y: str | None, fn: str, row_id: str, other: str = "sum") -> DataFrame:
    groups = group_aggregate(df, x, y, fn, row_id)
    return top_categories(groups, other, df, x, y, fn).select(
        "position", "label", "value", F.lit(x).alias("x_label"), F.lit(y_label(y, fn)).alias("y_label")
    )


def chart_line(df: DataFrame, x: str, y: str | None, fn: str, row_id: str, other: str = "sum") -> DataFrame:
    """The bar series in label order. The cut to 30 comes first, as in the bar chart."""
    bars = chart_bar(df, x, y, fn, row_id, other)
    points = bars.agg(
        F.expr("array_sort(collect_list(struct(collate(label, 'UNICODE') as key, position, label, value))) as t")
    ).selectExpr("posexplode(t) as (p, s)")
    return points.select(
        (F.col("p") + 1).cast("bigint").alias("position"),
        F.col("s.label").alias("label"),
        F.col("s.value").alias("value"),
        F.lit(x).alias("x_label"),
        F.lit(y_label(y, fn)).alias("y_label"),
    )


def chart_histogram(df: DataFrame, x: str) -> DataFrame:
    """(bin, label, count): equal-width bins over the column's own range.

    Range and bin count are one row, read as a scalar subquery; the rows are then
    counted per bin, and empty bins are added from the sequence of bins.
    """
    # nulls are left to the aggregates: a filter on `v` would parse every cell twice
    values = _with_numbers(df, {"v": x})
    shape = (
        values.agg(F.expr("count(v) as n"), F.expr("min(v) as lo"), F.expr("max(v) as hi"))
        .selectExpr("*", f"if(hi > lo, int(least({HISTOGRAM_BINS}, ceil(sqrt(n)))), 1) as bins")
        .selectExpr("n", "lo", "hi", "bins", "(hi - lo) / bins as width")
    )
    s = shape.select(F.struct("lo", "hi", "bins", "width").alias("s")).scalar()
    counted = (
        values.select("v", s.alias("s"))
        # never null, or the join below would push a null check, parsing and all, to the scan
        .selectExpr("v", "coalesce(int(if(s.width > 0, least(floor((v - s.lo) / s.width), s.bins - 1), 0)), -1) as bin")
        .groupBy("bin")
        .agg(F.count("v").alias("count"))
    )
    all_bins = shape.where("n > 0").selectExpr(
        "*", "explode(sequence(0, bins - 1)) as bin"
    ).selectExpr("bin", "lo", "hi", "lo + bin * width as a", "lo + bin * width + width as b")

    def edge(c: Column) -> Column:
        whole = rules.number_text(c)
        return F.when(c % 1 == 0, whole).otherwise(rules.fixed_one(c))

    label = F.when(F.col("lo") == F.col("hi"), rules.number_text(F.col("lo"))).otherwise(
        F.concat(edge(F.col("a")), F.lit("–"), edge(F.col("b")))
    )
    # at most 20 bins on either side
    return all_bins.join(F.broadcast(counted), "bin", "left").select(
        F.col("bin").cast("bigint").alias("bin"),
        label.alias("label"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def chart_scatter(df: DataFrame, x: str, y: str | None, row_id: str) -> DataFrame:
    """(x, y) of all points if at most 500, else of 500 evenly spaced ones in row order.

    The sample's rows are found by rank among the valid points, so no row numbers are
    given out; the wanted ranks of a bucket are computed from its own range.
    """
    if y is None:
        return df.sparkSession.createDataFrame([], "row_id bigint, x double, y double")
    points = _with_numbers(
        df,
        {"x": x, "y": y},
        g=F.lit(0),
        row_id=name(row_id).cast("bigint"),
        cnt=F.lit(1).cast("bigint"),
    ).where("x is not null and y is not null")
    m = MAX_SCATTER_POINTS
    step = f"(total / {m}D)"
    near = (
        f"sequence(greatest(0L, bigint(floor(before / {step})) - 1), "
        f"greatest(0L, least({m - 1}L, bigint(ceil((before + n) / {step})) + 1)))"
    )
    wanted = f"transform({near}, i -> floor(i * {step}))"
    found = ranks.select_ranks(points, wanted, ["g"], "row_id").select("row_id")
    total = points.agg(F.count("*")).scalar()
    chosen = points.join(F.broadcast(found.distinct()), "row_id", "left_semi")
    sample = chosen.where(total > m)
    return points.where(total <= m).unionByName(sample).select("row_id", "x", "y")


def chart_donut(df: DataFrame, x: str, row_id: str) -> DataFrame:
    """(position, label, value, share): counts with top 29 and Other, and % of the total."""
    slices = top_categories(group_aggregate(df, x, None, "count", row_id))
    # 30 rows at most
    whole = slices.agg(F.sum("value").alias("whole"), F.expr("collect_list(struct(position, label, value)) as t"))
    return whole.select("whole", F.explode("t").alias("s")).select(
        "s.position", "s.label", "s.value", (F.col("s.value") / F.col("whole") * 100).alias("share")
    )


# Charts that suit a column type, best first.
RECOMMENDATIONS = [
    # type, rank, chart, label, default aggregation, needs a y column
    ("number", 1, "histogram", "Histogram", "count", False),
    ("number", 2, "bar", "Bar chart", "mean", False),
    ("text", 1, "donut", "Donut chart", "count", False),
    ("text", 2, "bar", "Bar chart", "count", False),
    ("boolean", 1, "donut", "Donut chart", "count", False),
    ("date", 1, "line", "Line chart", "count", False),
    ("date", 2, "bar", "Bar chart", "count", False),
    ("unknown", 1, "bar", "Bar chart", "count", False),
]
Y_CHARTS = ("scatter", "bar", "line")
AGGREGATION_LABELS = {"count": "Count", "sum": "Sum", "mean": "Average", "min": "Min", "max": "Max"}


def chart_recommendations(columns: DataFrame) -> DataFrame:
    """Suitable charts per (dataset, column) of the flat column profiles."""
    table = columns.sparkSession.createDataFrame(
        RECOMMENDATIONS,
        "inferred_type string, rank bigint, chart string, chart_label string, "
        "default_aggregation string, needs_y boolean",
    )
    return columns.select("dataset", "ordinal", F.col("name").alias("column"), "inferred_type").join(
        F.broadcast(table), "inferred_type"
    )


def y_candidates(columns: DataFrame, chart: str, x: str) -> DataFrame:
    """Number columns that can go on the y axis of a chart."""
    named = columns.select("dataset", "ordinal", F.col("name").alias("column"), "inferred_type")
    if chart not in Y_CHARTS:
        return named.where(F.lit(False)).drop("inferred_type")
    return named.where((F.col("column") != x) & (F.col("inferred_type") == "number")).drop("inferred_type")


def available_aggregations(chart: str, has_y: bool) -> list[str]:
    return ["sum", "mean", "min", "max"] if chart in ("bar", "line") and has_y else ["count"]


def default_chart_column(columns: DataFrame) -> DataFrame:
    """Per dataset the first column with any value, else the first column."""
    pick = F.min(F.struct((F.col("total_values") == 0).alias("empty"), "ordinal", "name"))
    return columns.groupBy("dataset").agg(pick.alias("c")).select("dataset", F.col("c.name").alias("column"))


@dataclass(frozen=True)
class ChartRequest:
    """What to draw: a chart kind over columns, of the data as loaded or as cleaned."""

    chart: str
    x: str
    y: str | None = None
    aggregation: str = "count"
    cleaned: bool = False

    def __post_init__(self):
        if self.chart not in CHARTS:
            raise ValueError(f"unknown chart {self.chart!r}")
        if self.aggregation not in AGGREGATES:
            raise ValueError(f"unknown aggregation {self.aggregation!r}")


CHARTS = {
    "bar": lambda df, r, row_id: chart_bar(df, r.x, r.y, r.aggregation, row_id),
    "line": lambda df, r, row_id: chart_line(df, r.x, r.y, r.aggregation, row_id),
    "histogram": lambda df, r, row_id: chart_histogram(df, r.x),
    "scatter": lambda df, r, row_id: chart_scatter(df, r.x, r.y, row_id),
    "donut": lambda df, r, row_id: chart_donut(df, r.x, row_id),
}


def draw(request: ChartRequest, original: DataFrame, cleaned: DataFrame | None, row_id: str) -> DataFrame:
    """The series of a request, in the form of its chart kind."""
    if request.cleaned and cleaned is None:
        raise ValueError("the request is for cleaned data, of which there is none")
    return CHARTS[request.chart](cleaned if request.cleaned else original, request, row_id)


def default_request(column: str, inferred_type: str) -> ChartRequest:
    """The first recommendation for the column's type."""
    kinds = {t: (chart, fn) for t, rank, chart, _, fn, _ in RECOMMENDATIONS if rank == 1}
    chart, fn = kinds.get(inferred_type, kinds["unknown"])
    return ChartRequest(chart, column, None, fn)
