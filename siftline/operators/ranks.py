"""Exact values at given ranks, without sorting and without one big group.

The values are counted in buckets whose order agrees with theirs, and only the buckets that
hold a wanted rank are looked into:

1. coarse buckets from a fixed monotone function of the value;
2. a chosen bucket that still has many rows is cut into equal slices between its own ends,
   and so are its chosen slices, until each has few rows or one value;
3. the single values of what is left.

Each step is one map-side combined count over the data, joined with the few chosen
buckets (at most one per wanted rank, hence the safe broadcast). How often buckets are cut depends
on the data, the values found do not. The bucket functions depend on the values only, so a
task that runs again gives the same buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COARSE = 512  # coarse buckets per factor of e
SLICES = 4096
SET_ROWS = 100_000  # rows of a bucket below which its values are sorted as one set

# Ranks to look for are SQL text for an array<bigint> over `total` (and, where the
# list is long, `before` and `n`: the part of it that can fall in one bucket).


def probability_ranks(probs: list[float]) -> str:
    """Both neighbours of each interpolated position p * (total - 1)."""
    ps = ", ".join(f"{p!r}D" for p in probs)
    return (
        f"flatten(transform(array({ps}), p -> "
        "array(floor(p * (total - 1)), ceil(p * (total - 1)))))"
    )


def _found(ranks: str) -> str:
    return f"filter(array_distinct({ranks}), r -> r >= before and r < before + n)"


def _before(keys: list[str], order: str, base: str) -> str:
    part = ", ".join(keys)
    return (
        f"{base} + coalesce(sum(n) over (partition by {part} order by {order} "
        "rows between unbounded preceding and 1 preceding), 0) as before"
    )


def select_ranks(points: DataFrame, ranks: str, by: list[str], value: str = "x") -> DataFrame:
    """(by..., total, rank, value): the values at the wanted 0-based ranks.

    `points` has the columns `by`, `value` (bigint or double) and the weight `cnt`.
    """
    keys = ", ".join(by)
    coarse = f"floor(signum(double({value})) * log1p(abs(double({value}))) * {COARSE})"
    pts = points.selectExpr(*by, value, "cnt", f"{coarse} as b1")
    counts = ["sum(cnt) as n", "count(*) as rows", f"min({value}) as lo", f"max({value}) as hi"]
    chosen = (
        pts.groupBy(*by, "b1").agg(*map(F.expr, counts))
        .selectExpr("*", _before(by, "b1", "0"), f"sum(n) over (partition by {keys}) as total")
        .where(f"size({_found(ranks)}) > 0")
        .selectExpr(*by, "b1", "lo", "hi", "rows", "before as base", "total")
    )
    schema, todo, done = chosen.schema, chosen.collect(), []
    while True:
        done += [r for r in todo if r["rows"] <= SET_ROWS or r["lo"] == r["hi"]]
        todo = [r for r in todo if r["rows"] > SET_ROWS and r["lo"] < r["hi"]]
        if not todo:
            break
        at = f"least(floor(double({value} - lo) / double(hi - lo) * {SLICES}), {SLICES - 1})"
        inside = _inside(pts, todo, schema, by, value)
        sliced = inside.selectExpr(*by, "b1", "lo as from", f"int(if({value} = hi, {SLICES}, {at})) as b2", value, "cnt", "base", "total")
        todo = (
            sliced.groupBy(*by, "b1", "from", "b2")
            .agg(*map(F.expr, counts), F.expr("max(base) as base"), F.expr("max(total) as total"))
            .selectExpr("*", _before([*by, "b1", "`from`"], "b2", "base"))
            .where(f"size({_found(ranks)}) > 0")
            .selectExpr(*by, "b1", "lo", "hi", "rows", "before as base", "total")
            .collect()
        )
    return (
        _inside(pts, done, schema, by, value)
        .groupBy(*by, "b1", "lo", value)
        .agg(F.expr("sum(cnt) as n"), F.expr("max(base) as base"), F.expr("max(total) as total"))
        .selectExpr("*", _before([*by, "b1", "lo"], value, "base"))
        .selectExpr(*by, "total", f"explode({_found(ranks)}) as rank", value)
    )


def _inside(points: DataFrame, buckets: list, schema, by: list[str], value: str) -> DataFrame:
    """The points of the given buckets, with each one's ends, base and total."""
    table = points.sparkSession.createDataFrame(buckets, schema).drop("rows")
    return points.join(F.broadcast(table), [*by, "b1"]).where(f"{value} between lo and hi")


def quantiles(points: DataFrame, probs: dict[str, float]) -> DataFrame:
    """One row per column: `num_count` and one interpolated quantile per name in `probs`."""
    found = select_ranks(points, probability_ranks(list(probs.values())), ["column"])
    # at most two entries per probability
    per_column = found.groupBy("column").agg(
        F.expr("max(total) as num_count"),
        F.expr("map_from_entries(collect_list(struct(rank, x))) as at"),
    )
    interpolated = []
    for label, p in probs.items():
        pos = f"({p!r}D * (num_count - 1))"
        lo = f"try_element_at(at, floor({pos}))"
        hi = f"try_element_at(at, ceil({pos}))"
        interpolated.append(f"{lo} + ({hi} - {lo}) * ({pos} - floor({pos})) as {label}")
    return per_column.selectExpr("column", "num_count", *interpolated)


def fences(points: DataFrame, method: str = "interpolated") -> DataFrame:
    """Outlier bounds per column: values strictly outside `lower`..`upper` are outliers.

    Bounds are null when the column has fewer than four values or no spread.
    `method="floor_index"` takes the value at floor(n*p) in place of interpolating.
    """
    if method == "interpolated":
        return with_fences(quantiles(points, {"q1": 0.25, "q3": 0.75}))
    if method != "floor_index":
        raise ValueError(f"unknown outlier method {method!r}")
    ranks = "array(floor(total * 0.25D), floor(total * 0.75D))"
    found = select_ranks(points, ranks, ["column"])
    q = found.groupBy("column").agg(
        F.expr("max(total) as num_count"),
        F.expr("max(if(rank = floor(total * 0.25D), x, null)) as q1"),
        F.expr("max(if(rank = floor(total * 0.75D), x, null)) as q3"),
    )
    return with_fences(q)


def with_fences(q: DataFrame) -> DataFrame:
    """Add lower and upper bounds to a table with num_count, q1 and q3."""
    usable = "num_count >= 4 and q3 != q1"
    return q.selectExpr(
        "*",
        f"if({usable}, q1 - 1.5D * (q3 - q1), null) as lower",
        f"if({usable}, q3 + 1.5D * (q3 - q1), null) as upper",
    )
