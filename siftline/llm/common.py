"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, new_path

__all__ = [
    "NO_ID", "WORD_SPACE", "base32_sha1", "dense_slots", "free_names", "let", "materialize", "new_path", "numbered", "own_id", "table", "words",
]

#: The six characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: A null doc_id on its way through Python, where a null would turn the ids beside it into floats.
NO_ID = -(1 << 63)


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long that is never null, and the given columns."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), *columns)


def own_id(column: str = "doc_id") -> Column:
    """The doc_id that `numbered` was given."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, as an array: maximal runs of anything but WORD_SPACE. Null: no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE[1:], " " * (len(WORD_SPACE) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of SHA-1: 40 bits at a time, each eight digits."""
    digest = F.sha1(content)
    digits = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(
        F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def dense_slots(df: DataFrame, group: list[str], spread: list[str], rows: int, out: str, cell_rows: int = 20_000) -> DataFrame:
    """Number the rows of every group from 0 without gaps, in no particular order.

    A group may hold any share of the `rows` rows, so each is cut into cells by a hash of
    `spread`; a cell is numbered by a window, the cells' starts come from running sums over
    their counts, and both are joined on (group, cell), which is how the rows are dealt already.
    """
    cells = max(1, -(-rows // cell_rows))
    cell, at = free_names(df, "cell", "at")
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*spread), F.lit(cells)))
    counts = dealt.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(at))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.withColumn(at, F.coalesce(F.sum(at).over(before), F.lit(0))), "slots")
    inside = Window.partitionBy(*group, cell).orderBy(*spread)
    numbered = dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1)
    return (
        numbered.join(starts, [*group, cell], "inner")
        .withColumn(out, F.col(out) + F.col(at))
        .drop(cell, at)
    )
