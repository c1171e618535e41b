"""The cell table (column, value, cnt) that the profile operators read.

`cells` has one row per cell (cnt = 1) and costs no shuffle: use it for statistics
that only add up. `value_freq` has one row per distinct value: one shuffle with
map-side combine, after which every pattern runs once per distinct value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as rules
from .rowid import data_columns, name, text_columns


def cells(df: DataFrame, columns: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    columns = data_columns(df, columns, row_id)
    kept = [name(row_id).alias("row_id")] if row_id else []
    text = df.select(*kept, *text_columns(df, columns))
    ids = [F.col("row_id")] if row_id else []
    long = text.unpivot(ids, [name(c) for c in columns], "column", "value")
    return long.withColumn("cnt", F.lit(1).cast("bigint"))


def _native(df: DataFrame, column: str) -> Column:
    """A cell as it is counted: its own type where equal cells have equal texts, else text."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("millisecond", name(column))  # as far as the text goes
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return rules.stringify(name(column), dtype)
    return name(column)


def value_freq(df: DataFrame, columns: list[str] | None = None, row_id: str | None = None) -> DataFrame:
    """(column, value, cnt), plus first_row when a row id column is named.

    Columns of one type are counted together on their own values; text is made of the distinct
    values afterwards. Each type is one scan of its own columns.
    """
    columns = data_columns(df, columns, row_id)
    by_type: dict[str, list[str]] = {}
    keys = df.select(*[_native(df, c).alias(c) for c in columns]).schema
    for c in columns:
        by_type.setdefault(keys[c].dataType.simpleString(), []).append(c)
    aggs = [F.count(F.lit(1)).alias("cnt")]
    kept = [name(row_id).alias("_first")] if row_id else []
    if row_id:
        aggs.append(F.min("_first").alias("first_row"))
    parts = []
    for group in by_type.values():
        own = df.select(*kept, *[_native(df, c).alias(c) for c in group])
        ids = [F.col("_first")] if row_id else []
        counted = own.unpivot(ids, [name(c) for c in group], "column", "value").groupBy("column", "value").agg(*aggs)
        text = rules.stringify(F.col("value"), keys[group[0]].dataType)
        parts.append(counted.withColumn("value", text))
    return reduce(DataFrame.unionByName, parts)


#: Characters of a text above which it is counted by its digest.
LONG = 64


def text_key(c: Column) -> Column:
    """A short text itself; of a long one a mark and 128 bits, so that a key has at most LONG characters."""
    return F.when(F.length(c) > LONG, F.concat(F.lit("\0"), F.md5(c))).otherwise(c)


def value_keys(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The distinct values of `value_freq` with what each one is, in a table whose width no text determines.

    (column, value, cnt, facts, long, key, form, spelling): a long text is looked at before it is shuffled and
    counted by its key; `value` holds its start. `form` and `spelling` are the keys of its normal form and its trimmed
    text. Whoever needs a whole text asks for it with `long_texts`.
    """
    columns = data_columns(df, columns)
    texts = [c for c in columns if df.schema[c].dataType == T.StringType()]
    others = [c for c in columns if c not in texts]
    out = [*FACTS, "long", "key", "form", "spelling"]
    own_form, own_spelling = text_key(rules.normal_form(F.col("value"))), text_key(rules.js_trim(F.col("value")))
    parts = []
    if others:
        plain = classified(value_freq(df, others))
        whole = {"long": F.lit(False), "key": F.col("value"), "form": own_form, "spelling": own_spelling}
        parts.append(plain.withColumns(whole).select("column", "value", "cnt", *out))
    if texts:
        cell = df.select(*[name(c) for c in texts]).unpivot([], [name(c) for c in texts], "column", "value")
        keys = {"key": text_key(F.col("value")), "form": own_form, "spelling": own_spelling}
        short = cell.where(F.col("value").isNull() | (F.length("value") <= LONG)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
        parts.append(classified(short).withColumns({"long": F.lit(False), **keys, "key": F.col("value")}).select("column", "value", "cnt", *out))
        # a long text is looked at first and counted by what was found
        seen = classified(cell.where(F.length("value") > LONG)).withColumns({"long": F.lit(True), **keys})
        found = seen.select("column", F.substring("value", 1, LONG).alias("value"), *out)
        parts.append(found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("cnt")).select("column", "value", "cnt", *out))
    return reduce(DataFrame.unionByName, parts)


#: Keys up to which they are sent to all tasks.
SENT_KEYS = 100_000


def long_texts(df: DataFrame, keys: DataFrame, trimmed: bool = False) -> DataFrame:
    """(column, key, text) for the wanted (column, key) rows of a written table, by one more scan of their columns.

    Keys are those of whole texts, or of trimmed ones. Each task finds its own texts before any is shuffled.
    """
    wanted = keys.select("column", "key").distinct()
    columns = [r["column"] for r in wanted.select("column").distinct().collect()]
    if not columns:
        return wanted.withColumn("text", F.lit(None).cast("string"))
    cell = df.select(*[name(c) for c in columns]).unpivot([], [name(c) for c in columns], "column", "value").where(F.length("value") > LONG)
    text = rules.js_trim(F.col("value")) if trimmed else F.col("value")
    own = cell.select("column", text.alias("text")).withColumn("key", text_key(F.col("text")))
    side = F.broadcast(wanted) if wanted.limit(SENT_KEYS + 1).count() <= SENT_KEYS else wanted
    return own.join(side, ["column", "key"], "left_semi").groupBy("column", "key").agg(F.min("text").alias("text"))


def ordinal_of(columns: list[str]) -> Column:
    """1-based position of the `column` cell in the table's column list."""
    return F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))


FACTS = ["missing", "is_true", "is_false", "is_number", "is_date", "x", "ts"]


def classified(table: DataFrame) -> DataFrame:
    """Add what each cell is: missing, boolean, date, number, and its parsed values.

    A table that has been classified (and written) already is returned as it is. Each
    step's text is a column of its own, so that Spark computes it once per cell.
    """
    if set(FACTS) <= set(table.columns):
        return table
    words = table.withColumn("_t", rules.js_trim(F.col("value"))).withColumn(
        "_word", rules.short_lower(F.col("_t"))
    )
    seen = words.withColumn(
        "missing", F.col("value").isNull() | F.col("_word").isin(rules.MISSING_TOKENS)
    )
    text = F.when(~F.col("missing"), F.col("_t"))
    parsed = (
        seen.withColumn("_present", text)
        .withColumn("ts", rules.date_of_text(F.col("_present")))
        .withColumn("_x", rules.number_of_text(F.col("_present")))
    )
    return parsed.select(
        *table.columns,
        "missing",
        (~F.col("missing") & F.col("_word").isin(rules.TRUE_TOKENS)).alias("is_true"),
        (~F.col("missing") & F.col("_word").isin(rules.FALSE_TOKENS)).alias("is_false"),
        F.coalesce(rules.numeric_text(F.col("_present")), F.lit(False)).alias("is_number"),
        F.col("ts").isNotNull().alias("is_date"),
        rules.bounded(F.col("_x")).alias("x"),
        "ts",
    )


def numbers(table: DataFrame) -> DataFrame:
    """(column, x, cnt) for the cells that start with a number."""
    return classified(table).select("column", "x", "cnt").where("x is not null")


NUMERIC_KINDS = ("byte", "short", "integer", "long", "float", "double", "decimal")


def number(df: DataFrame, column: str) -> Column:
    """A cell's number. Numeric columns are read as they are, with no trip through text."""
    dtype = df.schema[column].dataType
    if dtype.typeName() in NUMERIC_KINDS:
        return rules.finite(name(column).cast("double"))
    return rules.parse_numeric(rules.stringify(name(column), dtype))


def typed_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, cnt) straight from the given columns."""
    texts = {c for c in columns if df.schema[c].dataType.typeName() not in NUMERIC_KINDS}
    trimmed = df.select(
        *[
            rules.js_trim(rules.stringify(name(c), df.schema[c].dataType)).alias(c)
            if c in texts
            else name(c).cast("double").alias(c)
            for c in columns
        ]
    )
    parsed = trimmed.select(
        *[rules.number_of_text(name(c)).alias(c) if c in texts else name(c) for c in columns]
    )
    long = parsed.unpivot([], [name(c) for c in columns], "column", "x")
    finite = long.select("column", rules.finite(F.col("x")).alias("x"))
    return finite.where("x is not null").withColumn("cnt", F.lit(1).cast("bigint"))
