"""

Every query runs over the whole given tables, or over data Spark derives from them.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle as o  # noqa: E402
from siftline.functions import cells as rules  # noqa: E402
from siftline.operators import charts, clean, dedup, freq, preview, rows, stats  # noqa: E402
from siftline.plans import issues, planner, suggest  # noqa: E402
from siftline.plans import recipe as recipes  # noqa: E402
from siftline.plans.profile import NUMERIC_FIELDS, Profiler  # noqa: E402
from siftline.session import DEFAULTS, materialize, new_path  # noqa: E402
from siftline.sources import csv as csv_source  # noqa: E402
from siftline.sources import registry, summary  # noqa: E402

try:  # the training-data operators are an optional part
    import corpus_pipeline
    from siftline.llm import registry as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "siftline.llm"):
        raise
    llm = None

ROW = "row_id"
ENTRY_DIR = "/root/testdata/sf0.001"

Query = Callable[[SparkSession, str], DataFrame]

# --- inputs ---------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", DEFAULTS["spark.sql.session.timeZone"])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    text = sql.replace("{", "{{").replace("}", "}}").replace(f"from {table}", "from {t}")
    return spark.sql(text, t=_table(spark, sf_dir, table))


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "orders", o.MESSY)


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "customer", o.REPLIES)


def _profiler(spark: SparkSession, sf_dir: str) -> Profiler:
    return Profiler(_messy(spark, sf_dir), "messy_orders", row_id=ROW)


def _on_messy(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_messy(spark, sf_dir))


def _on_profiler(make: Callable[[Profiler], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_profiler(spark, sf_dir))


def _on_profile(make: Callable[[DataFrame], DataFrame]) -> Query:
    """On the one-row profile, written once because most callers read it twice."""
    return lambda spark, sf_dir: make(_profiler(spark, sf_dir).profile)


def _on_events(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(_table(spark, sf_dir, "events"))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _placed(ordered: DataFrame) -> DataFrame:
    """A few ordered rows with their position, so that a comparison sees the order."""
    place = F.posexplode("rows").alias("position", "row")
    listed = ordered.agg(F.collect_list(F.struct(*ordered.columns)).alias("rows")).select(place)
    return listed.select("row.*", (F.col("position") + 1).cast("bigint").alias("position"))


STEPS = [
    recipes.Step("remove_duplicates", config={"keep": "first"}, id="s1", description="Remove duplicate rows"),
    recipes.Step("fill_missing", "total", {"strategy": "median"}, "s2", "Fill total"),
    recipes.Step("normalize_text", "priority", {"normalizations": ["trim", "titlecase"]}, "s3", "Normalise priority"),
    recipes.Step("convert_type", "order_date", {"target_type": "date"}, "s4", "Convert order_date"),
    recipes.Step("convert_type", "filled", {"target_type": "boolean"}, "s5", "Convert filled"),
    recipes.Step("remove_outlier_rows", "total", {}, "s6", "Remove outliers of total"),
    recipes.Step("remove_column", "notes", {}, "s7", "Remove notes"),
]
# --- sources --------------------------------------------------------------------------------


def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: the messy orders written as CSV files and read back."""
    path = new_path(spark, "csv")
    csv_source.write_csv(_messy(spark, sf_dir), path, o.COLUMNS)
    return csv_source.read_csv(spark, path, multiline=False)


def read_csv_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files are parted by commas, semicolons, tabs and bars, with the other signs inside cells."""
    path, orders = new_path(spark, "delimiters"), _table(spark, sf_dir, "orders")
    for i, (name, d) in enumerate((("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("bar", "|"))):
        said = f"concat_ws('{d}', o_orderkey, concat('\"', o_orderpriority, ';,|', '\"'), o_orderstatus)"
        _csv_texts(orders.where(f"o_orderkey % 4 = {i}"), f"{path}/{name}", d.join(("key", "priority", "status")) + "\r\n", said)
    return csv_source.read_csv(spark, f"{path}/*", multiline=False)


def read_csv_multiline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line breaks in their texts, written as CSV and read in splits of 1 MB."""
    path = new_path(spark, "multiline")
    csv_source.write_csv(_table(spark, sf_dir, "documents"), path, ["doc_id", "text", "lang"], sep_line=False)
    key, size = "spark.sql.files.maxPartitionBytes", 1 << 20
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:  # the lines are written when this returns
        return csv_source.read_csv(spark, path)
    finally:
        spark.conf.set(key, before)


def csv_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as parts of one ordered file, and what the parts say when they are put together by name."""
    path = new_path(spark, "ordered")
    items = _table(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    manifest = csv_source.write_csv_in_order(items, path, "row", ["l_orderkey", "l_linenumber", "l_returnflag"], parts=6)
    lines = spark.read.option("lineSep", "\r\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("row", F.expr("try_cast(split(value, ',')[0] as bigint) * 10 + try_cast(split(value, ',')[1] as bigint)"))
    per_part = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.count_if(F.col("value").contains("l_returnflag")).alias("heads")
    )
    by_name = Window.orderBy("file")  # a row per part
    parts = per_part.withColumn("ok", F.coalesce(F.lag("high").over(by_name) < F.col("low"), F.lit(True)))
    ends = manifest.withColumn("ok", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(Window.orderBy("part")), F.lit(0)) == F.col("offset"))
    return parts.agg(
        F.sum("n").alias("lines"), F.sum("heads").alias("headers"), F.min("ok").alias("in_order"), F.count(F.lit(1)).alias("parts")
    ).join(ends.agg(F.sum("length").alias("bytes"), F.min("ok").alias("contiguous")))


def conform_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are shorter or wider than the header, in files with a trailing delimiter."""
    path = new_path(spark, "ragged")
    lines = _derived(spark, sf_dir, "orders", o.RAGGED)
    header = "order_id, status ,priority,"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.select(
        F.when(first, F.concat(F.lit(header + "\n"), "value")).otherwise(F.col("value")).alias("value")
    ).write.text(path)
    return csv_source.read_csv(spark, path, multiline=False)


def validate_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "load")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    _with_rows(orders).write.option("header", True).csv(path)
    return (
        csv_source.validate_load(spark, path, multiline=False)
        .where(F.col("file").rlike(r"\.csv$"))
        .groupBy("ok")
        .agg(F.sum("row_count").alias("row_count"))
    )


def _with_rows(df: DataFrame) -> DataFrame:
    """The rows dealt so that no file is written without one: a scan's first split may hold no row group, and
    Spark writes a file for the first partition whether it has rows or not."""
    return df.hint("rebalance")


def _csv_texts(df: DataFrame, path: str, head: str, lines: str) -> None:
    """Append CSV files to a folder: `head` before the first line of each."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    line = F.expr(lines)
    _with_rows(df).select(F.when(first, F.concat(F.lit(head), line)).otherwise(line).alias("value")).write.mode("append").option(
        "lineSep", "\r\n"
    ).text(path)


def read_csv_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder whose files have different columns, one kind with a `sep=` line, and rows that equal a header."""
    path, orders = new_path(spark, "mixed"), _table(spark, sf_dir, "orders")
    _csv_texts(
        orders.where("o_orderkey % 2 = 0"), path, "sep=,\r\nkey, status \r\n",
        "if(o_orderkey % 50 = 0, 'key,status', concat(o_orderkey, ',', o_orderstatus))",
    )
    _csv_texts(
        orders.where("o_orderkey % 2 = 1"), path, "priority,key,total,\r\n",
        "concat(o_orderpriority, ',', o_orderkey, ',', cast(o_totalprice as decimal(18,2)))",
    )
    return csv_source.read_csv(spark, path, multiline=False, union=True)


def validate_load_bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files beside the orders that have no rows, line ends only, an open quote, or another extension."""
    path, orders = new_path(spark, "bad"), _table(spark, sf_dir, "orders")
    _csv_texts(orders, f"{path}/good.csv", "sep=,\r\nkey,status\r\n", "concat(o_orderkey, ',', o_orderstatus)")
    for name, text in (("bare.csv", "a,b"), ("blank.csv", "\n\n"), ("open.csv", 'a,b\n"1,2'), ("other.txt", "a\n1")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/{name}")
    # the sink names its files .txt, so only the last folder is held to .csv
    checked = [
        csv_source.validate_load(
            spark, f"{path}/{name}/part-*", multiline=False, extensions=("csv",) if name == "other.txt" else ("csv", "txt")
        )
        for name in ("good.csv", "bare.csv", "blank.csv", "open.csv", "other.txt")
    ]
    kind = F.regexp_extract("file", r"/(\w+\.\w+)/[^/]*$", 1)
    return reduce(DataFrame.unionByName, checked).groupBy(kind.alias("kind"), "ok", "error").agg(F.sum("row_count").alias("row_count"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_source.csv_lines(_table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole recipe's report, written as JSON and read back; each step counted on its own version."""
    original = _messy(spark, sf_dir)
    cleaned, steps = planner.counted_recipe(original, STEPS, ROW)
    before, after = (materialize(Profiler(df, "messy_orders", row_id=ROW).score(), "score") for df in (original, cleaned))
    report = summary.cleaning_summary(before, after, recipes.recipe_table(spark, steps))
    path = new_path(spark, "summary")
    summary.write_summary(report, path, "2026-01-01T00:00:00Z")
    stored = spark.read.schema(report.schema).json(path)
    return stored.select("dataset", "quality", F.explode("operations").alias("op")).select(
        "dataset.name", "dataset.rows_before", "dataset.rows_after", "dataset.columns",
        F.col("quality.before").alias("score_before"), F.col("quality.after").alias("score_after"),
        "op.step", "op.type", "op.column", "op.affected_count",
    )


def load_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.load_registry(_derived(spark, sf_dir, "orders", o.LOADS))


# --- cell functions ---------------------------------------------------------------------------


def cell_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell functions over the messy orders' texts."""
    c, p, t, d, f = F.col, F.col("priority"), F.col("total"), F.col("order_date"), F.col("filled")
    return _messy(spark, sf_dir).select(
        ROW,
        rules.is_missing(t).alias("missing"),
        F.coalesce(rules.looks_numeric(t), F.lit(False)).alias("numeric_like"),
        F.coalesce(rules.looks_boolean(f), F.lit(False)).alias("boolean_like"),
        rules.looks_date(d).alias("date_like"),
        rules.parse_numeric(t).alias("number"),
        rules.chart_number(t).alias("chart_number"),
        rules.normal_form(p).alias("normal_form"),
        rules.title_case(p).alias("title_case"),
        rules.to_iso_date(d).alias("iso_date"),
        rules.to_bool_token(f).alias("bool_token"),
        rules.number_text(rules.parse_numeric(t)).alias("number_text"),
        rules.round_half_up(rules.parse_numeric(t) / -8, 1).alias("rounded"),
    )


# --- profile ----------------------------------------------------------------------------------


def value_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freq.value_freq(_messy(spark, sf_dir), o.COLUMNS, ROW)


def _cells(df: DataFrame) -> DataFrame:
    return freq.cells(df, o.COLUMNS)


NUMERIC_DIGITS = {
    "sum": 2, "mean": 4, "median": 4, "min": 4, "max": 4, "range": 4, "q1": 4, "q3": 4, "iqr": 4,
    "variance": -4, "std_dev": 4, "p10": 4, "p90": 4, "p95": 4, "p99": 4,
}
PERCENT = {"percentage": 4, "true_percentage": 4, "false_percentage": 4}


def column_profile(p: Profiler) -> DataFrame:
    """The per-column profile, flattened to plain columns."""
    flat = p.column_profile().select(
        "ordinal", "name", "inferred_type", "total_values", "missing_count", "unique_count",
        F.round("unique_ratio", 4).alias("unique_ratio"), "is_empty",
        F.round("numeric_stats.mean", 4).alias("mean"), F.round("numeric_stats.median", 4).alias("median"),
        F.round("numeric_stats.std_dev", 4).alias("std_dev"), F.round("numeric_stats.p99", 4).alias("p99"),
        F.col("date_stats.earliest").alias("earliest"), F.col("date_stats.latest").alias("latest"),
        F.col("categorical_stats.top_values")[0]["value"].alias("mode"),
        F.col("categorical_stats.n_modes").alias("n_modes"),
        F.col("boolean_stats.true_count").alias("true_count"),
        "inconsistent_groups", "inconsistent_spellings", "outlier_count",
    )
    return flat


def _typed_profile(table: str) -> Query:
    """The profile of a table of numbers, timestamps and texts."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Profiler(_table(spark, sf_dir, table), table).column_profile().select(
            "ordinal", "name", "inferred_type", "total_values", "missing_count", "unique_count",
            F.round("numeric_stats.mean", 4).alias("mean"), F.round("numeric_stats.median", 4).alias("median"),
            F.round("numeric_stats.p99", 4).alias("p99"), F.col("date_stats.earliest").alias("earliest"),
            F.col("date_stats.latest").alias("latest"), "outlier_count",
        )

    return query


def _documents_profiler(spark: SparkSession, sf_dir: str) -> Profiler:
    """Every document's text twice, once with capital A's: long texts that are spelled in two ways."""
    docs = _table(spark, sf_dir, "documents").select("text", "lang")
    return Profiler(docs.unionByName(docs.withColumn("text", F.translate("text", "a", "A"))), "documents")


def top_values_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top values of whole texts of any length, which are counted by digest."""
    return _rounded(_documents_profiler(spark, sf_dir).top_values(), PERCENT)


def inconsistent_groups_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_profiler(spark, sf_dir).inconsistent_groups()


def dataset_profile(p: DataFrame) -> DataFrame:
    return p.select(
        "dataset", "row_count", "column_count", "incomplete_row_count", "duplicate_row_count",
        "empty_column_count", "total_missing", "quality_score", "score_label",
    )


def fill_type_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fill_type_hint(_messy(spark, sf_dir), o.COLUMNS, ROW)


def issue_rollup(p: DataFrame) -> DataFrame:
    rolled = issues.issue_rollup(issues.issues_of(p))
    return rolled.select("type", "total_count", F.array_join("columns", ",").alias("columns"))


# --- rows, cleaning, charts ---------------------------------------------------------------------


def _flags(p: Profiler) -> DataFrame:
    return rows.row_flags(p.df, p, ROW)


def _flagged(issue_type: str) -> Query:
    return _on_profiler(lambda p: rows.rows_with(p.df, p, ROW, issue_type))


def remove_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop, by id, the messy orders that the orders table marks as pending."""
    pending = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return clean.remove_rows(_messy(spark, sf_dir), pending, ROW)


def _titled(df: DataFrame) -> DataFrame:
    return clean.normalize_text(df, "priority", ["trim", "titlecase"])


def cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _messy(spark, sf_dir)
    return rows.cell_diff(before, recipes.apply_recipe(before, STEPS, ROW), ROW)


def _events_by_user(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value")


def _messy_group(fn: str) -> Query:
    return _on_messy(
        lambda df: charts.group_aggregate(df, "priority", "total", fn, ROW).select(
            "label", F.round("value", 2).alias("value"), "first_row"
        )
    )


# --- suggestions ----------------------------------------------------------------------------------

PAYLOAD_SCHEMA = (
    "rowCount bigint, qualityScore bigint, columns array<struct<name string, type string, missing bigint, "
    "unique bigint, uniqueRatio double, mean double, stdDev double, iqr double, mode string, modeCount bigint, "
    "earliest string, inconsistentGroupCount bigint>>"
)


def profile_payload(p: DataFrame) -> DataFrame:
    """The JSON payload, read back: one row per column."""
    parsed = suggest.profile_payload(p).select(F.from_json("payload", PAYLOAD_SCHEMA).alias("j"))
    return parsed.select("j.rowCount", "j.qualityScore", F.explode("j.columns").alias("c")).select(
        F.col("rowCount").alias("row_count"), F.col("qualityScore").alias("quality_score"),
        F.col("c.name").alias("name"), F.col("c.type").alias("type"), F.col("c.missing").alias("missing"),
        F.col("c.unique").alias("unique_count"), F.col("c.uniqueRatio").alias("unique_ratio"),
        F.col("c.mean").alias("mean"), F.col("c.stdDev").alias("std_dev"), F.col("c.iqr").alias("iqr"),
        F.col("c.mode").alias("mode"), F.col("c.modeCount").alias("mode_count"),
        F.col("c.earliest").alias("earliest"), F.col("c.inconsistentGroupCount").alias("inconsistent_groups"),
    )


def parse_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.parse_suggestions(_replies(spark, sf_dir), ["dataset", "reply_id"])


def parse_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.parse_insights(_replies(spark, sf_dir), ["dataset", "reply_id"])


def reply_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.reply_status(_replies(spark, sf_dir), ["dataset", "reply_id"])


def map_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _profiler(spark, sf_dir).profile
    mapped = suggest.map_suggestions(parse_suggestions(spark, sf_dir), profile)
    return mapped.select(
        "dataset", "reply_id", "id", "operation", "step_type", "step_column", "setting", "description", "affected_count"
    )


def apply_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first suggestion of each kind, accepted while it is fresh and applied to the data."""
    df = _messy(spark, sf_dir)
    now = suggest.fingerprint(df, "messy_orders", "2026-01-01T00:00:00Z", [], ROW).select("dataset", "fingerprint", "content")
    now = materialize(now, "now")
    mapped = materialize(suggest.map_suggestions(parse_suggestions(spark, sf_dir), _profiler(spark, sf_dir).profile), "mapped")
    first = mapped.where("step_type is not null").groupBy("step_type").agg(F.min("reply_id").alias("reply_id"))
    stored = mapped.join(first, ["step_type", "reply_id"]).join(now, "dataset")
    return recipes.apply_recipe(df, suggest.accepted_steps(stored, now, "reply_id"), ROW)


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.fingerprint(_messy(spark, sf_dir), "messy_orders", "2026-01-01T00:00:00Z", ["s1", "s2"], ROW)


# --- the contract -----------------------------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Full column profile of the messy orders."""
    return column_profile(_profiler(spark, ENTRY_DIR))


def queries() -> dict[str, Query]:
    return {
        "read_csv": read_csv,
        "read_csv_delimiters": read_csv_delimiters,
        "read_csv_multiline_split": read_csv_multiline_split,
        "csv_in_order": csv_in_order,
        "conform_rows": conform_rows,
        "validate_load": validate_load,
        "read_csv_mixed_headers": read_csv_mixed_headers,
        "validate_load_bad_files": validate_load_bad_files,
        "csv_lines": csv_lines,
        "cleaning_summary": cleaning_summary,
        "load_registry": load_registry,
        "cell_functions": cell_functions,
        "value_freq": value_freq,
        "column_profile_lineitem": _typed_profile("lineitem"),
        "column_profile_events": _typed_profile("events"),
        "missing_counts": _on_messy(lambda df: stats.missing_counts(_cells(df))),
        "infer_types": _on_messy(lambda df: stats.infer_types(_cells(df))),
        "unique_counts": _on_messy(
            lambda df: _rounded(stats.unique_counts(freq.value_freq(df, o.COLUMNS)), {"unique_ratio": 4})
        ),
        "numeric_stats": _on_profiler(lambda p: _rounded(p.numeric_stats().drop("outlier_count"), NUMERIC_DIGITS)),
        "percentiles": _on_profiler(lambda p: _rounded(p.percentiles(), NUMERIC_DIGITS)),
        "percentiles_by_rank": _on_profiler(
            lambda p: _rounded(stats.percentiles(p.values, p.counters), NUMERIC_DIGITS)
        ),
        "outlier_counts": _on_profiler(lambda p: p.outlier_counts()),
        "outlier_counts_floor_index": _on_profiler(lambda p: p.outlier_counts("floor_index")),
        "date_stats": _on_messy(lambda df: stats.date_stats(stats.column_counters(_cells(df)))),
        "top_values": _on_profiler(lambda p: _rounded(p.top_values(), PERCENT)),
        "top_values_documents": top_values_documents,
        "inconsistent_groups_documents": inconsistent_groups_documents,
        "modes": _on_profiler(lambda p: _rounded(p.modes(), PERCENT)),
        "boolean_stats": _on_messy(
            lambda df: _rounded(stats.boolean_stats(stats.column_counters(_cells(df))), PERCENT)
        ),
        "inconsistent_groups": _on_profiler(lambda p: p.inconsistent_groups()),
        "duplicate_row_count": _on_messy(lambda df: dedup.duplicate_row_count(df, o.COLUMNS)),
        "incomplete_rows": _on_messy(lambda df: stats.incomplete_rows(df, o.COLUMNS)),
        "empty_columns": _on_messy(lambda df: stats.empty_columns(_cells(df))),
        "column_profile": _on_profiler(column_profile),
        "dataset_profile": _on_profile(dataset_profile),
        "completeness": _on_messy(lambda df: stats.completeness(_cells(df))),
        "type_summary": _on_messy(lambda df: _placed(stats.type_summary(stats.column_counters(_cells(df))))),
        "fill_type_hint": fill_type_hint,
        "issues": _on_profile(lambda p: issues.issues_of(p).drop("dataset")),
        "issues_ranked": _on_profile(lambda p: _placed(issues.issues_ranked(issues.issues_of(p)).select("id", "severity"))),
        "issues_ranked_outliers": _on_profile(
            lambda p: _placed(issues.issues_ranked(issues.issues_of(p), "potential_outliers").select("id", "severity"))
        ),
        "issue_type_counts": _on_profile(lambda p: issues.issue_type_counts(issues.issues_of(p)).drop("dataset")),
        "issue_rollup": _on_profile(issue_rollup),
        "quality_score": _on_profile(lambda p: p.select("dataset", "quality_score", "score_label")),
        "problem_columns": _on_profile(lambda p: issues.problem_columns(p).drop("dataset")),
        "column_search": _on_profile(
            lambda p: issues.column_search(p, "OR", None, True).select("ordinal", "name", "inferred_type")
        ),
        "column_search_numbers": _on_profile(
            lambda p: issues.column_search(p, "", "number", None).select("ordinal", "name", "inferred_type")
        ),
        "column_search_clean": _on_profile(
            lambda p: issues.column_search(p, "", None, False).select("ordinal", "name", "inferred_type")
        ),
        "dedup_first": _on_messy(lambda df: dedup.remove_duplicates(df, ROW)),
        "dedup_last": _on_messy(lambda df: dedup.remove_duplicates(df, ROW, keep="last")),
        "fill_constant": _on_messy(lambda df: clean.fill_missing(df, "priority", "Unknown")),
        "fill_mean": _on_messy(lambda df: clean.fill_with_mean(df, "total")),
        "fill_median": _on_messy(lambda df: clean.fill_with_median(df, "total")),
        "normalize_text": _on_messy(lambda df: clean.normalize_text(df, "priority", ["trim", "titlecase"])),
        "convert_number": _on_messy(lambda df: clean.convert_type(df, "total", "number")),
        "convert_date": _on_messy(lambda df: clean.convert_type(df, "order_date", "date")),
        "convert_boolean": _on_messy(lambda df: clean.convert_type(df, "filled", "boolean")),
        "convert_typed": _on_messy(lambda df: clean.convert_typed(df, "total", "number", "rejected")),
        "remove_outliers": _on_messy(lambda df: clean.remove_outliers(df, "total")),
        "remove_outliers_typed": _on_events(
            lambda df: clean.remove_outliers(df, "value").select("event_id", "value")
        ),
        "remove_rows": remove_rows,
        "remove_column": _on_messy(lambda df: clean.remove_column(df, "notes")),
        "apply_recipe": _on_messy(lambda df: recipes.apply_recipe(df, STEPS, ROW)),
        "recipe_undo": _on_messy(lambda df: recipes.apply_recipe(df, recipes.undo(recipes.undo(STEPS)), ROW)),
        "preview_duplicates": _on_messy(lambda df: preview.preview_duplicates(df, ROW)),
        "preview_fill": _on_messy(lambda df: preview.preview_fill(df, "total", "0", ROW)),
        "preview_normalize": _on_messy(
            lambda df: preview.preview_normalize(df, "priority", ["trim", "lowercase"], ROW)
        ),
        "preview_outliers": _on_messy(lambda df: preview.preview_outliers(df, "total", ROW)),
        "row_flags": _on_profiler(_flags),
        "rows_with_missing": _flagged("missing_values"),
        "rows_duplicate": _flagged("duplicate_rows"),
        "rows_inconsistent": _flagged("inconsistent_values"),
        "rows_outlier": _flagged("potential_outliers"),
        "find_page": _on_profiler(lambda p: rows.find_page(p.df, p, ROW, "missing_values", "urgent", page=3, size=25)),
        "any_issue_count": _on_profiler(lambda p: rows.any_issue_count(_flags(p))),
        "search_rows": _on_messy(lambda df: rows.search_rows(df, " Urgent ", o.COLUMNS)),
        "page_rows": _on_messy(lambda df: rows.page_rows(df, ROW, page=7, size=50)),
        "page_rows_past_end": _on_messy(lambda df: rows.page_rows(df, ROW, page=10**9, size=100)),
        "cell_diff": cell_diff,
        "default_columns": _on_profile(lambda p: issues.default_columns(p, 4).select("ordinal", "column")),
        **{f"group_{fn}": _messy_group(fn) for fn in charts.AGGREGATES},
        "top_categories": _on_events(
            lambda df: _rounded(
                charts.top_categories(
                    charts.group_aggregate(_events_by_user(df), "user_id", "value", "sum", "event_id")
                ),
                {"value": 2},
            )
        ),
        "top_categories_recompute": _on_events(
            lambda df: _rounded(
                charts.chart_bar(_events_by_user(df), "user_id", "value", "mean", "event_id", "recompute"), {"value": 2}
            )
        ),
        "chart_bar": _on_events(
            lambda df: _rounded(charts.chart_bar(df, "event_type", "value", "mean", "event_id"), {"value": 4})
        ),
        "chart_line": _on_messy(lambda df: charts.chart_line(df, "order_date", None, "count", ROW)),
        "chart_histogram": _on_events(lambda df: charts.chart_histogram(df, "value")),
        "chart_histogram_text": _on_messy(lambda df: charts.chart_histogram(df, "total")),
        "chart_scatter": _on_events(lambda df: charts.chart_scatter(df, "event_id", "value", "event_id")),
        "chart_donut": _on_messy(lambda df: _rounded(charts.chart_donut(df, "priority", ROW), {"share": 4})),
        "chart_request": _on_messy(
            lambda df: _rounded(
                charts.draw(charts.ChartRequest("bar", "priority", "total", "sum", cleaned=True), df, _titled(df), ROW).drop("x_label", "y_label"),
                {"value": 2},
            )
        ),
        "chart_recommendations": _on_profile(lambda p: charts.chart_recommendations(issues.columns_of(p)).drop("dataset")),
        "y_candidates": _on_profile(lambda p: charts.y_candidates(issues.columns_of(p), "bar", "order_id").drop("dataset")),
        "default_chart_column": _on_profile(lambda p: charts.default_chart_column(issues.columns_of(p))),
        "profile_payload": _on_profile(profile_payload),
        "parse_suggestions": parse_suggestions,
        "parse_insights": parse_insights,
        "reply_status": reply_status,
        "map_suggestions": map_suggestions,
        "apply_suggestions": apply_suggestions,
        "fingerprint": fingerprint,
        **(llm.QUERIES | {"pipeline": corpus_pipeline.run} if llm else {}),
    }


def _share(part: str, whole: str) -> str:
    return f"round({part} / {whole} * 100, 4)"


def _oracle_sources() -> dict[str, str]:
    filled = ", ".join(f"coalesce({c}, '') as {c}" for c in o.COLUMNS)
    doc_cells = ["cast(doc_id as varchar)", "text", "lang", "source", "cast(n_chars as varchar)"]
    quoted = " || ',' || ".join(
        f"case when regexp_matches(coalesce({c}, ''), '[\",\\n\\r]') then '\"' || replace({c}, '\"', '\"\"') || '\"' "
        f"else coalesce({c}, '') end"
        for c in doc_cells
    )
    return {
        "read_csv_delimiters": (
            "select cast(o_orderkey as varchar) as key, o_orderpriority || ';,|' as priority, o_orderstatus as status from orders"
        ),
        "read_csv_multiline_split": (
            "select cast(doc_id as varchar) as doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang from documents"
        ),
        "csv_in_order": (
            "with l as (select l_orderkey || ',' || l_linenumber || ',' || l_returnflag as line from lineitem) "
            "select cast(count(*) + 2 as bigint) as lines, cast(1 as bigint) as headers, true as in_order, cast(6 as bigint) as parts, "
            "cast(sum(strlen(line) + 2) + 3 + 7 + 38 as bigint) as bytes, true as contiguous from l"
        ),
        "read_csv": o.messy(f"select {filled} from messy"),
        "conform_rows": (
            "select cast(o_orderkey as varchar) as order_id, o_orderstatus as status, "
            "case when o_orderkey % 3 = 0 then '' else o_orderpriority end as priority from orders"
        ),
        "validate_load": "select true as ok, count(*) as row_count from orders",
        "read_csv_mixed_headers": (
            "select case when o_orderkey % 50 = 0 then 'key' else cast(o_orderkey as varchar) end as key, "
            "case when o_orderkey % 2 = 1 then '' when o_orderkey % 50 = 0 then 'status' else o_orderstatus end as status, "
            "case when o_orderkey % 2 = 1 then o_orderpriority else '' end as priority, "
            "case when o_orderkey % 2 = 1 then cast(cast(o_totalprice as decimal(18,2)) as varchar) else '' end as total from orders"
        ),
        "validate_load_bad_files": (
            "select 'good.csv' as kind, true as ok, null as error, count(*) as row_count from orders union all "
            f"select 'bare.csv', false, '{csv_source.NO_ROWS}', 0 union all "
            f"select 'blank.csv', false, $${csv_source.UNREADABLE}$$, 0 union all "
            f"select 'open.csv', false, $${csv_source.UNREADABLE}$$, 1 union all "
            f"select 'other.txt', false, '{csv_source.UNSUPPORTED}', 1"
        ),
        "csv_lines": f"select {quoted} as line from documents",
        "cleaning_summary": o.cleaning_summary([(x.type, x.column) for x in STEPS]),
        "load_registry": o.over(
            o.LOADS,
            "select * exclude (rn) from (select *, row_number() over (partition by name order by loaded_at desc, "
            "file_size desc, row_count desc, column_count desc) as rn from loads) where rn = 1 "
            "order by loaded_at desc, name limit 8",
            "loads",
        ),
        "chart_recommendations": o.q(
            "select inferred_type, cast(ordinal as bigint) as ordinal, name as \"column\", cast(rank as bigint) as rank, chart, chart_label, default_aggregation, needs_y "
            f"from prof join (values {o.RECOMMENDATIONS}) r(t, rank, chart, chart_label, default_aggregation, needs_y) "
            "on prof.inferred_type = r.t"
        ),
    }


NUMBERS, DATES = "number", "date"
LINEITEM = {
    "l_orderkey": NUMBERS, "l_partkey": NUMBERS, "l_suppkey": NUMBERS, "l_linenumber": NUMBERS, "l_quantity": NUMBERS,
    "l_extendedprice": NUMBERS, "l_discount": NUMBERS, "l_tax": NUMBERS, "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": DATES,
}
EVENTS = {"event_id": NUMBERS, "ts": DATES, "user_id": NUMBERS, "event_type": "text", "value": NUMBERS, "props": "text"}


def _documents_values(last: str) -> str:
    """The values of the documents' texts, once as they are and once with capital A's, and `last` over them."""
    kept = f"not {o.missing('value')}"
    return f"""with d as (select text, lang from documents union all select translate(text, 'a', 'A'), lang from documents),
      v as (select 'text' as "column", text as value from d union all select 'lang', lang from d),
      f as (select "column", value, count(*) as count from v where {kept} group by all),
      spelled as (select "column", {o.norm('value')} as normal_form, {o.trimmed('value')} as spelling, sum(count)::bigint as count from f group by all)
      {last}"""


def _oracle_profile() -> dict[str, str]:
    r = NUMERIC_DIGITS
    numeric = ", ".join(f"round({f}, {r[f]}) as {f}" if f in r else f for f in NUMERIC_FIELDS)
    pct = ", ".join(f"round({f}, 4) as {f}" for f in stats.PROBS)
    percentiles = o.q(f"select col as \"column\", num_count, {pct} from numstats")
    floor_limits = (
        "lim as (select col, list_sort(list(x)) as xs from nums group by col), "
        "fl as (select col, xs[cast(floor(len(xs) * 0.25) as int) + 1] as q1, "
        "xs[cast(floor(len(xs) * 0.75) as int) + 1] as q3 from lim)"
    )
    number, chart = o.prefix_number("total"), o.whole_number("total")
    first50 = (
        "select * from (select col, value, row_number() over (partition by col order by row_id) as rn from cells "
        f"where not {o.missing('value')}) where rn <= 50"
    )
    typed = {
        "column_profile_lineitem": o.typed_profile("lineitem", LINEITEM), "column_profile_events": o.typed_profile("events", EVENTS),
    }
    return typed | {
        "cell_functions": o.messy(
            f"""select row_id, {o.missing('total')} as missing, coalesce({o.is_number('total')}, false) as numeric_like,
            coalesce({o.norm('filled')} in ('true','false','yes','no','1','0'), false) as boolean_like,
            coalesce({o.date_of('order_date')} is not null, false) as date_like, {number} as number,
            {chart} as chart_number, {o.norm('priority')} as normal_form, {o.title('priority')} as title_case,
            strftime({o.date_of('order_date')}, '%Y-%m-%d') as iso_date, {o.bool_word('filled')} as bool_token,
            {o.number_text(number)} as number_text, {o.half_up(f'({number} / -8)', 1)} as rounded from messy"""
        ),
        "value_freq": o.q(
            'select col as "column", value, count(*) as cnt, cast(min(row_id) as bigint) as first_row from cells group by 1, 2'
        ),
        "missing_counts": o.q(
            'select col as "column", missing_count, total_values, total_values = 0 as is_empty from types'
        ),
        "infer_types": o.q('select col as "column", inferred_type from types'),
        "unique_counts": o.q(
            'select name as "column", unique_count, round(unique_ratio, 4) as unique_ratio from prof'
        ),
        "numeric_stats": o.q(f'select col as "column", {numeric} from numstats'),
        "percentiles": percentiles,
        "percentiles_by_rank": percentiles,
        "outlier_counts": o.q('select col as "column", outlier_count from outl'),
        "outlier_counts_floor_index": o.q(
            f""", {floor_limits} select n.col as "column", cast(count(*) filter (where f.q1 <> f.q3 and
            (n.x < f.q1 - 1.5 * (f.q3 - f.q1) or n.x > f.q3 + 1.5 * (f.q3 - f.q1))) as bigint) as outlier_count
            from nums n join fl f on n.col = f.col group by 1"""
        ),
        "date_stats": o.q(
            """select col as "column", strftime(first_ts, '%Y-%m-%d') as earliest, strftime(last_ts, '%Y-%m-%d') as latest,
            cast(floor((epoch(last_ts) - epoch(first_ts)) / 86400 + 0.5) as bigint) as range_days
            from types where inferred_type = 'date' and first_ts is not null"""
        ),
        "top_values": o.q(
            f'select col as "column", place, value, cnt as count, {_share("cnt", "row_count")} as percentage '
            "from ranked where place <= 10"
        ),
        "top_values_documents": _documents_values(
            f"""select "column", place, value, count, {_share('count', '(select count(*) from d)')} as percentage from (select *,
            row_number() over (partition by "column" order by count desc, value collate en, value) as place from f) where place <= 10"""
        ),
        "inconsistent_groups_documents": _documents_values(
            """select *, count(*) over (partition by "column", normal_form) as n_spellings from spelled
            qualify count(*) over (partition by "column", normal_form) >= 2"""
        ),
        "modes": o.q(
            f'select col as "column", value, cnt as count, {_share("cnt", "row_count")} as percentage from ranked where rk = 1'
        ),
        "boolean_stats": o.q(
            f'select col as "column", true_count, false_count, {_share("true_count", "row_count")} as true_percentage, '
            f"{_share('false_count', 'row_count')} as false_percentage from types where inferred_type = 'boolean'"
        ),
        "inconsistent_groups": o.q(
            'select s.col as "column", s.normal_form, s.spelling, s.count, f.n_spellings from spelled s '
            "join forms f on s.col = f.col and s.normal_form = f.normal_form"
        ),
        "duplicate_row_count": o.q("select duplicate_row_count from totals"),
        "incomplete_rows": o.q("select row_count, incomplete_row_count from totals"),
        "empty_columns": o.q('select name as "column" from prof where is_empty'),
        "column_profile": o.q(
            """select cast(p.ordinal as bigint) as ordinal, p.name, p.inferred_type, p.total_values, p.missing_count, p.unique_count,
            round(p.unique_ratio, 4) as unique_ratio, p.is_empty, round(n.mean, 4) as mean, round(n.median, 4) as median,
            round(n.std_dev, 4) as std_dev, round(n.p99, 4) as p99,
            case when p.inferred_type = 'date' then strftime(p.first_ts, '%Y-%m-%d') end as earliest,
            case when p.inferred_type = 'date' then strftime(p.last_ts, '%Y-%m-%d') end as latest,
            (select value from ranked r where r.col = p.name and r.place = 1) as mode,
            nullif((select count(*) from ranked r where r.col = p.name and r.rk = 1), 0) as n_modes,
            case when p.inferred_type = 'boolean' then p.true_count end as true_count,
            p.inconsistent_groups, p.inconsistent_spellings, p.outlier_count
            from prof p left join numstats n on n.col = p.name"""
        ),
        "dataset_profile": o.q(
            """select 'messy_orders' as dataset, row_count, n_cols as column_count, incomplete_row_count, duplicate_row_count,
            empty_cols as empty_column_count, miss as total_missing, quality_score,
            case when quality_score >= 90 then 'Good quality' when quality_score >= 70 then 'Acceptable quality'
              else 'Needs attention' end as score_label from score"""
        ),
        "completeness": o.q(
            f"""select "column", completeness, case when completeness >= 95 then 'good' when completeness >= 80 then 'fair' else 'poor' end as band
            from (select col as "column", {o.half_up('(total_values / row_count * 100)', 1)} as completeness from types)"""
        ),
        "type_summary": o.q(
            "select inferred_type, count(*) as n_columns, row_number() over (order by count(*) desc, inferred_type) as position from types group by 1"
        ),
        "fill_type_hint": o.q(
            f""", f as ({first50}), h as (select col, count(*) as n,
            count(*) filter (where regexp_full_match({o.trimmed('value')}, '-?[0-9]+([.][0-9]+)?')) as nums,
            count(*) filter (where {o.date_of('value')} is not null and contains(value, '-')) as dates from f group by col)
            select t.col as "column", case when nums >= n * 0.7 and n > 0 then 'number' when dates >= n * 0.7 and n > 0 then 'date'
            else 'text' end as fill_type from types t left join h on t.col = h.col"""
        ),
    }


def _oracle_issues() -> dict[str, str]:
    label = (
        "case when quality_score >= 90 then 'Good quality' when quality_score >= 70 then 'Acceptable quality' "
        "else 'Needs attention' end as score_label"
    )
    has_issue = 'name in (select "column" from issues where "column" is not null)'
    return {
        "issues": o.q('select ordinal, id, type, severity, "column", count, description from issues'),
        "issues_ranked": o.q(f"select id, severity, {o.SEVERITY_PLACE} as position from issues"),
        "issues_ranked_outliers": o.q(
            f"select id, severity, {o.SEVERITY_PLACE} as position from issues where type = 'potential_outliers'"
        ),
        "issue_type_counts": o.q("select type, count(*) as n_issues from issues group by type"),
        "issue_rollup": o.q(
            'select type, cast(sum(count) as bigint) as total_count, '
            "coalesce(string_agg(\"column\", ',' order by ordinal), '') as columns from issues group by type"
        ),
        "quality_score": o.q(f"select 'messy_orders' as dataset, quality_score, {label} from score"),
        "problem_columns": o.q(
            'select cast(ordinal as bigint) as ordinal, name as "column", missing_count, inconsistent_groups from prof '
            "where missing_count > 0 or inconsistent_groups > 0 order by ordinal limit 6"
        ),
        "column_search": o.q(
            f"select cast(ordinal as bigint) as ordinal, name, inferred_type from prof where contains(lower(name), 'or') and {has_issue}"
        ),
        "column_search_numbers": o.q(
            "select cast(ordinal as bigint) as ordinal, name, inferred_type from prof where inferred_type = 'number'"
        ),
        "column_search_clean": o.q(f"select cast(ordinal as bigint) as ordinal, name, inferred_type from prof where not ({has_issue})"),
        "default_columns": o.q(
            f'select cast(ordinal as bigint) as ordinal, name as "column" from prof order by case when {has_issue} then 0 else 1 end, ordinal limit 4'
        ),
        "y_candidates": o.q(
            "select cast(ordinal as bigint) as ordinal, name as \"column\" from prof where inferred_type = 'number' and name <> 'order_id'"
        ),
        "default_chart_column": o.q(
            "select 'messy_orders' as dataset, name as \"column\" from prof order by total_values = 0, ordinal limit 1"
        ),
    }


def _oracle_cleaning() -> dict[str, str]:
    x, missing = o.prefix_number("total"), o.missing("total")
    key = o.row_key()

    def replaced(column: str, new: str) -> str:
        return f"select * replace ({new} as {column}) from messy"

    def kept(column: str, converted: str) -> str:
        return replaced(column, f"case when {o.missing(column)} then {column} else coalesce({converted}, {column}) end")

    present = f"(select {x} as x from messy where not {missing} and {x} is not null)"
    limits = f"(select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.75) as q3 from {present})"
    outside = "(x < q1 - 1.5 * (q3 - q1) or x > q3 + 1.5 * (q3 - q1))"
    mean = o.number_text(o.half_up("avg(x)", 2))
    title = o.title(o.trimmed("priority"))
    dup = f"row_number() over (partition by {key} order by row_id)"
    return {
        "dedup_first": o.messy(f"select * from messy qualify {dup} = 1"),
        "dedup_last": o.messy(
            f"select * from messy qualify row_number() over (partition by {key} order by row_id desc) = 1"
        ),
        "fill_constant": o.messy(
            replaced("priority", f"case when {o.missing('priority')} then 'Unknown' else priority end")
        ),
        "fill_mean": o.messy(
            replaced("total", f"case when {missing} then (select {mean} from {present}) else total end")
        ),
        "fill_median": o.messy(
            replaced(
                "total",
                f"case when {missing} then (select {o.number_text('quantile_cont(x, 0.5)')} from {present}) else total end",
            )
        ),
        "normalize_text": o.messy(
            replaced("priority", f"case when {o.missing('priority')} then priority else {title} end")
        ),
        "convert_number": o.messy(kept("total", o.number_text(x))),
        "convert_date": o.messy(kept("order_date", f"strftime({o.date_of('order_date')}, '%Y-%m-%d')")),
        "convert_boolean": o.messy(kept("filled", o.bool_word("filled"))),
        "convert_typed": o.messy(
            f"select * replace (case when not {missing} then {x} end as total), "
            f"case when not {missing} and {x} is null then total end as rejected from messy"
        ),
        "remove_outliers": o.messy(
            f"select * exclude (x, q1, q3) from (select *, case when not {missing} then {x} end as x from messy), {limits} "
            f"where not coalesce({outside}, false)"
        ),
        "remove_outliers_typed": (
            "select event_id, value from events, (select quantile_cont(value, 0.25) as q1, "
            "quantile_cont(value, 0.75) as q3 from events) "
            "where not coalesce(value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1), false)"
        ),
        "remove_rows": o.messy(
            "select * from messy where row_id not in (select o_orderkey from orders where o_orderstatus = 'P')"
        ),
        "remove_column": o.messy("select * exclude (notes) from messy"),
        "apply_recipe": o.RECIPE + "select * from s7",
        "recipe_undo": o.RECIPE + "select * from s5",
        "preview_duplicates": o.messy(
            f"select row_id from (select row_id, {dup} as n from messy) where n > 1 order by row_id limit 10"
        ),
        "preview_fill": o.messy(
            f"select row_id, '' as before, '0' as after from messy where {missing} order by row_id limit 8"
        ),
        "preview_normalize": o.messy(
            f"select row_id, priority as before, {o.norm('priority')} as after from messy "
            f"where not {o.missing('priority')} order by row_id limit 8"
        ),
        "preview_outliers": o.messy(
            f"select row_id, x as value from (select row_id, {x} as x from messy where not {missing}), {limits} "
            f"where {outside} order by row_id limit 20"
        ),
        "cell_diff": o.RECIPE + ", d as (" + " union all ".join(
            f"""select coalesce(b.row_id, a.row_id) as row_id, '{c}' as "column", coalesce(b.{c}, '') as before,
            coalesce(a.{c}, '') as after, case when a.row_id is null then 'removed' when b.row_id is null then 'added'
            else 'changed' end as change from messy b full join s7 a on b.row_id = a.row_id"""
            for c in o.COLUMNS if c != "notes"
        ) + ") select * from d where before <> after",
    }


def _oracle_rows_and_charts() -> dict[str, str]:
    any_flag = "has_missing or is_duplicate or has_inconsistent or has_outlier"
    hit = " or ".join(f"contains(lower(coalesce({c}, '')), 'urgent')" for c in o.COLUMNS)
    bars = o.top_groups(o.event_groups("sum(value)"))
    mean_of_rest = (
        o.top_groups(o.event_groups("avg(value)"))
        + f", rest as (select {o.half_up('avg(value)', 2)} as v from events where cast(user_id as varchar) in "
        "(select label from r where n > 30 and position > 29)) "
        "select position, label, round(case when label = 'Other' and position = 30 then (select v from rest) else value end, 2) "
        "as value, 'user_id' as x_label, 'Mean of value' as y_label from kept"
    )

    def histogram(values: str) -> str:
        edge = "case when {0} % 1 = 0 then " + o.number_text("{0}") + " else printf('%.1f', {0}) end"
        a, b = edge.format("a"), edge.format("b")
        return f"""vals as ({values}), shape as (select count(*) as n, min(v) as lo, max(v) as hi from vals),
        s as (select *, least(20, cast(ceil(sqrt(n)) as int)) as bins, (hi - lo) / least(20, cast(ceil(sqrt(n)) as int)) as w from shape),
        b as (select cast(unnest(range(bins)) as bigint) as bin, lo, hi, w, bins from s),
        c as (select cast(least(floor((v - lo) / w), bins - 1) as bigint) as bin, count(*) as n from vals, s group by 1)
        select bin, {a} || '–' || {b} as label, coalesce(n, 0) as count
        from (select b.bin, lo + b.bin * w as a, lo + b.bin * w + w as b, c.n from b left join c on b.bin = c.bin)"""

    line = o.top_groups(
        f"select {o.trimmed('order_date')} as label, cast(count(*) as double) as value, min(row_id) as first_row "
        f"from messy where not {o.missing('order_date')} group by 1"
    ).replace("with g as", ", g as", 1)
    donut = o.top_groups(
        f"select {o.trimmed('priority')} as label, cast(count(*) as double) as value, min(row_id) as first_row "
        f"from messy where not {o.missing('priority')} group by 1"
    ).replace("with g as", ", g as", 1)
    with_messy = f"with messy as ({o.MESSY})"
    return {
        "chart_request": o.top_groups(
            o.messy_groups("sum").replace(
                "from messy", f"from (select * replace ({o.title(o.trimmed('priority'))} as priority) from ({o.MESSY}) m) messy"
            )
        ) + "select position, label, round(value, 2) as value from kept",
        "row_flags": o.q(f"select *, {any_flag} as has_any from flags"),
        "rows_with_missing": o.q("select m.* from messy m join flags using (row_id) where has_missing"),
        "rows_duplicate": o.q("select m.* from messy m join flags using (row_id) where is_duplicate"),
        "rows_inconsistent": o.q("select m.* from messy m join flags using (row_id) where has_inconsistent"),
        "rows_outlier": o.q("select m.* from messy m join flags using (row_id) where has_outlier"),
        "find_page": o.q(
            f"""select * from (select *, count(*) over () as row_count, cast(ceil(count(*) over () / 25.0) as bigint) as page_count
            from (select * from messy where {hit}) join (select row_id from flags where has_missing) using (row_id))
            order by row_id limit 25 offset 50"""
        ),
        "any_issue_count": o.q(f"select count(*) as rows_with_any_issue from flags where {any_flag}"),
        "search_rows": o.messy(f"select * from messy where {hit}"),
        "page_rows": o.messy(
            "select * from messy order by row_id limit 50 offset "
            "(select (least(7, ceil(count(*) / 50.0)) - 1)::bigint * 50 from messy)"
        ),
        "page_rows_past_end": o.messy(
            "select * from messy order by row_id limit 100 offset "
            "(select (ceil(count(*) / 100.0) - 1)::bigint * 100 from messy)"
        ),
        **{f"group_{fn}": o.messy(o.messy_groups(fn)) for fn in charts.AGGREGATES},
        "top_categories": bars + "select position, label, round(value, 2) as value from kept",
        "top_categories_recompute": mean_of_rest,
        "chart_bar": (
            "select row_number() over (order by v desc) as position, event_type as label, round(v, 4) as value, "
            "'event_type' as x_label, 'Mean of value' as y_label from (select event_type, avg(value) as v from events group by 1)"
        ),
        "chart_line": with_messy + line + (
            "select row_number() over (order by label collate en, position) as position, label, value, "
            "'order_date' as x_label, 'Count' as y_label from kept"
        ),
        "chart_histogram": "with " + histogram("select value as v from events where value is not null"),
        "chart_histogram_text": with_messy + ", " + histogram(
            f"select v from (select {o.whole_number('total')} as v from messy) where v is not null"
        ),
        "chart_scatter": (
            "with p as (select event_id as row_id, cast(event_id as double) as x, value as y, "
            "row_number() over (order by event_id) - 1 as rn, count(*) over () as n from events where value is not null), "
            "want as (select distinct cast(floor(i * (n / 500.0::double)) as bigint) as rn from range(500) t(i), (select max(n) as n from p)) "
            "select row_id, x, y from p where n <= 500 or rn in (select rn from want)"
        ),
        "chart_donut": with_messy + donut + (
            "select position, label, value, round(value / sum(value) over () * 100, 4) as share from kept"
        ),
    }


def _oracle_suggestions() -> dict[str, str]:
    mean = o.number_text(o.half_up("n.mean", 2))
    median = o.number_text("n.median")
    fill = (
        f"case when strategy in ('zero', '0') then '0' when strategy = 'mean' and n.mean is not null then {mean} "
        f"when strategy = 'median' and n.median is not null then {median} "
        "when strategy is not null and lower(strategy) not in ('unknown', 'empty', 'leave') then strategy else 'Unknown' end"
    )
    s = "lower(coalesce(strategy, 'trim_lowercase'))"
    forms = (
        f"coalesce(nullif(concat_ws(',', case when contains({s}, 'trim') then 'trim' end, "
        f"case when contains({s}, 'lower') then 'lowercase' when contains({s}, 'upper') then 'uppercase' "
        f"when contains({s}, 'title') then 'titlecase' end), ''), 'trim,lowercase')"
    )
    label = (
        "case when strategy in ('zero', '0') then '0' when strategy = 'mean' and has_mean then 'mean (' || setting || ')' "
        "when strategy = 'median' and has_mean then 'median (' || setting || ')' else '\"' || setting || '\"' end"
    )
    mapped = f""", joined as (
      select k.*, p.missing_count, p.total_values, p.inconsistent_spellings, t.duplicate_row_count, n.mean is not null as has_mean,
        case when operation = 'remove_duplicates' then operation
          when p.name is not null and operation in ('fill_missing', 'normalize_text') then operation
          when p.name is not null and operation = 'convert_type' and coalesce(strategy, 'number') in ('number', 'date', 'boolean')
            then operation end as step_type,
        case when operation = 'remove_duplicates' then case when strategy = 'last' then 'last' else 'first' end
          when operation = 'fill_missing' then {fill} when operation = 'normalize_text' then {forms}
          else coalesce(strategy, 'number') end as setting
      from kept k cross join totals t left join prof p on k."column" = p.name left join numstats n on n.col = p.name)
    select dataset, reply_id, id, operation, step_type,
      case when step_type <> 'remove_duplicates' then "column" end as step_column,
      case when step_type is not null then setting end as setting,
      case step_type when 'remove_duplicates' then 'Remove duplicate rows (keep ' || setting || ' occurrence)'
        when 'fill_missing' then 'Fill ' || missing_count || ' missing value' || case when missing_count = 1 then '' else 's' end
          || ' in `' || "column" || '` with ' || {label}
        when 'normalize_text' then 'Normalize `' || "column" || '` (' || replace(setting, ',', ' + ') || ')'
        when 'convert_type' then 'Convert `' || "column" || '` to ' || setting end as description,
      case step_type when 'remove_duplicates' then duplicate_row_count when 'fill_missing' then missing_count
        when 'normalize_text' then inconsistent_spellings when 'convert_type' then total_values end as affected_count
    from joined"""
    lengths = ", ".join(f"cast(length(coalesce({c}, '')) as varchar)" for c in o.COLUMNS)
    texts = ", ".join(f"coalesce({c}, '')" for c in o.COLUMNS)
    word = f"cast('0x' || substr(sha256(concat_ws('|', {lengths}, {texts})), 1, 15) as bigint)"
    insight_items = """ins as (select dataset, reply_id, unnest(cast(json_extract(j, '$.insights') as json[])) as item,
      generate_subscripts(cast(json_extract(j, '$.insights') as json[]), 1) - 1 as pos from parsed where j is not null)"""
    field = o._field
    return {
        # accepted: keep-last dedup, fill `priority` with the word "mean" (it has none), trim and lower
        # `order_date`, convert `priority` to boolean
        "apply_suggestions": o.messy(
            f"""select row_id, order_id, case when {o.missing('p')} then p else coalesce({o.bool_word('p')}, p) end as priority, total,
            case when {o.missing('order_date')} then order_date else {o.norm('order_date')} end as order_date, filled, notes
            from (select *, case when {o.missing('priority')} then 'mean' else priority end as p from messy
              qualify row_number() over (partition by {o.row_key()} order by row_id desc) = 1)"""
        ),
        "profile_payload": o.q(
            f"""select p.row_count, s.quality_score, p.name, p.inferred_type as type, p.missing_count as missing, p.unique_count,
            {o.half_up('p.unique_ratio', 3)} as unique_ratio, {o.half_up('n.mean', 2)} as mean, {o.half_up('n.std_dev', 2)} as std_dev,
            {o.half_up('n.iqr', 2)} as iqr, r.value as mode, r.cnt as mode_count,
            case when p.inferred_type = 'date' then strftime(p.first_ts, '%Y-%m-%d') end as earliest,
            nullif(p.inconsistent_groups, 0) as inconsistent_groups
            from prof p cross join score s left join numstats n on n.col = p.name
            left join ranked r on r.col = p.name and r.place = 1"""
        ),
        "parse_suggestions": f"with {o.SUGGESTIONS} select * from kept",
        "parse_insights": (
            f"with {o.SUGGESTIONS}, {insight_items} select dataset, reply_id, pos, {field('title')} as title, "
            f"{field('description')} as description from ins where {field('title')} is not null and {field('description')} is not null"
        ),
        "reply_status": (
            f"with {o.SUGGESTIONS}, {insight_items}, good as (select reply_id from kept union "
            f"select reply_id from ins where {field('title')} is not null and {field('description')} is not null) "
            "select dataset, reply_id, case when j is null then 'unreadable' when reply_id in (select reply_id from good) "
            "then 'ok' else 'empty' end as status from parsed"
        ),
        "map_suggestions": o.PRELUDE + ", " + o.SUGGESTIONS + mapped,
        "fingerprint": o.messy(
            f"select 'messy_orders' as dataset, count(*) as row_count, cast(sum({word}) as varchar) as content, "
            f"concat_ws('|', '2026-01-01T00:00:00Z', cast(count(*) as varchar), '{len(o.COLUMNS)}', "
            f"'{','.join(o.COLUMNS)}', 's1,s2') as fingerprint from messy"
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **_oracle_sources(),
        **_oracle_profile(),
        **_oracle_issues(),
        **_oracle_cleaning(),
        **_oracle_rows_and_charts(),
        **_oracle_suggestions(),
        **(llm.ORACLE_SQL if llm else {}),
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if llm and corpus_pipeline.ORACLE_SQL else {}),
    }
