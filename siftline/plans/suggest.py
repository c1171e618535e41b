"""Jobs around model suggestions: payload out, replies in, replies to recipe steps.

The model call itself is not here. Everything carries a `dataset` key, so one job
serves the replies of many datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells as rules
from ..operators.rowid import data_columns, row_digest, text_columns
from ..session import materialize
from .recipe import Step, step_of

# What a suggestion may ask for, and its limits.
OPERATIONS = [
    "remove_duplicates", "fill_missing", "normalize_text", "convert_type", "remove_outlier_rows",
]
TITLE_LENGTH, REASON_LENGTH = 80, 200
DEFAULT_CONFIDENCE = 0.8
LEAVE_WORDS = ["unknown", "empty", "leave"]
TARGET_TYPES = ["number", "date", "boolean"]


def profile_payload(profile: DataFrame) -> DataFrame:
    """(dataset, payload): the profile as JSON aggregates, with no rows of the data.

    Fields that do not apply to a column are left out.
    """

    def rounded(x: str, digits: int) -> str:
        scale = 10**digits
        return f"floor({x} * {scale} + 0.5D) / {scale}.0D"

    column = f"""named_struct(
        'name', c.name, 'type', c.inferred_type, 'missing', c.missing_count,
        'unique', c.unique_count, 'uniqueRatio', {rounded("c.unique_ratio", 3)},
        'isEmpty', if(c.is_empty, true, null),
        'min', c.numeric_stats.min, 'max', c.numeric_stats.max,
        'mean', {rounded("c.numeric_stats.mean", 2)}, 'median', c.numeric_stats.median,
        'stdDev', {rounded("c.numeric_stats.std_dev", 2)},
        'q1', c.numeric_stats.q1, 'q3', c.numeric_stats.q3,
        'iqr', {rounded("c.numeric_stats.iqr", 2)}, 'sum', {rounded("c.numeric_stats.sum", 2)},
        'earliest', c.date_stats.earliest, 'latest', c.date_stats.latest,
        'mode', c.categorical_stats.top_values[0].value,
        'modeCount', c.categorical_stats.top_values[0].count,
        'inconsistentGroupCount', if(c.inconsistent_groups > 0, c.inconsistent_groups, null))"""
    payload = f"""to_json(named_struct(
        'rowCount', row_count, 'columnCount', column_count, 'qualityScore', quality_score,
        'duplicateRowCount', duplicate_row_count, 'incompleteRowCount', incomplete_row_count,
        'emptyColumnCount', empty_column_count,
        'columns', transform(columns, c -> {column}), 'issues', issues)) as payload"""
    return profile.selectExpr("dataset", payload)


def json_text(reply: Column) -> Column:
    """The JSON in a reply: as it is, inside a code fence, or from first { to last }."""
    trimmed = rules.js_trim(reply)

    def if_json(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull(), text)

    fenced = F.regexp_extract(trimmed, r"(?is)^```(?:json)?\s*(.*?)```\s*$", 1)
    braces = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.coalesce(if_json(trimmed), if_json(rules.js_trim(fenced)), if_json(braces))


def _parsed(replies: DataFrame) -> DataFrame:
    """Add the parsed reply. A variant keeps each field's own type, which decides
    whether it is used: a title that is a number is no title.

    A reply costs far more to parse than to read, so a table of few splits is dealt to all tasks first."""
    dealt = replies.repartition(int(replies.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("v", F.try_parse_json(json_text(F.col("reply"))))


def _text_field(item: str, field: str) -> Column:
    value = F.expr(f"try_variant_get({item}, '$.{field}', 'variant')")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, F.expr(f"try_variant_get({item}, '$.{field}', 'string')"))


def _items(parsed: DataFrame, keys: list[str], field: str) -> DataFrame:
    items = F.expr(f"try_variant_get(v, '$.{field}', 'array<variant>')")
    return parsed.select(*keys, F.posexplode(items).alias("pos", "item"))


def parse_insights(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., pos, title, description) of the insights that have both texts."""
    return (
        _items(_parsed(replies), keys, "insights")
        .select(
            *keys,
            F.col("pos").cast("bigint").alias("pos"),
            _text_field("item", "title").alias("title"),
            _text_field("item", "description").alias("description"),
        )
        .where("title is not null and description is not null")
    )


def parse_suggestions(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., id, column, issue_type, title, reason, operation, strategy, confidence).

    Suggestions without title or reason are dropped; an unknown operation becomes null.
    """
    item = "item"
    confidence = F.expr("try_variant_get(item, '$.confidence', 'variant')")
    kind = F.schema_of_variant(confidence)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    value = F.expr("try_variant_get(item, '$.confidence', 'double')")
    operation = _text_field(item, "operationType")
    return (
        _items(_parsed(replies), keys, "suggestions")
        .select(
            *keys,
            F.concat(F.lit("ai_"), F.col("pos").cast("string")).alias("id"),
            _text_field(item, "column").alias("column"),
            _text_field(item, "issueType").alias("issue_type"),
            F.substring(_text_field(item, "title"), 1, TITLE_LENGTH).alias("title"),
            F.substring(_text_field(item, "reason"), 1, REASON_LENGTH).alias("reason"),
            F.when(operation.isin(OPERATIONS), operation).alias("operation"),
            _text_field(item, "strategy").alias("strategy"),
            F.when(is_number, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
            .otherwise(F.lit(DEFAULT_CONFIDENCE))
            .alias("confidence"),
        )
        .where("title is not null and reason is not null")
    )


def reply_status(replies: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., status): ok, unreadable (no JSON found), or empty (nothing usable)."""

    def usable(field: str, a: str, b: str) -> Column:
        items = F.expr(f"coalesce(try_variant_get(v, '$.{field}', 'array<variant>'), array())")
        return F.exists(
            items,
            lambda i: F.coalesce(
                (F.schema_of_variant(F.try_variant_get(i, f"$.{a}", "variant")) == "STRING")
                & (F.schema_of_variant(F.try_variant_get(i, f"$.{b}", "variant")) == "STRING"),
                F.lit(False),
            ),
        )

    found = usable("insights", "title", "description") | usable("suggestions", "title", "reason")
    status = F.when(F.col("v").isNull(), "unreadable").when(found, "ok").otherwise("empty")
    return _parsed(replies).select(*keys, status.alias("status"))


def map_suggestions(suggestions: DataFrame, profile: DataFrame) -> DataFrame:
    """Suggestions as recipe steps, or rejected (`step_type` null).

    One equality join with the column profiles on (dataset, column), and one with the
    profile rows for the duplicate count. Outlier and column removal are never mapped.
    """
    columns = profile.select("dataset", "duplicate_row_count", F.explode("columns").alias("c")).selectExpr(
        "dataset", "c.name as column", "c.missing_count", "c.total_values", "c.inconsistent_spellings",
        "c.numeric_stats.mean as mean", "c.numeric_stats.median as median", "true as known",
    )
    totals = profile.select("dataset", "duplicate_row_count")
    c = F.col
    joined = suggestions.join(totals, "dataset", "left").join(columns, ["dataset", "column"], "left")
    strategy, op = c("strategy"), c("operation")
    lowered = F.lower(F.coalesce(strategy, F.lit("trim_lowercase")))

    mean = rules.number_text(rules.round_half_up(c("mean"), 2))
    median = rules.number_text(c("median"))
    literal = strategy.isNotNull() & (strategy != "") & ~F.lower(strategy).isin(LEAVE_WORDS)
    fill = (
        F.when(strategy.isin("zero", "0"), F.lit("0"))
        .when((strategy == "mean") & c("mean").isNotNull(), mean)
        .when((strategy == "median") & c("median").isNotNull(), median)
        .when(literal, strategy)
        .otherwise(F.lit("Unknown"))
    )
    quoted = F.concat(F.lit('"'), fill, F.lit('"'))
    fill_label = (
        F.when(strategy.isin("zero", "0"), F.lit("0"))
        .when((strategy == "mean") & c("mean").isNotNull(), F.concat(F.lit("mean ("), fill, F.lit(")")))
        .when((strategy == "median") & c("median").isNotNull(), F.concat(F.lit("median ("), fill, F.lit(")")))
        .otherwise(quoted)
    )
    case_form = (
        F.when(lowered.contains("lower"), "lowercase")
        .when(lowered.contains("upper"), "uppercase")
        .when(lowered.contains("title"), "titlecase")
    )
    forms = F.array_compact(F.array(F.when(lowered.contains("trim"), F.lit("trim")), case_form))
    forms = F.when(F.size(forms) == 0, F.array(F.lit("trim"), F.lit("lowercase"))).otherwise(forms)
    target = F.coalesce(strategy, F.lit("number"))
    keep = F.when(strategy == "last", "last").otherwise("first")
    known = c("known").isNotNull()

    step = (
        F.when((op == "remove_duplicates") & c("duplicate_row_count").isNotNull(), op)
        .when(known & op.isin("fill_missing", "normalize_text"), op)
        .when(known & (op == "convert_type") & target.isin(TARGET_TYPES), op)
    )
    detail = (
        F.when(step == "remove_duplicates", keep)
        .when(step == "fill_missing", fill)
        .when(step == "normalize_text", F.array_join(forms, ","))
        .when(step == "convert_type", target)
    )
    plural = F.when(c("missing_count") == 1, "").otherwise("s")
    in_ticks = F.concat(F.lit("`"), c("column"), F.lit("`"))
    description = (
        F.when(
            step == "remove_duplicates",
            F.concat(F.lit("Remove duplicate rows (keep "), keep, F.lit(" occurrence)")),
        )
        .when(
            step == "fill_missing",
            F.concat(
                F.lit("Fill "), c("missing_count").cast("string"), F.lit(" missing value"), plural,
                F.lit(" in "), in_ticks, F.lit(" with "), fill_label,
            ),
        )
        .when(
            step == "normalize_text",
            F.concat(F.lit("Normalize "), in_ticks, F.lit(" ("), F.array_join(forms, " + "), F.lit(")")),
        )
        .when(step == "convert_type", F.concat(F.lit("Convert "), in_ticks, F.lit(" to "), target))
    )
    affected = (
        F.when(step == "remove_duplicates", c("duplicate_row_count"))
        .when(step == "fill_missing", c("missing_count"))
        .when(step == "normalize_text", c("inconsistent_spellings"))
        .when(step == "convert_type", c("total_values"))
    )
    step_column = F.when(step != "remove_duplicates", c("column"))
    return joined.select(
        *suggestions.columns,
        step.alias("step_type"),
        step_column.alias("step_column"),
        detail.alias("setting"),
        description.alias("description"),
        affected.alias("affected_count"),
    )


def fingerprint(df: DataFrame, dataset: str, created_at: str, step_ids: list[str], row_id: str | None = None) -> DataFrame:
    """One row that changes with the data, its columns or the recipe.

    Beside the identifying text, the content goes in as a sum over row digests: the same
    in any row order, one pass, and a row that occurs twice counts twice.
    """
    columns = data_columns(df, None, row_id)
    word = F.conv(F.substring(F.hex(row_digest(text_columns(df, columns))), 1, 15), 16, 10)
    names = ",".join(columns)
    ids = ",".join(step_ids)
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(word.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("content"),
    ).select(
        F.lit(dataset).alias("dataset"),
        "row_count",
        "content",
        F.concat_ws(
            "|", F.lit(created_at), F.col("row_count").cast("string"), F.lit(str(len(columns))), F.lit(names), F.lit(ids)
        ).alias("fingerprint"),
    )


def fresh_only(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored suggestions whose fingerprint is still the current one."""
    return stored.join(current.select("dataset", "fingerprint", "content"), ["dataset", "fingerprint", "content"], "left_semi")


def accepted_steps(stored: DataFrame, current: DataFrame, order: str = "id") -> list[Step]:
    """The recipe steps of accepted suggestions, in order; stale ones are refused.

    `stored` has mapped suggestions with the fingerprint and content they were made for. Each
    accepted row becomes a step, so they are as few as a person accepts.
    """
    stored, current = materialize(stored, "stored"), materialize(current, "current")  # each is read several times
    usable = fresh_only(stored, current)
    if stored.count() != usable.count():
        raise ValueError("the data or its recipe has changed since these suggestions were made")
    return [step_of(r.asDict()) for r in usable.where("step_type is not null").orderBy(order).collect()]
