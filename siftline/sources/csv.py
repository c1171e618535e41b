"""CSV in and out: text columns in, spreadsheet-friendly lines out.

Reading is one scan of the files, whose lines are written with their places: (file, split,
number in the split). Headers, delimiters, quote states and rows all come from that
table, so nothing depends on how a scan happens to be split.

Line breaks inside quotes do not keep a file in one task. What a line does to the quote state (in a quoted field
or not) is a function on two states; running windows over a split, then over the splits of a file, compose
them. Only files that have such a line take this way, and only the lines of broken records are grouped.
"""

from __future__ import annotations

import csv as header_csv
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as rules
from ..operators.rowid import ROW_ID, file_uri, name, text_columns
from ..session import materialize

BOM = chr(0xFEFF)

EXTENSIONS = ("csv", "xls", "xlsx")
# Messages of a refused load.
UNSUPPORTED = "Only CSV, XLS, and XLSX files are supported."
EMPTY_FILE = "This file is empty."
UNREADABLE = "We couldn't read this CSV. Check that the file is a valid CSV and try again."
NO_ROWS = "This dataset contains columns but no rows."

#: What may part fields where no delimiter is named, in order of preference; the last two are the ASCII separators.
DELIMITERS = (",", "\t", "|", ";", "\x1e", "\x1f")
#: Records that a delimiter is guessed from.
GUESS_RECORDS = 10
#: Lines of a file that its header is looked for in; more are read where they do not hold it.
HEAD_LINES = 64
#: Files, or broken splits, up to which a table with a row for each is sent to all tasks.
SMALL_ROWS = 200_000
#: Bytes of a range of an ordered export that one task sorts, with what a row takes beside its text, and of a block of its lines.
RANGE_BYTES, ROW_BYTES, BLOCK_BYTES = 64 << 20, 64, 1 << 20
#: Ranges a part is made of at least, so that parts are even.
PART_RANGES = 16


def normalize_columns(names: list[str]) -> list[str]:
    """Trim names, drop trailing blank ones, name interior blanks by position.

    A repeated name gets a numbered suffix, so that no column hides another.
    """
    trimmed = [n.strip(rules.WHITESPACE) for n in names]
    while trimmed and trimmed[-1] == "":
        trimmed.pop()
    out: list[str] = []
    for i, n in enumerate(trimmed, 1):
        n = n or f"(Unnamed Column {i})"
        unique, k = n, 2
        while unique in out:
            unique, k = f"{n} ({k})", k + 1
        out.append(unique)
    return out


FILE = "_file"
PLACE = ["_file", "_split", "_at"]


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it is small; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _lines(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """(_file, _split, _at, value): every line, written. Without `multiline` a lone carriage return ends a line too."""
    reader = spark.read.option("lineSep", "\n") if multiline else spark.read
    split = F.col("_metadata.file_block_start")
    lines = reader.text(path).select(file_uri(F.col("_metadata.file_path")).alias(FILE), split.alias("_split"), "value")
    return materialize(lines.withColumn("_at", F.monotonically_increasing_id()), "csv-lines")


class Head(NamedTuple):
    """How a file starts."""

    cells: list[str]
    delimiter: str
    lines: int  # lines before the data
    whole: bool  # else the header goes on after the lines given


def _parsed(lines: list[str], delimiter: str, multiline: bool, records: int) -> Iterator[tuple[list[str], int]]:
    """The first records that are not blank, each with the number of lines read so far."""
    if not multiline:
        own = ((next(header_csv.reader([x], delimiter=delimiter), []), i) for i, x in enumerate(lines, 1) if x)
    else:
        reader = header_csv.reader([x + "\n" for x in lines], delimiter=delimiter)
        own = ((cells, reader.line_num) for cells in reader if cells)
    for _, record in zip(range(records), own):
        yield record


def guess_delimiter(lines: list[str], multiline: bool = True) -> str:
    """The delimiter under which the first records agree best in their number of fields.

    A later one in the list is taken if its counts change no more than the best one's and it makes more fields.
    """
    best = None
    for delimiter in DELIMITERS:
        widths = [len(cells) for cells, _ in _parsed(lines, delimiter, multiline, GUESS_RECORDS)]
        if not widths:
            continue
        changes = sum(abs(b - a) for a, b in zip(widths, widths[1:]))
        fields = sum(widths) / len(widths)
        if fields >= 2 and (best is None or (changes <= best[0] and fields > best[1])):
            best = (changes, fields, delimiter)
    return best[2] if best else DELIMITERS[0]


def read_head(lines: list[str], delimiter: str | None, multiline: bool, all_lines: bool) -> Head | None:
    """The header record of a file's first lines. None: the lines are blank.

    A first line `sep=` and a delimiter names it and is no header; the record after it is.
    """
    header_csv.field_size_limit(1 << 31)
    lines = [x.removesuffix("\r") for x in lines]
    start = next((i for i, x in enumerate(lines) if x.lstrip(BOM)), None)
    if start is None:
        return None if all_lines else Head([], ",", 0, False)
    lines = [lines[start].lstrip(BOM), *lines[start + 1 :]]
    said = lines[0].removeprefix("sep=") if lines[0].startswith("sep=") else ""
    names = said if len(said) == 1 and delimiter in (None, said) else None
    if names:
        start, lines = start + 1, lines[1:]
    delimiter = delimiter or names or guess_delimiter(lines, multiline)
    cells, used = next(_parsed(lines, delimiter, multiline, 1), ([], 0))
    return Head(cells, delimiter, start + used, all_lines or 0 < used < len(lines))


def read_heads(lines: DataFrame, delimiter: str | None = None, multiline: bool = True) -> DataFrame:
    """(_file, cells, delimiter, skip, _first) of every file that has content, written; _first is its first line's number."""
    opening = lines.where("_split = 0")
    first = materialize(opening.groupBy(FILE).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")), "csv-first")
    found, wanted, size = [], first, HEAD_LINES
    schema = f"{FILE} string, cells array<string>, delimiter string, skip long, whole boolean, _first long"

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, at, n, text in zip(batch[FILE], batch["_first"], batch["n"], batch["text"], strict=True):
                head = read_head(list(text), delimiter, multiline, n == len(text))
                if head is not None:
                    out.append((file, head.cells, head.delimiter, head.lines, head.whole, at))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    while True:
        near = opening.join(_small(wanted), FILE).where(F.col("_at") < F.col("_first") + size)
        texts = near.groupBy(FILE, "_first", "n").agg(F.sort_array(F.collect_list(F.struct("_at", "value")))["value"].alias("text"))
        got = materialize(texts.mapInPandas(heads, schema), "csv-heads")
        found.append(got.where("whole"))
        if got.where("not whole").isEmpty():
            break
        wanted, size = materialize(first.join(got.where("not whole").select(FILE), FILE), "csv-first"), size * 16
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialize(out.drop("whole"), "csv-heads")


def _effects(delimiter: Column) -> list[Column]:
    """Whether a line leaves a quoted field open: `e0` if none was open before it, `e1` if one was."""
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))

    def opens(text: Column) -> Column:
        closed = F.regexp_replace(text, F.concat(F.lit("(^|"), d, F.lit(')"(?:[^"]++|"")*+"')), F.lit("$1"))
        return F.regexp_like(closed, F.concat(F.lit("(^|"), d, F.lit(')"')))

    inside = '^(?:[^"]++|"")*+'
    rest = F.regexp_replace("value", inside + '"', "x")
    has = F.contains("value", F.lit('"'))
    e1 = F.when(~has | F.regexp_like("value", F.lit(inside + "$")), True).otherwise(opens(rest))
    return [(has & opens(F.col("value"))).alias("e0"), e1.alias("e1")]


def _before(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add s0, s1: the state before each row if the group starts outside (inside) a quoted field; rows have e0, e1."""
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.sum(F.when(F.col("e0") & ~F.col("e1"), 1).otherwise(0))
    counted = df.withColumn("_turns", turns.over(upto))
    sets = F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").cast("int").alias("to"), "_turns"))
    counted = counted.withColumns({"_set": F.last(sets, ignorenulls=True).over(earlier), "_turned": F.coalesce(F.max("_turns").over(earlier), F.lit(0))})

    def state(start: int) -> Column:
        at = F.when(F.col("_set").isNull(), F.lit(start) + F.col("_turned")).otherwise(F.col("_set.to") + F.col("_turned") - F.col("_set._turns"))
        return at % 2 == 1

    return counted.withColumns({"s0": state(0), "s1": state(1)}).drop("_turns", "_set", "_turned")


def _after(state: Column) -> Column:
    return F.when(state, F.col("e1")).otherwise(F.col("e0"))


class Records(NamedTuple):
    """(_file, value) per record that is not blank, the header's lines left out, and the files whose last quote is open."""

    rows: DataFrame
    unclosed: DataFrame | None


def _records(lines: DataFrame, heads: DataFrame, multiline: bool) -> Records:
    known = _small(heads.select(FILE, "delimiter", "skip", "_first", *[c for c in ("kind",) if c in heads.columns]))
    carried = [FILE, *[c for c in ("kind",) if c in heads.columns], "delimiter"]
    data = lines.join(known, FILE).where((F.col("_split") > 0) | (F.col("_at") >= F.col("_first") + F.col("skip")))
    line = F.regexp_replace("value", "\r$", "").alias("value")
    broken = materialize(
        data.where(F.contains("value", F.lit('"'))).select(FILE, *_effects(F.col("delimiter"))).where("e0").select(FILE).distinct(), "csv-broken"
    )
    if broken.isEmpty():
        return Records(data.select(*carried, line).where("value <> ''"), None)
    side = _small(broken)
    plain = data.join(side, FILE, "left_anti").select(*carried, line).where("value <> ''")
    states = materialize(_before(data.join(side, FILE, "left_semi").select(*PLACE, *carried[1:], "value", *_effects(F.col("delimiter"))), [FILE, "_split"], ["_at"]), "csv-states")
    # what a split does as a whole is what its last line leaves
    last = Window.partitionBy(FILE, "_split").orderBy(F.desc("_at"))
    ends = states.select(*PLACE, "e0", "e1", "s0", "s1").withColumn("_last", F.row_number().over(last)).where("_last = 1")
    splits = ends.select(FILE, "_split", _after(F.col("s0")).alias("e0"), _after(F.col("s1")).alias("e1"))
    starts = materialize(_before(splits, [FILE], ["_split"]).withColumn("out", _after(F.col("s0"))).select(FILE, "_split", F.col("s0").alias("_start"), "out"), "csv-splits")
    final = starts.groupBy(FILE).agg(F.max_by("out", "_split").alias("open")).where("open").select(FILE)
    state = F.when(F.col("_start"), F.col("s1")).otherwise(F.col("s0"))
    if not multiline:  # each line is a record; only the verdict on the file is wanted
        return Records(data.select(*carried, line).where("value <> ''"), final)
    placed = states.join(_small(starts.drop("out")), [FILE, "_split"]).withColumn("_in", state)
    placed = placed.withColumn("_goes_on", _after(F.col("_in"))).drop("e0", "e1", "s0", "s1", "_start")
    whole = placed.where("not _in and not _goes_on").select(*carried, line).where("value <> ''")
    parts = placed.where("_in or _goes_on").withColumn("_begins", (~F.col("_in")).cast("long"))
    within = Window.partitionBy(FILE, "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(FILE).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy(FILE, "_split").agg(F.sum("_begins").alias("n"))
    base = base.select(FILE, "_split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    numbered = parts.withColumn("_number", F.sum("_begins").over(within)).join(base, [FILE, "_split"])
    joined = numbered.groupBy(*carried, (F.col("_number") + F.col("_base")).alias("_record")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("_split", "_at", "value")))["value"], "\n").alias("value")
    )
    return Records(plain.unionByName(whole).unionByName(joined.select(*carried, line)), final)


class Columns(NamedTuple):
    """The files of a folder under one list of columns."""

    names: list[list[str]]  # of each different header
    columns: list[str]  # all of them, in order of appearance
    rows: DataFrame  # the columns, and _file


def read_columns(spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True) -> Columns:
    """Every record, its cells put under all columns by name, "" where its file lacks one.

    Only the different headers come to the driver, and all files are read in one scan, whatever their headers are.
    """
    lines = _lines(spark, path, multiline)
    heads = materialize(read_heads(lines, delimiter, multiline).withColumn("kind", F.xxhash64("cells", "delimiter")), "csv-heads")
    kinds = heads.groupBy("kind").agg(F.first("cells").alias("cells"), F.first("delimiter").alias("delimiter")).orderBy("cells", "delimiter").collect()
    names = [normalize_columns(list(k["cells"])) for k in kinds]
    columns = list(dict.fromkeys(n for own in names for n in own))
    if not columns or not all(names):
        return Columns([*names, *([] if names else [[]])], columns, lines)
    records = _records(lines, heads, multiline)
    if records.unclosed is not None and multiline:
        files = [r[FILE] for r in records.unclosed.orderBy(FILE).limit(5).collect()]
        if files:
            raise ValueError(f"{UNREADABLE} A quote is never closed in {', '.join(files)}")
    width = max(len(k["cells"]) for k in kinds)
    fields = ", ".join(f"c{i} string" for i in range(width))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(20_480, 2 * width))}
    parsed = None
    for d in sorted({k["delimiter"] for k in kinds}):
        own = F.from_csv("value", fields, {**options, "sep": d})
        parsed = own if parsed is None else F.when(F.col("delimiter") == d, own).otherwise(parsed)
    rows = records.rows.select(FILE, "kind", parsed.alias("r"))
    if len({tuple(n) for n in names}) == 1:
        cells = [F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(c) for i, c in enumerate(names[0])]
        return Columns(names, columns, rows.select(*cells, FILE))
    # a row per different header: where each column is in its records, 0 if nowhere
    places = [(k["kind"], [own.index(c) + 1 if c in own else 0 for c in columns]) for k, own in zip(kinds, names)]
    table = spark.createDataFrame(places, "kind long, _places array<int>")
    rows = rows.join(F.broadcast(table), "kind").select(FILE, "_places", F.array(*[F.col(f"r.c{i}") for i in range(width)]).alias("_cells"))
    cells = [
        F.coalesce(F.when(F.col("_places")[i] > 0, F.try_element_at("_cells", F.col("_places")[i])), F.lit("")).alias(c) for i, c in enumerate(columns)
    ]
    return Columns(names, columns, rows.select(*cells, FILE))


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True, union: bool = False
) -> DataFrame:
    """All columns as text, named by the header, rows conformed to it.

    Each file's header is its own first record, and where no delimiter is named, each file's
    is guessed from its first records. Files with other columns than the rest raise ValueError, or with
    `union` are put under all columns by name, with "" where a file lacks one. A `sep=` line is dropped;
    lines without a character are no records. A file whose last quote is never closed raises ValueError.

    Lines end in LF or CRLF; line breaks inside quotes belong to the cell, and large files are
    split all the same. With `multiline=False` every line is a record, and a lone CR ends a line too.
    """
    got = read_columns(spark, path, delimiter, multiline)
    if not got.names or any(not n for n in got.names):
        raise ValueError(UNREADABLE)
    different = list(dict.fromkeys(map(tuple, got.names)))
    if len(different) > 1 and not union:
        raise ValueError("files have different columns: " + "; ".join(", ".join(n) for n in different))
    return got.rows.drop(FILE)


def conform_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clamp rows to the header: extra fields dropped, absent ones "".

    The scan with a fixed schema already cut or padded the row; null becomes "".
    """
    return df.select(
        *[F.coalesce(name(c).cast("string"), F.lit("")).alias(n) for c, n in zip(df.columns, columns)]
    )


def validate_load(
    spark: SparkSession, path: str, delimiter: str | None = None, multiline: bool = True, extensions: tuple[str, ...] = EXTENSIONS
) -> DataFrame:
    """(file, ok, error, row_count) for every file of a folder, each judged by its own header.

    Refused: another extension, an empty file, no header, no rows, or quoted fields
    that are opened and never closed. Rows of a different width are tolerated. The files are scanned once.
    """
    found = spark.read.format("binaryFile").load(path)
    lengths = found.select(file_uri(F.col("_metadata.file_path")).alias("file"), F.col("length"))
    # a scan skips files without content, the listing has them
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "file string")
    files = listed.select(file_uri(F.col("file")).alias("file")).join(lengths, "file", "left")
    named_ok = F.lower(F.col("file")).rlike(rf"\.({'|'.join(extensions)})$")
    lines = _lines(spark, path, multiline)
    heads = read_heads(lines, delimiter, multiline)
    records = _records(lines, heads, multiline)
    blank = F.regexp_replace(F.array_join("cells", ""), "\\s", "") == ""
    status = heads.select(F.col(FILE).alias("file"), (~blank).alias("readable"))
    per_file = records.rows.groupBy(F.col(FILE).alias("file")).agg(F.count(F.lit(1)).alias("records"))
    joined = files.join(status, "file", "left").join(per_file, "file", "left")
    if records.unclosed is None:
        joined = joined.withColumn("unclosed", F.lit(False))
    else:
        joined = joined.join(records.unclosed.select(F.col(FILE).alias("file"), F.lit(True).alias("unclosed")), "file", "left")
    readable = F.coalesce("readable", F.lit(False)) & ~F.coalesce("unclosed", F.lit(False))
    rows = F.when(F.coalesce("readable", F.lit(False)), F.coalesce("records", F.lit(0)))
    error = (
        F.when(~named_ok, UNSUPPORTED)
        .when(F.coalesce("length", F.lit(0)) == 0, EMPTY_FILE)
        .when(~readable, UNREADABLE)
        .when(F.coalesce(rows, F.lit(0)) == 0, NO_ROWS)
    )
    return joined.select(
        "file",
        error.isNull().alias("ok"),
        error.alias("error"),
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("row_count"),
    )


def quote_cell(c: Column) -> Column:
    """Quote iff the cell has a quote, comma, LF or CR; double inner quotes."""
    text = F.coalesce(c, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def csv_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One column `line`: each row as CSV text."""
    columns = columns or [c for c in df.columns if c != ROW_ID]
    cells = [quote_cell(t) for t in text_columns(df, columns)]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def _header_line(columns: list[str]) -> str:
    def quoted(c: str) -> str:
        return '"' + c.replace('"', '""') + '"' if any(ch in c for ch in '",\n\r') else c

    return ",".join(quoted(c) for c in columns)


def write_csv(
    df: DataFrame,
    path: str,
    columns: list[str] | None = None,
    bom: bool = True,
    sep_line: bool = True,
    mode: str = "errorifexists",
) -> None:
    """Spreadsheet CSV: CRLF lines, byte-order mark and `sep=,` line at the file start.

    Each partition becomes one complete file: the header rides on the partition's first
    line. Coalesce to one partition first where a single file is wanted.
    """
    columns = columns or [c for c in df.columns if c != ROW_ID]
    head = (BOM if bom else "") + ("sep=,\r\n" if sep_line else "") + _header_line(columns)
    lines = csv_lines(df, columns)
    if lines.isEmpty():
        out = df.sparkSession.createDataFrame([(head,)], "value string")
    else:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        out = lines.select(
            F.when(first, F.concat(F.lit(head + "\r\n"), F.col("line"))).otherwise(F.col("line")).alias("value")
        )
    out.write.mode(mode).option("lineSep", "\r\n").text(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring lines as one text, at most a batch or BLOCK_BYTES and a line long."""
    for batch in batches:
        if batch.num_rows:
            lines = batch.column(0).cast(pa.string())
            block = np.cumsum(pc.binary_length(lines).to_numpy(), dtype=np.int64) // BLOCK_BYTES
            cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(lines)).astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), lines), "\r\n")
            yield pa.RecordBatch.from_arrays([texts, pa.array(np.diff(cuts), pa.int64())], ["value", "n"])


def _in_parts(ordered: DataFrame, at: str, keys: list[Column], line: str, parts: int) -> DataFrame:
    """Blocks of lines, a partition for each part, in order.

    Rows are sorted in ranges of a bounded size, as many as the input needs, and written as blocks. A part is some
    neighbouring ranges; its task only puts their blocks in order.
    """
    size = ordered.agg(F.sum(F.octet_length(line) + ROW_BYTES)).first()[0]
    ranges = max(PART_RANGES * parts, -(-size // RANGE_BYTES))
    lines = ordered.repartitionByRange(ranges, F.asc_nulls_first(at)).sortWithinPartitions(*keys).select(line)
    placed = lines.mapInArrow(_blocks, "value string, n long").withColumn("_place", F.monotonically_increasing_id())
    blocks = materialize(placed.withColumn("_range", F.shiftright("_place", 33)), "csv-blocks")
    per_range = blocks.groupBy("_range").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    total = F.sum("n").over(Window.partitionBy())
    part = F.floor(before * parts / total).cast("int").alias("_part")
    dealt = blocks.join(F.broadcast(per_range.select("_range", part)), "_range").repartitionById(parts, "_part")
    return dealt.sortWithinPartitions("_place").select("value")


def write_csv_in_order(
    df: DataFrame, path: str, order_by: str, columns: list[str] | None = None, bom: bool = True, sep_line: bool = True, parts: int | None = None
) -> DataFrame:
    """Spreadsheet CSV as parts that, put together by name, are one file in row order.

    Rows are dealt by ranges of `order_by` and sorted inside a range; rows that tie are next to each other. Where `parts` are
    named, a range is no part but has a bounded size: see `_in_parts`. The first part alone
    starts with the byte-order mark, the `sep=,` line and the header. The last line ends with CRLF too.

    Returns the manifest (part, file, offset, length): at which byte of the one file each part starts, so
    that a copy can be made in any order, by many writers.
    """
    spark = df.sparkSession
    columns = columns or [c for c in df.columns if c not in (ROW_ID, order_by)]
    head = (BOM if bom else "") + ("sep=,\r\n" if sep_line else "") + _header_line(columns)
    at, line, rank = "_at", "_line", "_rank"
    cells = [quote_cell(t) for t in text_columns(df, columns)]
    lines = df.select(name(order_by).alias(at), F.concat_ws(",", *cells).alias(line), F.lit(1).alias(rank))
    # the header is a row before all others, so that it leads the first range, also of an empty table
    first = lines.agg(F.min(at).alias(at)).select(at, F.lit(head).alias(line), F.lit(0).alias(rank))
    keys = [F.asc_nulls_first(at), F.col(rank), F.col(line)]
    if lines.where(F.col(at).isNull()).limit(1).count():
        first = first.withColumn(at, F.lit(None).cast(lines.schema[at].dataType))
    whole = lines.unionByName(first)
    if parts:
        out = _in_parts(whole, at, keys, line, parts)
    else:
        out = whole.repartitionByRange(F.asc_nulls_first(at)).sortWithinPartitions(*keys).select(line)
    out.write.option("lineSep", "\r\n").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(file_uri(F.col("_metadata.file_path")).alias("file"), "length")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return materialize(files.select((F.row_number().over(Window.orderBy("file")) - 1).alias("part"), "file", offset.alias("offset"), "length"), "csv-parts")
