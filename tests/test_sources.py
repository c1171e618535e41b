"""CSV folders whose files differ, as bytes on disk."""

import csv
import io
import random

import pytest

import __spark_entry__ as entry
from siftline.sources import csv as source


def folder(tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data.encode() if isinstance(data, str) else data)
    return str(tmp_path)


@pytest.mark.parametrize("multiline", [True, False])
def test_rows_that_equal_the_header_stay(spark, tmp_path, multiline):
    path = folder(tmp_path, a="sep=,\na,b\n1,2\na,b\n3,4\n", b="﻿a,b\r\n5,6\r\na,b\r\n")
    got = sorted((r.a, r.b) for r in source.read_csv(spark, path, multiline=multiline).collect())
    assert got == [("1", "2"), ("3", "4"), ("5", "6"), ("a", "b"), ("a", "b")]


def test_long_header_cell_keeps_all_columns(spark, tmp_path):
    name = "\n".join(f"line {i}" for i in range(100))
    path = folder(tmp_path, a=f'"{name}",b,"c ""q"""\n1,2,3\n"x\ny",5,6\n')
    df = source.read_csv(spark, path)
    assert df.columns == [name, "b", 'c "q"']
    assert sorted(tuple(r) for r in df.collect()) == [("1", "2", "3"), ("x\ny", "5", "6")]


@pytest.mark.parametrize("multiline", [True, False])
def test_files_keep_their_own_headers(spark, tmp_path, multiline):
    path = folder(tmp_path, a="a,b\n1,2\n", b="\n\n", c="x,y,z\n" + "3,4,5\n" * 50)
    with pytest.raises(ValueError, match="different columns"):
        source.read_csv(spark, path, multiline=multiline)
    rows = source.read_csv(spark, path, multiline=multiline, union=True).select("a", "b", "x", "y", "z").collect()
    assert sorted(map(tuple, rows))[-1] == ("1", "2", "", "", "") and len(rows) == 51
    got = {r.file[-5]: (r.ok, r.error, r.row_count) for r in source.validate_load(spark, path, multiline=multiline).collect()}
    assert got == {"a": (True, None, 1), "b": (False, source.UNREADABLE, 0), "c": (True, None, 50)}


@pytest.mark.parametrize("multiline", [True, False])
def test_short_wide_and_blank_rows(spark, tmp_path, multiline):
    path = folder(tmp_path, a="a,,c ,\r\n1\r\n\r\n1,2,3,4,5\r\n,,\r\n")
    df = source.read_csv(spark, path, multiline=multiline)
    assert df.columns == ["a", "(Unnamed Column 2)", "c"]
    assert sorted(map(tuple, df.collect())) == [("", "", ""), ("1", "", ""), ("1", "2", "3")]


def test_folder_without_a_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        source.read_csv(spark, folder(tmp_path, a="\n"))


def test_round_trip_with_quotes_and_breaks(spark, tmp_path):
    rows = [("a,b", 'q"', "x\r\ny"), ("", None, "key"), ("k", "v", "w")]
    df = spark.createDataFrame(rows, "k string, v string, w string")
    source.write_csv(df.coalesce(1), str(tmp_path / "o"))
    got = sorted(tuple(r) for r in source.read_csv(spark, str(tmp_path / "o")).collect())
    assert got == sorted((a, b or "", c) for a, b, c in rows)


def test_rows_do_not_depend_on_the_split_layout(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"{i:02}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(325)))
    for multiline in (False, True):
        df = source.read_csv(spark, str(tmp_path), multiline=multiline)
        confs = {"spark.sql.files.minPartitionNum": "3", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "900"}
        try:
            for key, value in confs.items():
                spark.conf.set(key, value)
            (tmp_path / "00a.csv").write_text("a,b\nx,y\n")
            assert df.count() == df.distinct().count() == 3900
            assert source.read_csv(spark, str(tmp_path), multiline=multiline).count() == 3901
        finally:
            for key in confs:
                spark.conf.unset(key)
            (tmp_path / "00a.csv").unlink()


@pytest.mark.parametrize("multiline", [True, False])
def test_lines_of_blanks_are_rows(spark, tmp_path, multiline):
    df = source.read_csv(spark, folder(tmp_path, a="v\n1\n  \n\n2\n"), multiline=multiline)
    assert sorted(r.v for r in df.collect()) == ["  ", "1", "2"]


def test_many_headers_in_one_scan(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"{i}.csv").write_text(f"k,c{i},d{i % 7}\n{i},own {i},{i % 7}\n")
    df = source.read_csv(spark, str(tmp_path), union=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # the lines, and one row a file on how it starts
    rows = {int(r.k): r for r in df.collect()}
    assert len(df.columns) == 108 and len(rows) == 100
    assert all(rows[i][f"c{i}"] == f"own {i}" and rows[i][f"d{i % 7}"] == str(i % 7) and rows[i][f"c{(i + 1) % 100}"] == "" for i in range(100))


def test_each_file_has_its_own_delimiter(spark, tmp_path):
    path = folder(
        tmp_path, a='k,v\n1,"x;y;z"\n2,b\n', b='k;v\n3;"1,5"\n4;"2,5;3"\n', c="k\tv\n5\ta,b\n6\tc\n", d="sep=|\nk|v\n7|a,b;c\n",
        e='k|v\n8|"line\nbreak, and ""more"""\n', f="k;v\n",
    )
    got = sorted((r.k, r.v) for r in source.read_csv(spark, path).collect())
    assert got == [("1", "x;y;z"), ("2", "b"), ("3", "1,5"), ("4", "2,5;3"), ("5", "a,b"), ("6", "c"), ("7", "a,b;c"), ("8", 'line\nbreak, and "more"')]
    assert {r.file[-5]: r.row_count for r in source.validate_load(spark, path).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1, "f": 0}


@pytest.mark.parametrize("lines, delimiter", [
    (["a,b;c,d", "1,2;3,4"], ","), (["a;b;c", "1,5;2;3", "4;5;6"], ";"), (["only"], ","), ([], ","), (["a\tb", "1\t2"], "\t"), (["a|b|c", "1|2|3"], "|"),
])
def test_guessed_delimiters(lines, delimiter):
    assert source.guess_delimiter(lines) == delimiter


def test_quoted_breaks_over_splits_equal_one_reader(spark, tmp_path):
    rnd = random.Random(5)
    cells = ["plain", "", "with, comma", 'a "quote"', "two\nlines", "crlf\r\ninside", '"', "\n", '\n"\n,', "x" * 300, "tail\n" * 9, ", \n,"]
    want = []
    for f in range(4):
        rows = [[str(f * 1000 + i), *(rnd.choice(cells) for _ in range(3))] for i in range(150)]
        want += rows
        end = "\r\n" if f % 2 else "\n"
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator=end, quoting=csv.QUOTE_ALL if f == 2 else csv.QUOTE_MINIMAL).writerows([["id", "a", "b", "c"], *rows])
        (tmp_path / f"{f}.csv").write_bytes(text.getvalue().encode())
    (tmp_path / "open field.csv").write_text('id,a,b,c\n9000,5" pipe,"x"y,z\n9001,1,2,3\n')
    want += [["9000", '5" pipe', '"x"y', "z"], ["9001", "1", "2", "3"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = source.read_csv(spark, str(tmp_path)).collect()
        status = source.validate_load(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(list, got)) == sorted(want)
    assert sorted(r.row_count for r in status) == [2, 150, 150, 150, 150] and all(r.ok for r in status)


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path):
    path = folder(tmp_path, good='a,b\n"x\ny",2\n', bad='a,b\n1,"2\n3,4\n5,6\n')
    with pytest.raises(ValueError, match="bad.csv"):
        source.read_csv(spark, path)
    got = {r.file.split("/")[-1]: (r.ok, r.error) for r in source.validate_load(spark, path).collect()}
    assert got == {"good.csv": (True, None), "bad.csv": (False, source.UNREADABLE)}


@pytest.mark.parametrize("n", [0, 1, 500])
def test_parts_in_order_are_one_file(spark, tmp_path, n):
    rows = [(i * 3 % 501, f"v {i}", 'q"\r\nx' if i % 50 == 0 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "row long, `na,me` string, w string").repartition(6)
    manifest = source.write_csv_in_order(df, str(tmp_path / "o"), "row", parts=5).orderBy("part").collect()
    files = sorted((tmp_path / "o").glob("part-*"))
    data = b"".join(f.read_bytes() for f in files)
    quoted = {None: "", 'q"\r\nx': '"q""\r\nx"'}
    body = "".join(f"{v},{quoted[w]}\r\n" for _, v, w in sorted(rows, key=lambda r: (r[0], r[1])))
    assert data.decode() == '﻿sep=,\r\n"na,me",w\r\n' + body
    assert [m.file.split("/")[-1] for m in manifest] == [f.name for f in files]
    for m, f in zip(manifest, files):
        assert data[m.offset : m.offset + m.length] == f.read_bytes()
    if n == 500:
        assert len(files) == 5
        again = source.read_csv(spark, str(tmp_path / "o" / "part-00000*"))
        assert again.columns == ["na,me", "w"]


@pytest.fixture
def orders_late(spark, tmp_path):
    """A folder with orders whose only row group lies in none of the scan's first splits."""
    rows = spark.range(1, 3001).selectExpr(
        "id as o_orderkey", "concat(id % 5, '-', md5(string(id))) as o_orderpriority", "'F' as o_orderstatus", "double(id) as o_totalprice"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    confs = {"spark.sql.files.minPartitionNum": "3", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "20000"}
    for key, value in confs.items():
        spark.conf.set(key, value)
    assert min(r[0] for r in spark.read.parquet(str(tmp_path / "orders.parquet")).selectExpr("spark_partition_id()").distinct().collect()) > 0
    yield str(tmp_path)
    for key in confs:
        spark.conf.unset(key)


def test_files_to_validate_all_have_rows(spark, orders_late):
    assert [tuple(r) for r in entry.validate_load(spark, orders_late).collect()] == [(True, 3000)]


def test_good_files_beside_bad_ones_all_have_rows(spark, orders_late):
    got = sorted((r.kind, r.ok, r.row_count) for r in entry.validate_load_bad_files(spark, orders_late).collect())
    assert got == [("bare.csv", False, 0), ("blank.csv", False, 0), ("good.csv", True, 3000), ("open.csv", False, 1), ("other.txt", False, 1)]


def test_documents_are_written_by_a_task_per_split(spark, tmp_path, monkeypatch):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('a\nb', md5(string(id))) as text", "'en' as lang")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    parts, write = [], source.write_csv
    monkeypatch.setattr(source, "write_csv", lambda df, *a, **k: (parts.append(df.rdd.getNumPartitions()), write(df, *a, **k)))
    confs = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "20000"}
    for key, value in confs.items():
        spark.conf.set(key, value)
    try:
        assert entry.read_csv_multiline_split(spark, str(tmp_path)).count() == 4000
    finally:
        for key in confs:
            spark.conf.unset(key)
    assert parts[0] >= 6


def test_parts_in_order_are_sorted_in_small_ranges(spark, tmp_path, monkeypatch):
    written, write = {}, source.materialize
    monkeypatch.setattr(source, "materialize", lambda df, tag: written.setdefault(tag, write(df, tag)))
    monkeypatch.setattr(source, "RANGE_BYTES", 2000, raising=False)
    monkeypatch.setattr(source, "BLOCK_BYTES", 100, raising=False)
    df = spark.range(3000).selectExpr("id as row", "concat('v', id) as v").repartition(5)
    manifest = source.write_csv_in_order(df, str(tmp_path / "o"), "row", parts=2)
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "o").glob("part-*")))
    assert data.decode().split("\r\n")[2:] == [f"v{i}" for i in range(3000)] + [""] and manifest.count() == 2
    sizes = [r["n"] for r in written["csv-blocks"].groupBy("_range").agg({"n": "sum"}).toDF("_range", "n").collect()]
    assert sum(sizes) == 3001 and max(sizes) < 200
