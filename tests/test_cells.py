from pyspark.sql import functions as F

from siftline import functions as f


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_missing(spark):
    yes = ["", " N/A ", "na", "NULL", "nil", "-", "—", ".", "?", "\t ", None]
    assert apply(spark, f.is_missing, yes) == [True] * len(yes)
    assert apply(spark, f.is_missing, ["unknown", "none", "0"]) == [False] * 3


def test_numbers(spark):
    texts = ["1,234.5", "+5", "1e3", ".5", "12 kg", "Infinity", "1e999", "x"]
    assert apply(spark, f.parse_numeric, texts) == [1234.5, 5.0, 1000.0, 0.5, 12.0, None, None, None]
    assert apply(spark, f.chart_number, texts) == [None, 5.0, 1000.0, 0.5, None, None, None, None]
    assert apply(spark, f.chart_number, ["0x1F", "5."]) == [31.0, 5.0]
    assert apply(spark, f.looks_numeric, ["1,234.5", "+5", "1e3", ".5", "-3"]) == [True, False, False, False, True]


def test_dates(spark):
    texts = ["2024-1-5", "2024/01/05", "1/5/2024", "1/15/2024", "01-05-2024", "2024-01-05T10:11", "2024-02-31", "13/02/2024", "2024"]
    d = "2024-01-05"
    assert apply(spark, f.to_iso_date, texts) == [d, d, d, "2024-01-15", d, d, None, None, None]


def test_texts(spark):
    assert apply(spark, f.title_case, ["(hello) world", "élan", "a-B c"]) == ["(Hello) World", "éLan", "A-b C"]
    assert apply(spark, f.js_trim, [" x﻿"]) == ["x"]
    assert apply(spark, f.to_bool_token, [" YES ", "0", "maybe"]) == ["true", "false", None]


def test_number_text(spark):
    texts = ["1", "1e7", "1e21", "1.5e-7", "1e-6", "0.0001234", "-1e20", "123456789012.5"]
    got = apply(spark, lambda c: f.number_text(c.cast("double")), texts)
    assert got == ["1", "10000000", "1e+21", "1.5e-7", "0.000001", "0.0001234", "-100000000000000000000", "123456789012.5"]


def test_rounding(spark):
    assert apply(spark, lambda c: f.fixed_one(c.cast("double")), ["1.45", "0.25", "-0.04", "9.96"]) == ["1.4", "0.3", "-0.0", "10.0"]
    assert apply(spark, lambda c: f.round_half_up(c.cast("double"), 0), ["-2.5", "2.5"]) == [-2.0, 3.0]
