import math
import random

from pyspark.sql import functions as F

from siftline.operators import dedup, ranks
from siftline.plans.profile import Profiler, profile_dataset
from siftline.plans.recipe import Step, apply_recipe
from siftline.sources import csv as source
from siftline.streaming import append_batch_counts, read_counts


def test_rank_selection_is_exact(spark, monkeypatch):
    """The interpolation is a + (b - a) * frac to the last bit, however often buckets are cut."""
    rnd = random.Random(1)
    columns = {
        "a": [rnd.gauss(0, 100) for _ in range(2000)],
        "b": [float(rnd.randint(0, 5)) for _ in range(501)],
        "c": [1.0],
        "d": [4.66, 51.82],
        "e": [float((f << 40) + i) for f in range(8) for i in range(200)],  # clustered as file and position
    }
    points = spark.createDataFrame([(c, x) for c, xs in columns.items() for x in xs], "column string, x double").withColumn("cnt", F.lit(1).cast("bigint"))
    probs = {"p10": 0.1, "q1": 0.25, "median": 0.5, "p99": 0.99}
    want = {}
    for c, xs in columns.items():
        xs = sorted(xs)
        at = [p * (len(xs) - 1) for p in probs.values()]
        want[c] = [xs[math.floor(k)] + (xs[math.ceil(k)] - xs[math.floor(k)]) * (k - math.floor(k)) for k in at]
    for rows in (0, 10, 10**6):
        monkeypatch.setattr(ranks, "SET_ROWS", rows)
        got = {r["column"]: [r[k] for k in probs] for r in ranks.quantiles(points, probs).collect()}
        assert got == want
    assert want["d"][2] == 28.24


def test_dedup(spark):
    rows = [(1, "a", None), (2, "a", ""), (3, "A", ""), (4, "a", "")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string")
    assert sorted(r.id for r in dedup.remove_duplicates(df, "id").collect()) == [1, 3]
    assert sorted(r.id for r in dedup.remove_duplicates(df, "id", keep="last").collect()) == [3, 4]


def test_profile_and_fix(spark):
    rows = [(1, "Indonesia", "x@y"), (2, "indonesia", None), (3, "INDONESIA", ""), (4, "Japan", "z@y")]
    df = spark.createDataFrame(rows, "id bigint, country string, email string")
    before = profile_dataset(df, row_id="id").first()
    assert [i.id for i in before.issues] == ["missing_email", "inconsistent_country"]
    assert 0 <= before.quality_score <= 100
    fixed = apply_recipe(
        df,
        [Step("fill_missing", "email", {"fill_value": "Unknown"}), Step("normalize_text", "country", {"normalizations": ["lowercase"]})],
        "id",
    )
    # both faults are gone; rows 2 and 3 have become equal
    assert [i.id for i in profile_dataset(fixed, row_id="id").first().issues] == ["duplicate_rows"]
    assert apply_recipe(df, [], "id") is df


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'q"x', "l1\nl2"), ("", "é", None), ("c\r\nd", " x ", "n")]
    df = spark.createDataFrame(rows, "id string, name string, z string").coalesce(1)
    source.write_csv(df, str(tmp_path / "o"))
    got = sorted(tuple(r) for r in source.read_csv(spark, str(tmp_path / "o")).collect())
    assert got == sorted(tuple(v or "" for v in r) for r in rows)
    assert source.normalize_columns([" A", "", "A", "B ", ""]) == ["A", "(Unnamed Column 2)", "A (2)", "B"]


def test_stream_counts_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "v string")
    for batch_id in (0, 0, 1):
        append_batch_counts(df, batch_id, str(tmp_path / "c"))
    assert {r.value: r.cnt for r in read_counts(spark, str(tmp_path / "c")).collect()} == {"a": 4, "b": 2}


def test_long_texts_are_counted_by_digest(spark):
    """Same figures as of whole values, and no text in the shuffle that counts."""
    from siftline.operators import stats
    from siftline.operators.freq import LONG, classified, value_freq

    long = ["x" * LONG, "y" * (LONG + 1), " " * 200, "12 " + "z" * 100, "2024-01-01T00:00:00" + "0" * 90, " " * 90 + "yes"]
    rows = [(t, i) for i in range(3) for t in [*long, None, "", "short"]]
    rows += [("same start " + "s" * 80 + f" {i}", i) for i in range(12)] + [(("Same" if i % 2 else "same") + "q" * 99 + " " * i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "t string, n long")
    p = Profiler(df)
    whole = classified(value_freq(df, ["t", "n"]))
    counters = stats.column_counters(whole)
    assert sorted(map(tuple, p.counters.collect())) == sorted(map(tuple, counters.collect()))
    for own, plain in (
        (p.top_values(), stats.top_values(whole, counters)), (p.modes(), stats.modes(whole, counters)),
        (p.inconsistent_groups(), stats.inconsistent_groups(whole, counters)),
    ):
        assert sorted(map(tuple, own.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect())) != []
    assert p.values.agg(F.max(F.length("value")), F.max(F.length("key")), F.max(F.length("form")), F.max(F.length("spelling"))).first()[0] == LONG
    assert max(len(r.key or "") for r in p.values.collect()) <= LONG


def test_row_flags_move_no_rows_for_few_forms(spark, monkeypatch):
    from siftline.operators import rows

    data = [(i, "Ab" if i % 3 else "ab", None if i % 4 else "x", f"{i % 5}") for i in range(60)]
    df = spark.createDataFrame(data, "id long, a string, b string, c string")
    p = Profiler(df, row_id="id")
    flagged = rows.with_inconsistent_flag(df, p, "hit", "id")
    assert "Exchange hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, flagged.collect()))
    assert sum(r[-1] for r in want) == 60
    monkeypatch.setattr(rows, "SENT_FORMS", 0)
    assert sorted(map(tuple, rows.with_inconsistent_flag(df, p, "hit", "id").collect())) == want
