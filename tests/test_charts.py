"""Chart series at their bounds, against plain Python."""

from collections import Counter

import pytest

from siftline.operators import charts, ranks, rows


def test_thirty_and_thirty_one_labels(spark):
    for n in (30, 31, 45):
        data = [(i, f"label{i % n:02d}", str(i % 7)) for i in range(n * 9)] + [(10**6, " N/A ", "1"), (10**6 + 1, None, "2")]
        df = spark.createDataFrame(data, "id bigint, x string, y string")
        got = charts.top_categories(charts.group_aggregate(df, "x", "y", "sum", "id")).orderBy("position").collect()
        sums, first = Counter(), {}
        for i, x, y in data[:-2]:
            sums[x] += int(y)
            first.setdefault(x, i)
        order = sorted(sums, key=lambda x: (-sums[x], first[x], x))
        want = [(x, sums[x]) for x in order] if n <= 30 else [(x, sums[x]) for x in order[:29]] + [("Other", sum(sums[x] for x in order[29:]))]
        assert [(r.label, r.value) for r in got] == want


@pytest.mark.parametrize("n", [499, 500, 501, 4000])
def test_scatter_takes_evenly_spaced_points_of_clustered_ids(spark, monkeypatch, n):
    monkeypatch.setattr(ranks, "SET_ROWS", 50)
    data = [((k % 3 << 40) + k, float(k), float(-k)) for k in range(n)]
    df = spark.createDataFrame(data, "id bigint, a double, b double")
    got = sorted(r.row_id for r in charts.chart_scatter(df, "a", "b", "id").collect())
    ids = sorted(i for i, _, _ in data)
    assert got == (ids if n <= 500 else [ids[int(i * (n / 500))] for i in range(500)])


def test_pages_of_clustered_ids(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SET_ROWS", 20)
    ids = sorted((f << 40) + p for f in range(8) for p in range(300))
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for page in (1, 2, 30, 48, 10**9):
        k = min(page, 48)
        assert [r.id for r in rows.page_rows(df, "id", page, 50).collect()] == ids[(k - 1) * 50 : k * 50]


def test_requests(spark):
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "2"), (3, "a", "5")], "id bigint, x string, y string")
    draw = lambda r: charts.draw(r, df, df.where("id > 1"), "id").collect()
    assert [(r.label, r.value) for r in draw(charts.ChartRequest("bar", "x", "y", "sum"))] == [("a", 6.0), ("b", 2.0)]
    assert [(r.label, r.value) for r in draw(charts.ChartRequest("bar", "x", "y", "sum", cleaned=True))] == [("a", 5.0), ("b", 2.0)]
    assert {r.label for r in draw(charts.default_request("x", "text"))} == {"a", "b"}
    assert charts.default_request("y", "number").chart == "histogram" and charts.default_request("y", "?").chart == "bar"
    assert charts.available_aggregations("bar", True) == ["sum", "mean", "min", "max"] and charts.available_aggregations("donut", True) == ["count"]
    with pytest.raises(ValueError):
        charts.ChartRequest("pie", "x")
    with pytest.raises(ValueError):
        charts.draw(charts.ChartRequest("bar", "x", cleaned=True), df, None, "id")
