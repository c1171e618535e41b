"""Recipes, suggestions and streams."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftline.operators import clean, rows
from siftline.plans import suggest
from siftline.plans.profile import Profiler
from siftline.plans.planner import counted_recipe, stages, unread
from siftline.plans.recipe import Step, affected_count, apply_recipe, apply_step, as_dict, step_of
from siftline.plans.versions import VersionStore
from siftline.streaming.recipe import dedup_within, stream_recipe
from siftline.functions import cells as rules


def test_median_is_interpolated_to_the_last_bit(spark):
    df = spark.createDataFrame([(1, "4.66"), (2, "51.82"), (3, "n/a")], "id bigint, x string")
    assert clean.fill_with_median(df, "x").where("id = 3").first().x == "28.24"


def test_literals_of_any_length_are_numbers(spark):
    texts = ["0x1234567890abcdef12", "0xFFFFFFFFFFFFFFFFFF", "0b" + "1" * 70, "0o7777777777777777777777", "0x20000000000001", "0x0", "0b" + "0" * 80 + "1",
             "0x80000000000004001", "0x80000000000004000", "0x", "0xg", "12", "1e3", "1,2", "-0x1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(rules.chart_number(F.col("t"))).collect()]
    want = []
    for t in texts:
        try:
            want.append(float(int(t, 0)) if t[:2].lower() in ("0x", "0b", "0o") else float(t))
        except ValueError:
            want.append(None)
    assert got == want


def test_numbers_at_the_start_of_a_text(spark):
    cases = {"12 kg": 12.0, "1,234.5": 1234.5, ",5": 5.0, "+5": 5.0, ".5": 0.5, "1e3": 1000.0, "1e999": None, "-": None, "kg": None, None: None, "5.": 5.0}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r[0] for r in df.select(rules.parse_numeric(F.col("t"))).collect()] == list(cases.values())


def test_steps_are_checked(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "id bigint, x string")
    filled = apply_recipe(df, [Step("fill_missing", "x", {"strategy": "custom", "fill_value": "z"})], "id")
    assert sorted(r.x for r in filled.collect()) == ["a", "z"]
    for bad in ({"strategy": "nonsense"}, {"strategy": "custom"}):
        with pytest.raises(ValueError):
            Step("fill_missing", "x", bad)
    step = Step("convert_type", "x", {"target_type": "date"}, "s", "d", 3)
    assert step_of(as_dict(step)) == step


def test_counts_belong_to_the_version_a_step_sees(spark):
    data = [(1, "1", "A"), (2, "1", "A"), (3, None, " a"), (4, "3", "b"), (5, "5", "b"), (6, "6", "b"), (7, "900", "c")]
    df = spark.createDataFrame(data, "id bigint, n string, t string")
    steps = [Step("remove_duplicates"), Step("fill_missing", "n", {"strategy": "median"}), Step("normalize_text", "t", {"normalizations": ["trim", "lowercase"]}),
             Step("normalize_text", "t", {"normalizations": ["uppercase"]}), Step("remove_outlier_rows", "n"), Step("remove_column", "t")]
    out, counted = counted_recipe(df, steps, "id")
    assert [s.affected_count for s in counted] == [1, 1, 2, 0, 1, 0]
    assert (out.count(), out.columns) == (5, ["id", "n"])
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in apply_recipe(df, steps, "id").collect())


def test_a_recipe_runs_each_dedup_once(spark):
    df = spark.range(50).selectExpr("id", "string(id % 40) as x", "string(id % 40) as y")
    steps = [Step("remove_duplicates"), Step("fill_missing", "x", {"strategy": "median"}), Step("remove_outlier_rows", "x"), Step("remove_duplicates")]
    plan = apply_recipe(df, steps, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("trim(") <= 4
    one = clean.remove_outliers(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("trim(") == 1


def test_suggestion_to_result_with_a_staleness_gate(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "A ", "5"), (3, "b", "7")], "id bigint, t string, n string")
    profile = Profiler(df, "d", row_id="id").profile
    items = [{"title": "t", "reason": "r", "operationType": "fill_missing", "column": "n", "strategy": "mean"},
             {"title": "t", "reason": "r", "operationType": "normalize_text", "column": "t", "strategy": "trim_lowercase"}]
    replies = spark.createDataFrame([("d", 1, json.dumps({"suggestions": items}))], "dataset string, reply_id bigint, reply string")
    now = suggest.fingerprint(df, "d", "c", [], "id").select("dataset", "fingerprint", "content")
    stored = suggest.map_suggestions(suggest.parse_suggestions(replies, ["dataset", "reply_id"]), profile).join(now, "dataset")
    usable = suggest.fresh_only(stored, now).where("step_type is not null").orderBy("id").collect()
    out = apply_recipe(df, [step_of(r.asDict()) for r in usable], "id")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "6"), (2, "a", "5"), (3, "b", "7")]
    later = suggest.fingerprint(out, "d", "c", ["ai_0"], "id")
    assert suggest.fresh_only(stored, later).isEmpty()


def test_flags_and_pages(spark):
    data = [(i, f"name{i % 7}" if i % 5 else (None if i % 2 else " NAME1"), str(i % 10 if i != 33 else 9999)) for i in range(200)]
    df = spark.createDataFrame(data, "id bigint, t string, n string")
    p = Profiler(df, "d", row_id="id")
    flags = {r.id: r for r in rows.row_flags(df, p, "id").collect()}
    assert {i for i, r in flags.items() if r.has_outlier} == {33}
    assert {i for i, r in flags.items() if r.has_missing} == {i for i, t, _ in data if t is None}
    assert {i for i, r in flags.items() if r.has_inconsistent} == {i for i, t, _ in data if (t or "").strip().lower() == "name1"}
    wanted = [i for i, t, _ in data if flags[i].has_inconsistent and "name1" in (t or "")]
    got = rows.find_page(df, p, "id", "inconsistent_values", "NAME1", page=2, size=25).collect()
    both = [i for i, t, _ in data if flags[i].has_inconsistent]
    assert wanted and [r.id for r in got] == both[25:50] and {(r.row_count, r.page_count) for r in got} == {(len(both), -(-len(both) // 25))}


def test_stream_dedup_has_the_batch_key(spark, tmp_path):
    for k, part in enumerate(([(1, "2026-01-01 00:00:00", "a", None), (2, "2026-01-01 00:00:00", "a", "")], [(3, "2026-01-01 00:00:00", "a", ""), (4, "2026-01-01 00:00:01", "a", "")])):
        spark.createDataFrame(part, "id bigint, ts string, x string, y string").selectExpr("id", "timestamp(ts) as ts", "x", "y").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, ts timestamp, x string, y string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = stream_recipe(dedup_within(stream, "ts", "10 minutes", row_id="id"), [Step("normalize_text", "x", {"normalizations": ["uppercase"]})], "id")
    query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and {r.x for r in got} == {"A"} and 4 in {r.id for r in got}


def test_stages_end_where_rows_go():
    steps = [Step("fill_missing", "a"), Step("remove_duplicates"), Step("convert_type", "a"), Step("remove_outlier_rows", "a"), Step("remove_column", "b"),
             Step("remove_outlier_rows", "a", {"row_ids": [1]})]
    assert stages(steps) == [[0], [1], [2, 3], [4], [5]]
    assert unread(["a", "b", "c"], steps[2:]) == ["b"] and unread(["a", "b"], steps) == []


def test_planned_counts_equal_counts_step_by_step(spark):
    rnd = random.Random(4)
    cells = ["1", "2", " 2", "yes", "No", "A", "a ", "", None, "N/A", "2024-01-05", "1/2/2024", "700", "12 kg"]
    data = [(i, *(rnd.choice(cells[:3] + cells[-2:] if k == 0 else cells) for k in range(3)), i % 7) for i in range(120)]
    df = spark.createDataFrame([*data, *[(200 + i, *r[1:]) for i, r in enumerate(data[:30])]], "id bigint, n string, t string, u string, k int")
    make = [
        lambda: Step("remove_duplicates", config={"keep": rnd.choice(["first", "last"])}), lambda: Step("fill_missing", rnd.choice("ntuk"), {"strategy": rnd.choice(["mean", "median", "zero"])}),
        lambda: Step("normalize_text", rnd.choice("tu"), {"normalizations": ["trim", "lowercase"]}), lambda: Step("convert_type", rnd.choice("nt"), {"target_type": rnd.choice(["number", "date", "boolean"])}),
        lambda: Step("remove_outlier_rows", "n"), lambda: Step("remove_column", rnd.choice("uz")), lambda: Step("remove_outlier_rows", "n", {"row_ids": [3, 4, 5]}),
    ]
    for _ in range(2):
        steps = [rnd.choice(make)() for _ in range(6)]
        out, counted = counted_recipe(df, steps, "id")
        version, want = df, []
        for step in steps:
            want.append(affected_count(version, step, "id"))
            version = apply_step(version, step, "id")
        assert [s.affected_count for s in counted] == want, steps
        assert out.columns == version.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, version.collect()), key=repr)


def test_score_is_that_of_the_profile(spark):
    df = spark.createDataFrame([(1, "a", None, "1"), (2, "A ", "5", "2"), (3, "b", "7", "3"), (3, "b", "7", "900")] * 3, "id bigint, t string, n string, x string")
    p = Profiler(df, "d", row_id="id")
    assert tuple(p.score().first()) == tuple(p.profile.select("dataset", "row_count", "column_count", "quality_score").first())


def test_stored_versions_are_reused_and_removed(spark):
    df = spark.createDataFrame([(i, " A" if i % 2 else "b", None if i % 5 else "7") for i in range(20)], "id bigint, t string, n string")
    steps = [Step("normalize_text", "t", {"normalizations": ["trim"]}, "first"), Step("fill_missing", "n", {"fill_value": "0"}), Step("remove_duplicates")]
    with VersionStore(df, "id", keep=3) as store:
        assert store.acquire([]) is df
        for n in (1, 2, 3):
            got = store.acquire(steps[:n])
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, apply_recipe(df, steps[:n], "id").collect()))
        assert store.steps_run == 3
        store.acquire(steps[:2])  # undo
        store.acquire(steps)  # redo
        assert store.steps_run == 3
        changed = [*steps[:2], Step("remove_column", "t")]
        assert store.acquire(changed).columns == ["id", "n"] and store.steps_run == 4
        seen = store.paths()
        assert len(seen) == 4 and all(Path(p.removeprefix("file:")).exists() for p in seen)  # all in use
        for held in (steps[:1], steps[:2], steps[:2], steps, steps):
            store.release(held)
        assert len(store.paths()) == 3 and store.acquire(changed).count() == 20
        renamed = [Step("normalize_text", "t", {"normalizations": ["trim"]}, "other", "name", 9), *steps[1:]]
        store.acquire(renamed)
        assert store.steps_run == 4
        with pytest.raises(ValueError):
            store.acquire([Step("remove_outlier_rows", "n", {"row_ids": df})])
    assert seen and not any(Path(p.removeprefix("file:")).exists() for p in seen)
