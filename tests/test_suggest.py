"""Jobs around suggestions: how the work is dealt."""

from siftline.plans import suggest


def test_replies_of_one_split_are_parsed_by_all_tasks(spark):
    replies = spark.range(100).selectExpr("'d' as dataset", "id as reply_id", """'{"suggestions":[{"title":"t","reason":"r"}]}' as reply""")
    parsed = suggest.parse_suggestions(replies.coalesce(1), ["dataset", "reply_id"])
    assert parsed.rdd.getNumPartitions() == 4 and parsed.count() == 100


def test_accepted_suggestions_are_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    row = ("d", "f", "c", "1", "fill_missing", "a", "0", "", 1)
    schema = "dataset string, fingerprint string, content string, id string, step_type string, step_column string, setting string, description string, affected_count long"
    stored = spark.createDataFrame([row], schema).mapInArrow(counted, schema)
    now = spark.createDataFrame([row[:3]], "dataset string, fingerprint string, content string")
    assert [s.type for s in suggest.accepted_steps(stored, now)] == ["fill_missing"] and runs.value == 1
