from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelmill.operators.merge import merge_results
from labelmill.operators.row_store import open_rows, store_rows


def as_counts(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_not_shuffled_again(spark, tmp_path, no_broadcast):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("_row_id"), F.col("id").alias("place"))
    store = store_rows(rows, f"{tmp_path}/store", buckets=5)
    for start in (0, 500):
        answers = spark.range(start, start + 300).select(F.col("id").cast("string").alias("_row_id"), (F.col("id") * 2).alias("twice"))
        merged = store.merge(answers)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "hashpartitioning(_row_id" in plan
        assert as_counts(merged.select("_row_id", "place", "twice")) == as_counts(merge_results(rows, answers).select("_row_id", "place", "twice"))


def test_hot_and_missing_ids(spark, tmp_path):
    ids = ["many"] * 400 + ["asked", "none", "it's"] + [None] * 300 + [str(i) for i in range(50)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "_row_id string, `a b` long")
    store = store_rows(rows, f"{tmp_path}/store")
    assert store.hot == ("many",)
    answers = spark.createDataFrame([("asked", i) for i in range(500)] + [("many", 1), ("many", 2), ("it's", 3), ("7", 4), ("gone", 5), (None, 6)], "_row_id string, `A B` long")
    again = open_rows(spark, f"{tmp_path}/store")
    assert (again.schema, again.buckets, again.hot) == (store.schema, store.buckets, store.hot)
    assert as_counts(again.rows()) == as_counts(rows)
    merged = again.merge(answers)
    assert merged.columns == ["_row_id", "a b", "A B_right"]
    found = {}
    for key, value in answers.collect():
        found.setdefault(key, []).append(value)
    want = Counter((key, i, value) for i, key in enumerate(ids) for value in (found.get(key, [None]) if key is not None else [None]))
    assert as_counts(merged) == want


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "_row_id string, x long, part struct<u: int, v: array<string>>")
    store = store_rows(none, f"{tmp_path}/none")
    assert store.merge(spark.createDataFrame([("1", 2)], "_row_id string, y long")).count() == 0
    some = store_rows(spark.createDataFrame([("1", 5)], "_row_id string, x long"), f"{tmp_path}/some")
    assert as_counts(some.merge(spark.createDataFrame([], "_row_id string, x long"))) == Counter([("1", 5, None)])
