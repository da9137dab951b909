import pytest
from pyspark.sql import functions as F

from labelmill.session import shared_dir
from labelmill.streaming import ingest as T
from tests.test_responses import GOOD, PARCELS, envelope, ok


def put(spark, folder, lines):
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(folder)


def test_files_are_parsed_once(spark):
    source, target, state = (shared_dir(spark, p) for p in "abc")
    put(spark, source, [ok("row_1", GOOD), envelope("row_2", {})])
    T.stream_parse(spark, source, target, state, PARCELS).awaitTermination()
    put(spark, source, [ok("row_3", GOOD)])
    for _ in range(2):
        T.stream_parse(spark, source, target, state, PARCELS).awaitTermination()
    got = spark.read.parquet(target)
    assert sorted((r._row_id, r.error) for r in got.collect()) == [("1", None), ("2", "No result in response"), ("3", None)]


def test_merge_grows(spark):
    source, target, state = (shared_dir(spark, p) for p in "abc")
    rows = spark.range(4).select(F.col("id").cast("string").alias("_row_id"))
    put(spark, source, [ok("row_1", GOOD), envelope("row_2", {})])
    T.stream_answers(spark, source, target, state, PARCELS).awaitTermination()
    assert T.merge_answers(rows, target, PARCELS).filter("bulk IS NOT NULL").count() == 1
    put(spark, source, [ok("row_2", GOOD), ok("row_1", GOOD | {"bulk": "large"})])
    T.stream_answers(spark, source, target, state, PARCELS).awaitTermination()
    merged = T.merge_answers(rows, target, PARCELS, on_duplicate="first")
    assert sorted((r._row_id, r.bulk) for r in merged.collect()) == [("0", None), ("1", "small"), ("2", "small"), ("3", None)]
    assert T.merge_answers(rows, target, PARCELS).count() == 5


def test_streams_share_a_table(spark):
    target = shared_dir(spark, "shared")
    for i, line in enumerate([ok("row_1", GOOD), envelope("row_2", {})]):
        source, state = shared_dir(spark, "lines"), shared_dir(spark, "state")
        put(spark, source, [line])
        for _ in range(2):
            T.stream_answers(spark, source, target, state, PARCELS).awaitTermination()
    rows = spark.range(3).select(F.col("id").cast("string").alias("_row_id"))
    assert T.merge_answers(rows, target, PARCELS).filter("bulk IS NOT NULL").count() == 1
    assert [(r._row_id, r.error) for r in T.stream_errors(spark, target).collect()] == [("2", "No result in response")]


def test_a_stream_needs_ids(spark):
    rows = spark.readStream.schema("text string").json(shared_dir(spark, "none") + "*")
    with pytest.raises(ValueError, match="id column"):
        T.stream_requests(rows, PARCELS, "t", "c")
