import datetime as dt

import pytest
from pyspark.sql import functions as F

from labelmill.operators import batches as B
from labelmill.session import shared_dir
from labelmill.sources.records import write_requests
from labelmill.streaming import progress as G
from tests.test_responses import GOOD, envelope, ok
from tests.test_streams import put

DAY = dt.datetime(2024, 1, 1)


def add(spark, path, rows, kinds):
    spark.createDataFrame([(*r[:-1], DAY + dt.timedelta(hours=r[-1])) for r in rows], kinds).coalesce(1).write.mode("append").parquet(path)


def poll(spark, asked, told, target, state):
    requests = spark.readStream.schema("custom_id string, batch_no bigint, sent_at timestamp").parquet(asked)
    responses = spark.readStream.schema("custom_id string, state string, answered_at timestamp").parquet(told)
    G.stream_outcomes(requests, responses, target, state).awaitTermination()
    got = G.live_status(spark.read.parquet(asked), target)
    return {r.batch_no: (r.status, r.processing, r.succeeded, r.errored, r.expired) for r in got.collect()}


def test_status_follows_the_streams(spark):
    asked, told, target, state = (shared_dir(spark, p) for p in ("asked", "told", "outcomes", "state"))
    q, a = "custom_id string, batch_no bigint, sent_at timestamp", "custom_id string, state string, answered_at timestamp"
    add(spark, asked, [("row_1", 0, 0), ("row_2", 0, 0), ("row_3", 0, 1), ("row_4", 1, 1)], q)
    add(spark, told, [("row_1", "errored", 2), ("row_9", "succeeded", 2)], a)
    assert poll(spark, asked, told, target, state) == {0: ("in_progress", 2, 0, 1, 0), 1: ("in_progress", 1, 0, 0, 0)}
    add(spark, told, [("row_1", "succeeded", 3), ("row_4", "odd", 20)], a)  # a second answer is better; a state of no known name failed
    assert poll(spark, asked, told, target, state) == {0: ("in_progress", 2, 1, 0, 0), 1: ("ended", 0, 0, 1, 0)}
    add(spark, asked, [("row_5", 2, 40)], q)
    add(spark, told, [("row_2", "succeeded", 25), ("row_9", "succeeded", 40)], a)  # an hour too late
    want = {0: ("ended", 0, 1, 0, 2), 1: ("ended", 0, 0, 1, 0), 2: ("in_progress", 1, 0, 0, 0)}
    assert poll(spark, asked, told, target, state) == want
    assert poll(spark, asked, told, target, state) == want  # nothing new, nothing twice
    assert spark.read.parquet(target).count() == 5


def test_nothing_given_out_yet(spark):
    requests = spark.createDataFrame([("row_1", 0)], "custom_id string, batch_no bigint")
    assert [(r.status, r.processing) for r in G.live_status(requests, shared_dir(spark, "none")).collect()] == [("in_progress", 1)]


def test_times_of_files(spark):
    asked, told, target, state = (shared_dir(spark, p) for p in ("asked", "told", "outcomes", "state"))
    lines = [(n, v) for n in (1, 2) for v in (f'{{"custom_id": "row_{n}"}}', f'{{"custom_id": "row_{n}0"}}', "", "broken")]
    write_requests(spark.createDataFrame(lines, "batch_no bigint, request string"), asked)
    put(spark, told, [ok("row_1", GOOD), envelope("row_20", {}), " "])
    G.stream_outcomes(G.request_times(spark, asked), G.response_times(spark, told), target, state).awaitTermination()
    rows = spark.read.parquet(target).orderBy("custom_id").collect()
    assert [(r.custom_id, r.batch_no, r.state) for r in rows] == [("row_1", 1, "succeeded"), ("row_20", 2, "errored")]


def test_log_rows(spark):
    requests = spark.createDataFrame([("row_1", 0), ("row_2", 0)], "custom_id string, batch_no bigint")
    status = B.batch_status(requests, spark.createDataFrame([("row_1", "expired")], "custom_id string, state string"))
    path, at = shared_dir(spark, "log"), F.lit(DAY)
    with pytest.raises(ValueError, match="color_path"):
        B.log_rows(status, F.lit("b"), at, at, color_path=F.lit("x"))
    B.append_batch_log(B.log_rows(status, F.concat(F.lit("b"), "batch_no"), at, at, input_path=F.lit("x")), path)
    row = B.read_batch_log(spark, path).first()
    assert (row.batch_id, row.status, row.total_requests, row.completed_requests, row.failed_requests, row.input_path) == ("b0", "in_progress", 2, 0, 1, "x")
