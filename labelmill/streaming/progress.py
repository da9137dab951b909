"""Progress of batches while requests go out and responses come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators.batches import batch_status, response_states
from labelmill.operators.ids import BATCH_NO
from labelmill.sources.records import batch_of_file, read_or_empty

SENT, ANSWERED = "sent_at", "answered_at"
#: What a request is whose response did not come in time.
UNANSWERED = "expired"

STATE_SCHEMA = f"custom_id string, {BATCH_NO} bigint, state string"


def request_times(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``custom_id, batch_no, sent_at`` from what ``write_requests`` wrote by batch; the time is that of the file."""
    lines = _lines(spark, "value string, per int, place int", folder, files_per_trigger)
    return lines.select(F.get_json_object("value", "$.custom_id").alias("custom_id"), batch_of_file().alias(BATCH_NO), _file_time().alias(SENT)).where("custom_id is not null")


def response_times(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of ``custom_id, state, answered_at`` from response lines; the answers are not parsed, the time is that of the file."""
    lines = _lines(spark, "value string", folder, files_per_trigger)
    return response_states(lines.select("value", _file_time().alias(ANSWERED)))


def _lines(spark: SparkSession, schema: str, folder: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format("text").load(folder)


def _file_time() -> Column:
    return F.col("_metadata.file_modification_time")


def request_outcomes(requests: DataFrame, responses: DataFrame, deadline: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """``custom_id, batch_no, state`` of each request, once for each response in time, or once as ``expired`` when none came.

    A left outer join of two streams, with watermarks on both: a response counts if it came no later than ``deadline`` after its request
    was sent; a request without one is given out when both streams have passed that time by more than ``late``, and its state is then dropped. The
    state thus holds the requests and responses of ``deadline + late`` at most, by hash of ``custom_id`` over the tasks. If one stream
    stands still, so does the watermark, and what is unanswered stays ``processing``; responses without a request, or out of time, are not counted.
    """
    asked = requests.select("custom_id", BATCH_NO, SENT).withWatermark(SENT, late).alias("q")
    told = responses.select(F.col("custom_id").alias("_answered_id"), "state", ANSWERED).withWatermark(ANSWERED, late)
    in_time = f"custom_id = _answered_id AND {ANSWERED} >= {SENT} AND {ANSWERED} <= {SENT} + INTERVAL {deadline}"
    joined = asked.join(told, F.expr(in_time), "leftOuter")
    state = F.when(F.col("_answered_id").isNull(), UNANSWERED).otherwise(F.col("state"))
    return joined.select("custom_id", BATCH_NO, state.alias("state"))


def stream_outcomes(requests: DataFrame, responses: DataFrame, target: str, checkpoint: str, deadline: str = "24 hours", late: str = "1 hour",
                    available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Append the outcomes of requests to a narrow table as they are known, each once. ``checkpoint`` belongs in the cluster's shared storage."""
    writer = request_outcomes(requests, responses, deadline, late).writeStream.format("parquet").outputMode("append").option("path", target)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def live_status(requests: DataFrame, target: str) -> DataFrame:
    """``batch_status`` of requests by what the stream has given out so far: requests it still waits for are ``processing``.

    Neither responses nor answers are read again, only the ids and states kept."""
    return batch_status(requests, read_or_empty(requests.sparkSession, target, STATE_SCHEMA, "parquet"))
