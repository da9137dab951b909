"""Batches: their progress, their log of states, and the list of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.ids import BATCH_NO
from labelmill.operators.responses import nonblank_lines
from labelmill.sources.records import read_or_empty

# Service states a batch keeps, what any other becomes, and those that end it.
SERVICE_STATUS = {"in_progress": "in_progress", "ended": "ended", "canceled": "canceled", "errored": "errored"}
OTHER_STATUS = "pending"
DONE_STATUS = ("ended", "canceled", "errored")

# States of a request.
REQUEST_STATES = ("processing", "succeeded", "errored", "canceled", "expired")

# Display of the list.
SHOWN_ID_CHARS = 26
SHOWN_TIME = "yyyy-MM-dd HH:mm"
LISTED_BATCHES = 20

LOG_SCHEMA = (
    "batch_id string, status string, created_at timestamp, updated_at timestamp, "
    "total_requests bigint, completed_requests bigint, failed_requests bigint, "
    "config_path string, input_path string, requests_path string, responses_path string, errors_path string"
)


def batch_state(service_status: Column) -> Column:
    """Status of a batch from the service's word for it."""
    return F.when(service_status.isin(*SERVICE_STATUS), service_status).otherwise(OTHER_STATUS)


def is_done(status: Column) -> Column:
    return F.coalesce(status.isin(*DONE_STATUS), F.lit(False))


def progress(succeeded: Column, errored: Column, total: Column) -> Column:
    """Share of requests that succeeded or failed; canceled and expired ones do not count as progress."""
    return F.when(total > 0, (succeeded + errored) / total).otherwise(0.0)


def batch_status(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Request counts per batch and state, with status, ``is_done`` and ``progress``.

    ``requests`` has ``custom_id`` and ``batch_no``; ``responses`` has ``custom_id`` and ``state``, and ``batch_no`` where a row may be
    in several batches (``response_states`` reads these from lines without parsing the answers). A request without a response is
    ``processing``. Several responses to a request count once, by the best state. They are combined before the shuffle that the join
    then uses too.
    """
    best = F.min(F.when(F.col("state") == "succeeded", "0succeeded").otherwise(F.concat(F.lit("1"), F.col("state"))))
    keys = ["custom_id", BATCH_NO] if BATCH_NO in responses.columns else ["custom_id"]
    one = responses.groupBy(*keys).agg(best.alias("_best"))
    known = F.expr("substring(_best, 2)")
    state = F.when(F.col("_best").isNull(), "processing").when(known.isin(*REQUEST_STATES), known).otherwise("errored")
    joined = requests.select("custom_id", BATCH_NO).join(one, keys, "left").select(BATCH_NO, state.alias("state"))
    counted = joined.groupBy(BATCH_NO).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in REQUEST_STATES]
    )
    status = F.when(F.col("processing") == 0, "ended").otherwise("in_progress")
    return counted.withColumn("status", status).select(
        BATCH_NO, "status", "total", *REQUEST_STATES,
        is_done(F.col("status")).alias("is_done"),
        progress(F.col("succeeded"), F.col("errored"), F.col("total")).alias("progress"),
    )


def response_states(lines: DataFrame) -> DataFrame:
    """``custom_id``, ``state`` and the further columns of response lines, read from the envelope alone; the answers are not parsed."""
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in ("value", "custom_id", "state")]
    head = F.from_json("value", "custom_id string, result struct<type: string>")
    read = nonblank_lines(lines).select(*kept, head.alias("_head"))
    return read.select(*kept, F.coalesce("_head.custom_id", F.lit("")).alias("custom_id"), F.coalesce("_head.result.type", F.lit("errored")).alias("state"))


def log_rows(status: DataFrame, batch_id: Column, created_at: Column, updated_at: Column, **paths: Column) -> DataFrame:
    """Rows for the log from what ``batch_status`` gives: one for each batch, with the counts of its succeeded and of its failed requests
    (errored, canceled and expired ones). The four arguments and ``paths`` (columns of the log) may refer to the columns of ``status``."""
    unknown = set(paths) - {f.split()[0] for f in LOG_SCHEMA.split(", ") if f.split()[0].endswith("_path")}
    if unknown:
        raise ValueError(f"The log has no columns {', '.join(sorted(unknown))}")
    own = {
        "batch_id": batch_id, "status": batch_state(F.col("status")), "created_at": created_at, "updated_at": updated_at, "total_requests": F.col("total"),
        "completed_requests": F.col("succeeded"), "failed_requests": F.col("errored") + F.col("canceled") + F.col("expired"), **paths,
    }
    return status.select(*[own.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in (f.split() for f in LOG_SCHEMA.split(", "))])


def append_batch_log(changes: DataFrame, path: str) -> None:
    """Add state changes of batches to the log. The log only grows; the latest row of a batch is its state."""
    changes.select(*[f.split()[0] for f in LOG_SCHEMA.split(", ")]).write.mode("append").parquet(path)


def read_batch_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged states; empty if nothing was logged yet."""
    return read_or_empty(spark, path, LOG_SCHEMA, "parquet")


def latest_batches(log: DataFrame) -> DataFrame:
    """The latest state of each batch, combined before the shuffle."""
    rest = [c for c in log.columns if c != "batch_id"]
    newest = F.max_by(F.struct(*rest), F.struct("updated_at", F.xxhash64(*rest)))
    return log.groupBy("batch_id").agg(newest.alias("s")).select("batch_id", *[F.col(f"s.{c}").alias(c) for c in rest])


def batch_list(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Batches newest first, formatted for display: all of them, or the ``limit`` newest."""
    newest = latest_batches(log).orderBy(F.desc("created_at"), "batch_id")
    if limit is not None:
        newest = newest.limit(limit)
    done, total = F.col("completed_requests"), F.col("total_requests")
    percent = F.concat(F.bround(done / total * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    return newest.select(
        F.substring("batch_id", 1, SHOWN_ID_CHARS).alias("batch"),
        "status",
        F.date_format("created_at", SHOWN_TIME).alias("created"),
        F.concat(done.cast("string"), F.lit("/"), total.cast("string")).alias("requests"),
        F.when(total > 0, percent).otherwise("-").alias("progress"),
    )
