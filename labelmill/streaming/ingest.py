"""Incremental work: the same expressions over streams of files."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.operators.ids import ROW_ID, id_from_column
from labelmill.operators.merge import merge_results
from labelmill.operators.requests import build_requests
from labelmill.operators.responses import answers, book_column, parse_responses
from labelmill.spec import LabelSpec
from labelmill.streaming.rounds import ROUND, STREAM, add_round, current, history


def _start(writer, available_now: bool, interval: str) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def response_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Response lines from files as they land in a folder."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(folder)


def stream_parse(spark: SparkSession, folder: str, target: str, checkpoint: str, spec: LabelSpec, mode: str = "strict",
                 files_per_trigger: int | None = None, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Parse responses as they land and append them to a parquet table, each line once.

    ``checkpoint`` belongs in the cluster's shared storage: it holds which files are done. Parsing keeps no state.
    """
    parsed = parse_responses(response_stream(spark, folder, files_per_trigger), spec, mode)
    return _start(parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint), available_now, interval)


def stream_requests(rows: DataFrame, spec: LabelSpec, target: str, checkpoint: str, available_now: bool = True,
                    interval: str = "1 minute") -> StreamingQuery:
    """Build requests from a growing input and append them as JSONL.

    The input needs an id column (``spec.id_column``, or ``_row_id`` already there): dense numbers need the whole input.
    """
    if ROW_ID not in rows.columns:
        if spec.id_column is None:
            raise ValueError("A stream of rows needs an id column")
        rows = id_from_column(rows, spec.id_column)
    lines = build_requests(rows, spec).selectExpr("request AS value")
    return _start(lines.writeStream.format("text").option("path", target).option("checkpointLocation", checkpoint), available_now, interval)


def stream_answers(spark: SparkSession, folder: str, target: str, checkpoint: str, spec: LabelSpec, mode: str = "strict",
                   files_per_trigger: int | None = None, available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Keep a table of parsed responses, good and bad, up to date for ``merge_answers`` and ``stream_errors``.

    Each micro-batch is a round of its stream (named after its checkpoint) in the table's log, see ``streaming.rounds``: a batch that is run again
    after a failure finds itself done, several streams can feed one table, and readers see whole rounds only. The expressions are built once.
    """
    own = hashlib.md5(checkpoint.encode()).hexdigest()
    parsed = parse_responses(response_stream(spark, folder, files_per_trigger), spec, mode)
    return _start(parsed.writeStream.foreachBatch(lambda batch, number: add_round(batch, target, own, number) and None).option("checkpointLocation", checkpoint), available_now, interval)


def merge_answers(rows: DataFrame, target: str, spec: LabelSpec, on_duplicate: str = "keep") -> DataFrame:
    """Input rows with the answers stored so far. Of several to one row, ``on_duplicate="keep"`` gives all, ``"first"`` that of the earliest
    round, ``"latest"`` that of the latest; after ``compact``, only the latest is left."""
    stored = history(rows.sparkSession, target)
    if on_duplicate == "latest":
        return merge_results(rows, answers(current(stored), spec).drop(ROUND, STREAM), "error")
    good = answers(stored, spec)
    if on_duplicate == "first":
        return merge_results(rows, good, "first", order_answers=F.struct(ROUND, STREAM)).drop(ROUND, STREAM)
    return merge_results(rows, good.drop(ROUND, STREAM), on_duplicate)


def stream_errors(spark: SparkSession, target: str) -> DataFrame:
    """Error rows of all responses stored so far, with their round (a time in nanoseconds) and stream."""
    stored = history(spark, target)
    failed = stored.filter(F.col(book_column(stored, "error")).isNotNull())
    return failed.select(ROW_ID, *[F.col(book_column(stored, c)).alias(c) for c in ("custom_id", "error", "content", "raw")], STREAM, ROUND)
