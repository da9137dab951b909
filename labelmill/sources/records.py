"""Requests, responses and errors at rest, and the inputs a job takes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.functions.jsondoc import at, parse_exact

#: The most folders that the requests of one job are written to.
MOST_FOLDERS = 200

ERROR_SCHEMA = "_row_id string, custom_id string, error string, content string, raw string"


def as_input(spark: SparkSession, data: Any, columns: Sequence[str] | None = None, required: Sequence[str] | None = None) -> DataFrame:
    """A DataFrame as it is, or a list of dicts as one, of all keys or only ``columns``.

    Each row must have the ``required`` ones (by default all that are taken); others that it lacks are null.
    """
    if isinstance(data, DataFrame):
        return data
    if not isinstance(data, list) or not all(isinstance(r, dict) for r in data):
        raise TypeError(f"Unsupported input type: {type(data)}")
    names = list(columns) if columns is not None else list(dict.fromkeys([*(required or ()), *(k for r in data for k in r)]))
    needed = names if required is None else list(required)
    for i, r in enumerate(data):
        for c in needed:
            if c not in r:
                raise SpecError(f"Row {i} has no column '{c}'")
    if not data:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in names))
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in data], names)


def read_or_empty(spark: SparkSession, path: str, schema: str, format: str) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSONL files as column ``value``."""
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """Write one text column as JSONL."""
    df.select(F.col(column).alias("value")).write.text(path)


def write_requests(requests: DataFrame, path: str, batch_column: str | None = "batch_no", most_folders: int = MOST_FOLDERS) -> None:
    """Write requests as JSONL, each batch in one file of its own, in at most ``most_folders`` folders.

    A run of ``per`` consecutive batches goes to one task, by direct partition number, and the place of a batch in its run is its folder:
    ``per=<per>/place=<place>/part-<task>-...`` then holds just one batch, number ``task * per + place`` (``batch_of_file``), be it full or
    not. ``per`` is 1 as long as there are no more batches than shuffle partitions. Finding the last number reads the batch column alone.
    """
    if batch_column is None or batch_column not in requests.columns:
        write_lines(requests, path, "request")
        return
    batch = F.col(f"`{batch_column}`").cast("bigint")
    first, last, none = requests.agg(F.min(batch), F.max(batch), F.count_if(batch.isNull())).first()
    if none or (first or 0) < 0:
        raise SpecError("Batch numbers must be 0 or more, and no request may be without one")
    batches = (last or 0) + 1
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(1, min(most_folders, -(-batches // tasks)))
    placed = requests.select(F.col("request").alias("value"), batch.alias("_batch")).repartitionById(-(-batches // per), F.floor(F.col("_batch") / per).cast("int"))
    placed.select("value", F.lit(per).alias("per"), (F.col("_batch") % per).cast("int").alias("place")).write.partitionBy("per", "place").text(path)


def batch_of_file() -> Column:
    """The batch of a line that ``write_requests`` wrote, from the file's place; the file source must give ``per`` and ``place``."""
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("bigint")
    return task * F.col("per") + F.col("place")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Written requests with their parts: ids, model, system text, prompt, schema; the batch number where they were written by batch."""
    lines = spark.read.text(path)
    if {"per", "place"} <= set(lines.columns):
        lines = lines.select("value", batch_of_file().alias("batch_no"))
    kept = [c for c in lines.columns if c != "value"]
    docs = lines.filter(F.col("value").rlike(r"(?U)\S")).select(*kept, "value", parse_exact(F.col("value")).alias("doc"))
    doc = F.col("doc")
    return docs.select(
        *kept,
        at(doc, ".custom_id", "string").alias("custom_id"),
        at(doc, ".params.model", "string").alias("model"),
        at(doc, ".params.max_tokens", "bigint").alias("max_tokens"),
        at(doc, ".params.messages[0].content[0].text", "string").alias("system"),
        at(doc, ".params.messages[0].content[0].cache_control.type", "string").alias("cache_control"),
        at(doc, ".params.messages[1].content", "string").alias("prompt"),
        at(doc, ".params.output_format.type", "string").alias("format"),
        at(doc, ".params.output_format.schema", "string").alias("schema"),
        F.col("value").alias("request"),
    )


def write_errors(errors: DataFrame, path: str) -> None:
    """Write error rows as JSONL; no error gives an empty table."""
    errors.write.json(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Written error rows; empty if none were written."""
    return read_or_empty(spark, path, ERROR_SCHEMA, "json")
