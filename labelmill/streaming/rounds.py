"""A table of parsed responses that grows by rounds: a log of what was added, an upsert by row and batch, compaction.

Layout below the table's folder: ``data/<name>`` holds the rows of one round, ``log/<name>`` one entry that names it. An entry is a single file
that appears by one rename, after its data are complete: that is the commit. A reader sees the rounds whose entries it finds, whole, and
nothing of the others. Nothing is ever overwritten, and a round's entry has a name that its stream and number give, so a round that is run
again finds itself done, also after a compaction.

A compaction adds one more round, with the rows that count and the names of all the rounds it stands for: with its entry, the old ones stop
counting. Readers that began before go on with the old files, which stay until the caller removes them.

The log is read on the driver, as file lists are: an entry for each round since the last compaction, and one for each before.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.errors import LabelError
from labelmill.operators.ids import BATCH_NO, ROW_ID
from labelmill.operators.responses import book_column

#: Columns a round adds to its rows: when it was begun, and who wrote it. Answer fields cannot have these names.
ROUND, STREAM = "_round", "_stream"


@dataclass(frozen=True)
class Entry:
    """One round: its name, its data's folder (none for a round without rows), the rounds it stands for."""

    name: str
    folder: str | None
    replaces: tuple[str, ...] = ()


def read_log(spark: SparkSession, path: str) -> list[Entry]:
    """All entries; none for a table nothing was added to."""
    try:
        lines = spark.read.text(f"{path}/log/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    docs = [json.loads(r.value) for r in lines]
    return sorted((Entry(d["name"], d["folder"], tuple(d["replaces"])) for d in docs), key=lambda e: e.name)


def active(entries: list[Entry]) -> list[Entry]:
    """The rounds that count: those no other round stands for."""
    gone = {name for e in entries for name in e.replaces}
    return [e for e in entries if e.name not in gone]


def _publish(spark: SparkSession, path: str, entry: Entry) -> None:
    line = json.dumps({"name": entry.name, "folder": entry.folder, "replaces": list(entry.replaces)})
    # What a broken attempt left is replaced; a finished entry is never written again.
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/log/{entry.name}")


def add_round(rows: DataFrame, path: str, stream: str, number: int) -> bool:
    """Add the rows of a stream's round, once: False if this round is there already."""
    spark, name = rows.sparkSession, f"{stream}-{number:012d}"
    if any(e.name == name for e in read_log(spark, path)):
        return False
    if taken := {ROUND, STREAM} & {c.lower() for c in rows.columns}:
        raise LabelError(f"Reserved column names: {', '.join(sorted(taken))}")
    folder = f"{path}/data/{name}-{uuid.uuid4().hex}"
    rows.withColumn(ROUND, F.lit(time.time_ns())).withColumn(STREAM, F.lit(name)).write.parquet(folder)
    _publish(spark, path, Entry(name, folder))
    return True


def history(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the rounds that count, with the columns ``_round`` and ``_stream``. The table must have had a round."""
    folders = [e.folder for e in active(read_log(spark, path)) if e.folder]
    if not folders:
        raise LabelError(f"No rounds in {path}")
    return spark.read.option("mergeSchema", False).parquet(*folders)


def _keys(rows: DataFrame) -> list[str]:
    return [ROW_ID, *([BATCH_NO] if BATCH_NO in rows.columns else [])]


def current(rows: DataFrame) -> DataFrame:
    """The row that counts of each row id (and batch, where rows carry one): a good answer before an error, then the latest round.

    Equal ones of a round go by a hash of the row. This is an aggregate, combined before the shuffle, so ids with many rows are no burden.
    """
    keys = _keys(rows)
    rest = [c for c in rows.columns if c not in keys]
    values = F.struct(*[F.col(f"`{c}`") for c in rest])
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if f.name in rest and "variant" not in f.dataType.simpleString()])
    rank = F.struct(F.col(f"`{book_column(rows, 'error')}`").isNull(), ROUND, STREAM, hashed)
    # A null id names no row: its rows are all kept.
    own = F.when(F.col(ROW_ID).isNull(), F.struct(hashed.alias("h"), F.col(STREAM).alias("s")))
    return rows.groupBy(*keys, own.alias("_own")).agg(F.max_by(values, rank).alias("_row")).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*[f"`{c}`" for c in rows.columns])


def compact(spark: SparkSession, path: str) -> int:
    """Replace the rounds that count by one with their current rows; how many were replaced. Rounds added meanwhile are not touched."""
    old = active(read_log(spark, path))
    folders = [e.folder for e in old if e.folder]
    if len(old) < 2 or not folders:
        return 0
    name = f"compacted-{uuid.uuid4().hex}"
    folder = f"{path}/data/{name}"
    current(spark.read.parquet(*folders)).write.parquet(folder)
    _publish(spark, path, Entry(name, folder, tuple(e.name for e in old)))
    return len(old)
