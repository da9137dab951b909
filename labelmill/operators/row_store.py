"""Input rows kept by row id, so that rounds of answers are merged without moving the rows again.

A store is a folder in the shared file system: ``rows`` holds the rows in buckets of ``_row_id``, ``apart`` those that buckets do not suit, and
``book`` one line that says what is there (it is written last: a store without it is not finished). A merge reads the buckets as they lie
and shuffles the answers alone, into as many parts.

Apart are rows with an id that holds more than a shuffle partition's share of all rows, and rows without an id. Ids with that many answers are
taken out of the buckets when they are merged. Both kinds go through the join that splits hot ids (``operators.hot``).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelmill.errors import SpecError
from labelmill.operators.hot import hot_ids, observed_hot, written
from labelmill.operators.ids import ROW_ID
from labelmill.operators.merge import merge_stored, split_parts
from labelmill.session import shared_dir


@dataclass(frozen=True)
class RowStore:
    """Rows stored by id. ``hot`` are the ids whose rows lie apart, at most ``operators.hot.MOST_HOT``."""

    spark: SparkSession
    path: str
    schema: StructType
    buckets: int
    hot: tuple[str, ...]

    def rows(self) -> DataFrame:
        """All rows."""
        return self._bucketed().unionByName(self._apart())

    def merge(self, answers: DataFrame, suffix: str = "_right") -> DataFrame:
        """``merge_results`` that keeps all answers, for the stored rows: every row stays, in no order, once for each answer to its id.

        The answers are written once; on the way a sketch finds their hot ids.
        """
        path = shared_dir(self.spark, "answers")
        seen = written(answers, path, F.col(ROW_ID))
        stored = self.spark.read.schema(answers.schema).parquet(path)
        split = hot_ids(seen, split_parts(answers))
        aside = _one_of({*self.hot, *split})
        cold = merge_stored(self._bucketed().where(~aside), stored.where(~aside), {}, suffix)
        if self.hot or split:
            hot = self._bucketed().where(aside).unionByName(self._apart().where(F.col(ROW_ID).isNotNull()))
            cold = cold.unionByName(merge_stored(hot, stored.where(aside), split, suffix))
        return cold.unionByName(self._apart().where(F.col(ROW_ID).isNull()), allowMissingColumns=True)

    def _bucketed(self) -> DataFrame:
        return self.spark.table(_registered(self))

    def _apart(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/apart")


def _one_of(ids: set[str]) -> Column:
    return F.coalesce(F.col(ROW_ID).cast("string").isin(sorted(ids)), F.lit(False)) if ids else F.lit(False)


def _registered(store: RowStore) -> str:
    """The name under which the session's catalog knows the buckets: Spark reads buckets as such only from a table."""
    name = f"labelmill_rows_{hashlib.sha256(store.path.encode()).hexdigest()[:24]}"
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in store.schema.fields)
    place = f"{store.path}/rows".replace("\\", "\\\\").replace("'", "\\'")
    store.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({ROW_ID}) INTO {store.buckets} BUCKETS LOCATION '{place}'")
    return name


def store_rows(rows: DataFrame, path: str | None = None, buckets: int | None = None) -> RowStore:
    """Write rows with ids to a new store, by default below the shared folder, in as many buckets as there are shuffle partitions.

    An aggregate over the ids alone finds the hot ones first. Each bucket is one file, written by one task.
    """
    spark = rows.sparkSession
    path, buckets = path or shared_dir(spark, "row-store"), buckets or split_parts(rows)
    if buckets < 1:
        raise SpecError("A store has one bucket at least")
    rows = rows.withColumn(ROW_ID, F.col(ROW_ID).cast("string"))
    counted = rows.agg(*observed_hot(F.col(ROW_ID))).first().asDict()
    store = RowStore(spark, path, rows.schema, buckets, tuple(sorted(hot_ids(counted, split_parts(rows)))))
    aside = _one_of(set(store.hot)) | F.col(ROW_ID).isNull()
    rows.where(aside).write.parquet(f"{path}/apart")
    rows.where(~aside).repartition(buckets, ROW_ID).write.insertInto(_registered(store))
    book = json.dumps({"schema": store.schema.jsonValue(), "buckets": buckets, "hot": store.hot})
    spark.createDataFrame([(book,)], "value string").coalesce(1).write.text(f"{path}/book")
    return store


def open_rows(spark: SparkSession, path: str) -> RowStore:
    """A finished store, also one that another session wrote."""
    book = json.loads(spark.read.text(f"{path}/book").first().value)
    return RowStore(spark, path, StructType.fromJson(book["schema"]), book["buckets"], tuple(book["hot"]))
