"""Ids that hold a large share of a table: found in the pass that writes it, split over tasks when it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The most ids that are ever called hot. They are all that reaches the driver or is broadcast.
MOST_HOT = 1000


def observed_hot(id_column: Column, kept: Column | None = None) -> list[Column]:
    """Metrics for ``observe``: the rows counted, and a sketch of the most frequent ids (an aggregate of bounded size)."""
    kept = F.lit(True) if kept is None else kept
    known = F.when(kept & id_column.isNotNull(), id_column.cast("string"))
    return [F.count_if(kept).alias("rows"), F.call_function("approx_top_k", known, F.lit(MOST_HOT), F.lit(10 * MOST_HOT)).alias("frequent")]


def hot_ids(metrics: dict, parts: int) -> dict[str, int]:
    """The ids that hold more than one of ``parts`` equal shares of the rows, and into how many such shares each is to be split.

    The sketch names only ids that occur, so a hot id is known to have rows. Its counts are estimates; they decide on the plan alone.
    """
    share = max(metrics["rows"] / parts, 1.0)
    found = {r["item"]: -(-r["count"] // share) for r in metrics["frequent"] or [] if r["item"] is not None and r["count"] > share}
    return {k: int(n) for k, n in found.items()}


def written(df: DataFrame, path: str, id_column: Column, kept: Column | None = None, partition_by: str | None = None) -> dict:
    """Write a table and return what was observed on the way: its rows (``kept`` ones) and their most frequent ids."""
    seen = Observation()
    observed = df.observe(seen, *observed_hot(id_column, kept), F.count(F.lit(1)).alias("all"))
    writer = observed.write.partitionBy(partition_by) if partition_by else observed.write
    writer.parquet(path)
    return seen.get


def _hot_table(spark: SparkSession, hot: dict[str, int], name: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(hot.items()), f"`{name}` string, _salts int"))


def left_join_split(left: DataFrame, right: DataFrame, key: str, hot: dict[str, int], number: Column) -> DataFrame:
    """Left outer join in which the right side's hot ids are spread over as many groups as ``hot`` says, by ``number``, a column of the
    right side that spreads its rows and does not change on retry (it is dropped).

    A left row with a hot id has a copy for each group. Hot ids are known to have rows on the right: so a copy that found none is dropped, and
    another one found some. Rows of other ids have one copy, which stays, matched or not.
    """
    spark = left.sparkSession
    columns = [*left.columns, *[c for c in right.columns if c != key]]
    if not hot:
        return left.join(right, key, "left").select(*[F.col(f"`{c}`") for c in columns])
    salts = F.coalesce("_salts", F.lit(1))
    spread = right.withColumn("_number", number).join(_hot_table(spark, hot, key), key, "left")
    spread = spread.withColumn("_salt", F.pmod("_number", salts).cast("int")).drop("_number", "_salts").withColumn("_found", F.lit(True))
    copies = left.join(_hot_table(spark, hot, key), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = copies.join(spread, [key, "_salt"], "left").where(F.col("_salts").isNull() | F.col("_found"))
    return joined.select(*[F.col(f"`{c}`") for c in columns])
