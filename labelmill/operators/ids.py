"""Row ids, dense row numbers and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.session import shared_dir
from labelmill.spec import MAX_BATCH_SIZE

ROW_ID = "_row_id"
ROW_NO = "_row_no"
BATCH_NO = "batch_no"

# Row position within a task: the low bits of monotonically_increasing_id.
_POSITION_MASK = (1 << 33) - 1


def id_from_column(df: DataFrame, id_column: str, keep: bool = True, row_id: str = ROW_ID) -> DataFrame:
    """Use an existing column as row id, as text. The column itself stays unless ``keep=False``."""
    if id_column not in df.columns:
        raise SpecError(f"ID column '{id_column}' not found in CSV. Available columns: {', '.join(df.columns)}")
    rest = [F.col(f"`{c}`") for c in df.columns if keep or c != id_column]
    return df.select(F.col(f"`{id_column}`").cast("string").alias(row_id), *rest)


def spread_order(df: DataFrame, order_by: Sequence[str | Column]) -> DataFrame:
    """Sort globally by ``order_by`` so that no key, nor any group of equal rows, has to fit one task.

    Equal keys are ordered by a hash of the whole row, and equal rows by the task they come from: the range partitioning then finds
    borders inside a hot key. All three are the same when a lost task is run again.
    """
    keys = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in order_by]
    names = _free(df, [*(f"_k{i}" for i in range(len(keys))), "_content", "_source"])
    content = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType.simpleString())])
    tagged = df.select("*", *[k.alias(n) for k, n in zip([*keys, content, F.spark_partition_id()], names, strict=True)])
    return tagged.orderBy(*names).drop(*names)


def _free(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names, with underscores in front where the table has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def _hashable(type_name: str) -> bool:
    return "map<" not in type_name and "variant" not in type_name


def assign_ids(df: DataFrame, order_by: Sequence[str | Column] | None = None, offset: int = 1, row_id: str = ROW_ID,
               row_no: str = ROW_NO, staging: str | None = None) -> DataFrame:
    """Number the rows densely from ``offset``: ``row_no`` as long, ``row_id`` as text.

    With ``order_by`` the numbers follow that order and do not depend on how the input is split; without it they follow the
    partitions of the input, with no shuffle.

    The rows are written once, to ``staging`` or the shared folder, together with the task that wrote them and their place in it.
    These two are then facts on disk: the numbers cannot change when an executor is lost or a later job reads the table again. What
    remains is one small aggregate (a count per task, over two narrow columns) and a join that adds each task's offset. No task
    ever sees more than its own share of the rows.
    """
    spark = df.sparkSession
    path = staging or shared_dir(spark, "numbered")
    ordered = spread_order(df, order_by) if order_by else df
    part, pos = _free(df, ["_part", "_pos"])
    placed = ordered.select("*", F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_MASK)).alias(pos))
    placed.write.parquet(path)
    staged = spark.read.schema(placed.schema).parquet(path)
    return _add_offsets(staged, staged, part, pos, offset, row_id, row_no)


def number_files(spark: SparkSession, path: str, offset: int = 1, row_id: str = ROW_ID, row_no: str = ROW_NO) -> DataFrame:
    """Number the rows of a parquet table in file order (by file path, then place in the file), without copying or shuffling it.

    The count per file comes from the file footers. The numbers are stable as long as the files are.
    """
    table = spark.read.parquet(path)
    part, pos = _free(table, ["_part", "_pos"])
    source = table.select("*", F.col("_metadata.file_path").alias(part), F.col("_metadata.row_index").alias(pos))
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias(part))
    return _add_offsets(source, files, part, pos, offset, row_id, row_no)


def _add_offsets(source: DataFrame, counted: DataFrame, part: str, pos: str, offset: int, row_id: str, row_no: str) -> DataFrame:
    """Number by the place within a part and the rows of the parts before. Their offsets are written first: Spark then knows their size
    when it chooses the join."""
    start = _free(source, ["_start"])[0]
    sizes = counted.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    path = shared_dir(source.sparkSession, "offsets")
    rows_before(sizes, part, "n", start).write.parquet(path)
    offsets = source.sparkSession.read.schema(f"`{part}` {sizes.schema[part].dataType.simpleString()}, `{start}` bigint").parquet(path)
    rest = [F.col(f"`{c}`") for c in source.columns if c not in (part, pos)]
    numbered = source.join(offsets, part).withColumn(row_no, F.col(pos) + F.col(start) + F.lit(offset).cast("bigint"))
    return numbered.select(F.col(row_no).cast("string").alias(row_id), row_no, *rest)


def rows_before(sizes: DataFrame, part: str, n: str, name: str) -> DataFrame:
    """For each part, in order, the sum of ``n`` over the parts before it, without a task that sees all parts.

    The parts (distinct) are range-sorted and written with their range; one sum for each range, at most ``spark.sql.shuffle.partitions`` of them,
    is all that comes together, in one small array. Its running sums are joined back, and each range sums up its own parts.
    """
    spark, path = sizes.sparkSession, shared_dir(sizes.sparkSession, "ranges")
    ranged = sizes.select(part, n).orderBy(part).select(part, n, F.spark_partition_id().alias("_range"))
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    sums = stored.groupBy("_range").agg(F.sum(n).alias("sum")).agg(F.array_sort(F.collect_list(F.struct("_range", "sum"))).alias("s"))
    before = F.transform("s", lambda x, i: F.struct(x["_range"].alias("_range"), F.aggregate(F.slice("s", 1, i), F.lit(0).cast("bigint"), lambda t, y: t + y["sum"]).alias("_base")))
    bases = sums.select(F.inline(before))
    within = F.sum(n).over(Window.partitionBy("_range").orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return stored.select("*", F.coalesce(within, F.lit(0)).alias("_within")).join(F.broadcast(bases), "_range").select(part, (F.col("_base") + F.col("_within")).alias(name))


def assign_batches(df: DataFrame, batch_size: int, row_no: str = ROW_NO, offset: int = 1, batch_no: str = BATCH_NO) -> DataFrame:
    """Put rows into batches of ``batch_size`` by their dense number; only the last batch may be short."""
    if not 1 <= batch_size <= MAX_BATCH_SIZE:
        raise SpecError(f"batch_size must be between 1 and {MAX_BATCH_SIZE}")
    number = F.col(row_no) - F.lit(offset).cast("bigint")
    return df.withColumn(batch_no, F.floor(number / F.lit(batch_size)).cast("bigint"))
