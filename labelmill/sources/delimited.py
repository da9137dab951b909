"""Delimited files: separator sniffing, reading, writing.

Files whose cells may hold line breaks are read in blocks, like any text, by many tasks (``_records``): whether a line begins inside a quoted
cell depends only on how many lines with an odd number of quotes stand before it in its file, odd or even. A first pass over the lines counts
these by block; sums over a file's blocks, one narrow row each, say how many precede every block. Within a block they are counted as the lines are
read (``_lines``), so that no line moves. A second pass parses every record of one line where it lies; only the lines of records that are more
than one are put together again, across blocks too.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.session import shared_dir

# Separators tried, in order of preference.
SEPARATORS = (",", ";", "\t", "|")

# Quotes inside a quoted cell are doubled.
_QUOTING = {"header": True, "quote": '"', "escape": '"'}

# Reading tells a quoted empty cell from a missing one: the latter stands for this text while parsing.
_READING = _QUOTING | {"nullValue": "\ue000"}

# Headers differ by separator and quotes at most; more are no table.
_MOST_HEADERS = 100

# Spark's parser fails on records with more cells.
_MOST_CELLS = 20480

_SPLIT_ANEW = "The files were split for tasks in another way than when they were opened; keep spark.sql.files.* and set spark.sql.files.minPartitionNum"

# Inference takes date-like cells as text: no cell can match this format.
_NO_DATES = {"preferDate": False, "timestampFormat": "'never'yyyy"}


def separator_of(header: str) -> str:
    """The candidate that occurs most often in a header line; the earlier one of equals, a comma if none occurs."""
    header = header.removeprefix("\ufeff")
    best = max(SEPARATORS, key=header.count)
    return best if header.count(best) else ","


def detect_separator(spark: SparkSession, path: str, per_file: bool = False) -> str:
    """Separator of the files at ``path``, from the first file's header line. ``per_file`` looks at every file and wants them equal."""
    files = sorted(spark.read.text(path).inputFiles())
    found = {separator_of(_first_line(spark, f)) for f in (files if per_file else files[:1])}
    if len(found) > 1:
        raise ValueError(f"Files at {path} have different separators: {sorted(found)}")
    return found.pop() if found else ","


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).filter("_metadata.file_block_start = 0").select("value").first()
    return row[0] if row is not None else ""


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None,
                   id_column: str | None = None, multi_line: bool | str = True, sampling_ratio: float = 1.0, infer: bool = True) -> DataFrame:
    """Read delimited files with a header.

    Without ``schema`` the types are inferred: numbers and booleans, all else (dates too) text; without ``infer`` all are text. ``id_column``
    is always read as text, so that leading zeros survive.

    ``multi_line=True``: cells may hold line breaks, if they are quoted, as cells with quotes must be. Files are read by several tasks, and without
    ``sep``, each by the separator its own header shows; their headers must have the same names. ``"whole"`` leaves it to Spark's parser, one task
    for each file, for files that have stray quotes in cells without any. ``False``: no cell holds a line break.
    """
    if multi_line is True:
        return _read_split(spark, path, sep, schema, id_column, sampling_ratio, infer)
    reader = spark.read.options(**_READING, sep=sep or detect_separator(spark, path), multiLine=bool(multi_line))
    if schema is not None:
        return reader.schema(schema).csv(path)
    if not infer:
        return reader.csv(path)
    reader = reader.options(**_NO_DATES)
    inferred = reader.options(inferSchema=True, samplingRatio=sampling_ratio).csv(path)
    if id_column is None or id_column not in inferred.columns:
        return inferred
    fields = [T.StructField(f.name, T.StringType() if f.name == id_column else f.dataType, True) for f in inferred.schema.fields]
    return reader.schema(T.StructType(fields)).csv(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with their file, block and place, whether their quotes are odd and whether they are empty, and the number of odd lines before
    them in their task. A carriage return stays at the end."""
    text = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.when(F.col("_metadata.file_block_start") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(text).alias("value"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    judged = lines.select("*", (quotes % 2).alias("odd"), F.col("value").isin("", "\r").alias("empty"))
    # An odd line stands twice here, so that each one moves the places of all later lines of its task by one more.
    copies = judged.select("*", F.explode(F.when(F.col("odd") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return copies.withColumn("odds", F.monotonically_increasing_id() - F.col("at")).where("copy = 0").drop("copy")


def _staged(df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _blocks(lines: DataFrame) -> DataFrame:
    """``file, block, odd_lines, earlier``: how many odd lines each block has, and those before it in its file; ``first, last, least, most``: the range
    of its lines' ``at`` and ``odds``; ``head, header``: place and text of the first line of each file's first block, null if it has none. Written, as both
    passes and the driver read it."""
    counted = lines.groupBy("file", "block").agg(
        F.sum("odd").alias("odd_lines"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("odds").alias("least"), F.max("odds").alias("most"),
        F.min(F.when((F.col("block") == 0) & ~F.col("empty"), F.col("at"))).alias("head"))
    earlier = F.sum("odd_lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("earlier", F.coalesce(earlier, F.lit(0))).withColumn("head", F.max("head").over(Window.partitionBy("file")))
    blocks = _staged(placed, "blocks")
    headers = lines.join(blocks.where("block = 0").select("head"), F.col("at") == F.col("head")).select("head", F.col("value").alias("header"))
    return _staged(blocks.join(headers, "head", "left"), "blocks")


class _Split(NamedTuple):
    """The lines of the records below the headers, the number of odd ones, the separators that occur, and the columns' names."""

    lines: DataFrame
    odd_lines: int
    seps: list[str]
    names: list[str]


def _split(spark: SparkSession, path: str, sep: str | None) -> _Split:
    """``which`` is the place in ``seps`` of a line's separator; ``before``: the odd lines before it in its file. It begins inside a cell if they are odd."""
    lines = _lines(spark, path)
    blocks = _blocks(lines)
    found = blocks.where("header is not null").groupBy("header").agg(F.sum("odd_lines").alias("odd_lines")).limit(_MOST_HEADERS + 1).collect()
    if not found:
        raise ValueError(f"No header at {path}")
    if len(found) > _MOST_HEADERS:
        raise ValueError(f"Files at {path} have more than {_MOST_HEADERS} different headers")
    own = {r.header: sep or separator_of(r.header) for r in found}
    names = {tuple(_names(h, s)) for h, s in own.items()}
    if len(names) > 1:
        raise ValueError(f"Files at {path} have different columns: {' | '.join(', '.join(n) for n in sorted(names)[:3])}")
    seps = sorted(set(own.values()))
    which = F.lit(0)
    for i, other in enumerate(seps[1:], 1):
        which = F.when(F.col("header").isin([h for h, s in own.items() if s == other]), i).otherwise(which)
    # Tasks must read what they read in the first pass: else the first or the last line of some block is out of its range.
    same = F.col("at").between(F.col("first"), F.col("last")) & F.col("odds").between(F.col("least"), F.col("most"))
    before = F.when(~F.coalesce(same, F.lit(False)), F.raise_error(F.lit(_SPLIT_ANEW)).cast("bigint")).when(
        F.col("header").isNotNull() & (F.col("at") != F.col("head")), F.col("earlier") + F.col("odds") - F.col("least"))
    known = lines.join(blocks, ["file", "block"], "left").select("head", which.alias("which"), "block", "at", "value", "odd", "empty", before.alias("before"))
    return _Split(known.where("before is not null and not (empty and before % 2 = 0)"), sum(r.odd_lines for r in found), seps, list(names.pop()))


def _gathered(split: _Split, alone: Column, parts: Column) -> DataFrame:
    """``which, record``: for every record of one line what ``alone`` says, for every other what the aggregate ``parts`` says. From one odd line to the next,
    both included, is one record: the odd lines before it, halved, tell it from others of its file."""
    single = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    records = split.lines.where(single).select("which", alone.alias("record"))
    if not split.odd_lines:
        return records
    joined = split.lines.where(~single).groupBy("head", "which", F.shiftright("before", 1).alias("pair")).agg(parts.alias("record"))
    return records.unionByName(joined.select("which", "record"))


def _records(split: _Split) -> DataFrame:
    """``which, record``: every record below the headers as text."""
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))  # the lines of one record
    texts = _gathered(split, F.col("value"), F.array_join(F.transform(parts, lambda p: p["value"]), "\n"))
    return texts.withColumn("record", F.regexp_replace("record", "\r$", ""))


def _names(header: str, sep: str) -> list[str]:
    """Column names of a header line; empty and repeated ones are told apart by their place."""
    if header.count('"') % 2:
        raise ValueError("A header over several lines can only be read with multi_line='whole'")
    cells = next(csv.reader([header.removesuffix("\r")], delimiter=sep))
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def _read_split(spark: SparkSession, path: str, sep: str | None, schema: T.StructType | str | None, id_column: str | None, sampling_ratio: float, infer: bool) -> DataFrame:
    split = _split(spark, path, sep)
    records = _records(split)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in split.names])
    if schema is not None:
        return _parsed(records, split.seps, _schema(schema))
    if not infer:
        return _parsed(records, split.seps, texts)
    cells = _parsed(records, split.seps, texts)
    sample = cells if sampling_ratio >= 1 else cells.sample(sampling_ratio, seed=1)
    found = sample.agg(*[_fits(F.col(f"`{n}`")).alias(str(i)) for i, n in enumerate(texts.names)]).first()
    types = [T.StringType() if n == id_column else next((t for bit, t in enumerate(_INFERRED) if (found[i] or 0) >> bit & 1), T.StringType()) for i, n in enumerate(texts.names)]
    return _parsed(records, split.seps, T.StructType([T.StructField(n, t) for n, t in zip(texts.names, types, strict=True)]))


_INFERRED = (T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())

# Numbers that all of the number types take.
_SHORT = r"^[+-]?[0-9]{1,9}\z"

# All that can be cast to a number, and little else: a cast that fails costs many times as much as one that succeeds.
_NUMBER = (r"(?i)^[\x00-\x20]*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?[fd]?|\.[0-9]+(?:e[+-]?[0-9]+)?[fd]?|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[fd]?"
           r"|inf|infinity|nan)[\x00-\x20]*$")


def _fits(cell: Column) -> Column:
    """For each type that is inferred, a bit: whether all cells can be read as it. Null for a column without cells, which is text."""
    whole = F.when(cell.rlike(r"^[+-]?[0-9]+$"), cell).try_cast("bigint")
    integer = F.when(whole.between(-(2**31), 2**31 - 1), 3).when(whole.isNotNull(), 2).otherwise(0)
    double = F.when(cell.try_cast("double").isNotNull() & ~cell.rlike(r"^\s|\s$"), 4).otherwise(0)
    own = F.when(cell.rlike(_SHORT), 7).when(cell.rlike(_NUMBER), integer + double).when(F.lower(cell).isin("true", "false"), 8).otherwise(0)
    return F.bit_and(F.when(cell.isNotNull(), own))


def _schema(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _parsed(records: DataFrame, seps: list[str], schema: T.StructType) -> DataFrame:
    """The cells of the records; each file's separator is that of its header."""
    options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (_READING | _NO_DATES).items() if k != "header"}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

    def cells(sep: str) -> Column:
        return F.from_csv("record", ddl, options | {"sep": sep, "multiLine": "true"})

    parsed = cells(seps[0])
    for i, sep in enumerate(seps[1:], 1):
        parsed = F.when(F.col("which") == i, cells(sep)).otherwise(parsed)
    # The output of a generator: filters on cells stay above, so that each record is parsed once.
    return records.select(F.inline(F.array(parsed)))


def write_delimited(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> None:
    """Write with a header; white space and line breaks inside cells survive. ``single_file`` is for small results only."""
    out = df.coalesce(1) if single_file else df
    out.write.options(**_QUOTING, sep=sep, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


class FileCheck(NamedTuple):
    ok: bool
    message: str
    rows: int
    columns: int


def _counted(spark: SparkSession, path: str, sep: str | None) -> tuple[int, list[str]]:
    """Number of records, names of columns. No cell is wanted, so every record is only counted, and its separators with it; a record that may have more cells than the
    parser takes has all parsed, which fails if it does."""
    split = _split(spark, path, sep)
    marks = F.lit(0)
    for i, own in enumerate(split.seps):
        marks = F.when(F.col("which") == i, F.length("value") - F.length(F.replace("value", F.lit(own), F.lit("")))).otherwise(marks)
    found = _gathered(split, marks.cast("bigint"), F.sum(marks)).agg(F.count("*").alias("rows"), F.max("record").alias("most")).first()
    if (found.most or 0) >= _MOST_CELLS:
        texts = T.StructType([T.StructField(n, T.StringType()) for n in split.names])
        return _parsed(_records(split), split.seps, texts).count(), split.names
    return found.rows, split.names


def check_delimited(spark: SparkSession, path: str, required: Sequence[str], sep: str | None = None, multi_line: bool | str = True) -> FileCheck:
    """Tell whether files can be read and hold the required columns. No types are inferred."""
    try:
        if multi_line is True:
            rows, names = _counted(spark, path, sep)
        else:
            df = read_delimited(spark, path, sep, multi_line=multi_line, infer=False)
            rows, names = df.count(), df.columns
    except (PySparkException, ValueError) as e:
        return FileCheck(False, f"Cannot read the files: {str(e).splitlines()[0]}", 0, 0)
    missing = [c for c in required if c not in names]
    if missing:
        return FileCheck(False, f"Missing columns: {', '.join(missing)}", rows, len(names))
    return FileCheck(True, "", rows, len(names))
