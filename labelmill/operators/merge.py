"""Answers back to their rows: joins on the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.errors import LabelError, SpecError
from labelmill.operators.hot import hot_ids, left_join_split, written
from labelmill.operators.ids import ROW_ID, ROW_NO, spread_order
from labelmill.session import shared_dir


def merge_results(rows: DataFrame, answers: DataFrame, on_duplicate: str = "keep", order_answers: Column | None = None,
                  suffix: str = "_right") -> DataFrame:
    """Left join of input rows and answers on ``_row_id``: every input row stays, unanswered ones with null answers.

    An answer column whose name the input has too gets ``suffix``. Several answers to one row: ``on_duplicate="keep"`` gives one
    output row each, ``"first"`` only the least by ``order_answers``, ``"error"`` raises.

    With ``"keep"``, any number of answers can come to one row, and a left join cannot split such an id on the answers' side. So the answers are written
    to the shared folder first; a sketch taken on the way names the ids that are too frequent for one task, and these are split over
    several. Either side is read once.
    """
    if on_duplicate not in ("keep", "first", "error"):
        raise SpecError("on_duplicate must be 'keep', 'first' or 'error'")
    if on_duplicate == "first":
        if order_answers is None:
            raise SpecError("on_duplicate='first' needs order_answers")
        answers = first_answers(answers, order_answers)
    elif on_duplicate == "error":
        twice = answers.groupBy(ROW_ID).count().filter("count > 1").limit(5).collect()
        if twice:
            raise LabelError(f"Several answers to the same row, for example to {', '.join(sorted(str(r[0]) for r in twice))}")
    if on_duplicate != "keep":
        return _text_ids(rows).join(_rename_collisions(rows, answers, suffix), ROW_ID, "left")
    path = shared_dir(rows.sparkSession, "answers")
    seen = written(answers, path, F.col(ROW_ID))
    stored = rows.sparkSession.read.schema(answers.schema).parquet(path)
    return merge_stored(rows, stored, hot_ids(seen, split_parts(rows)), suffix)


def split_parts(df: DataFrame) -> int:
    """Into how many shares a hot id is split at least: one for each shuffle partition."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def merge_stored(rows: DataFrame, stored: DataFrame, hot: dict[str, int], suffix: str = "_right") -> DataFrame:
    """``merge_results`` that keeps all answers, for answers read from files as they are, with their hot ids known (see ``operators.hot``).

    Rows of a hot id are dealt by their place in their file, which equal answers do not share and no retry changes.
    """
    right = _rename_collisions(rows, stored, suffix)
    if not hot:
        return left_join_split(_text_ids(rows), right, ROW_ID, hot, F.lit(0))
    place = "_place"
    while place in rows.columns or place in right.columns:
        place = "_" + place
    numbered = _rename_collisions(rows, stored.select("*", F.col("_metadata.row_index").alias(place)), suffix)
    right = numbered.select(*[f"`{c}`" for c in right.columns], place)
    return left_join_split(_text_ids(rows), right, ROW_ID, hot, F.col(place)).drop(place)


def _rename_collisions(rows: DataFrame, answers: DataFrame, suffix: str) -> DataFrame:
    taken = {c.lower() for c in rows.columns}
    names = []
    for c in answers.columns:
        name = c
        while c != ROW_ID and name.lower() in taken:
            name += suffix
        taken.add(name.lower())
        names.append(F.col(f"`{c}`").cast("string").alias(name) if c == ROW_ID else F.col(f"`{c}`").alias(name))
    return answers.select(*names)


def first_answers(answers: DataFrame, order: Column) -> DataFrame:
    """One answer per row id: the least by ``order``, ties by a hash of the answer. Combined before the shuffle, so a hot id is no burden."""
    rest = [F.col(f"`{c}`") for c in answers.columns if c != ROW_ID]
    ranked = answers.select(ROW_ID, F.struct(*rest).alias("_row"), F.struct(order.alias("o"), F.xxhash64(*[c.cast("string") for c in rest]).alias("h")).alias("_rank"))
    return ranked.groupBy(ROW_ID).agg(F.min_by("_row", "_rank").alias("_row")).select(ROW_ID, "_row.*")


def _text_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn(ROW_ID, F.col(ROW_ID).cast("string"))


def unanswered_rows(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows without a good answer: the input of the next round."""
    return _text_ids(rows).join(_text_ids(answers).select(ROW_ID).distinct(), ROW_ID, "left_anti")


def answered_rows(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with a good answer."""
    return _text_ids(rows).join(_text_ids(answers).select(ROW_ID).distinct(), ROW_ID, "left_semi")


def union_rounds(*rounds: DataFrame) -> DataFrame:
    """Answers of several rounds in one table; columns a round lacks are null there."""
    if not rounds:
        raise SpecError("union_rounds needs at least one table")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def results_ordered(answers: DataFrame) -> DataFrame:
    """Answers in row order: by row number as a number, ids that are none after them by text."""
    if ROW_NO in answers.columns:
        return spread_order(answers, [ROW_NO])
    number = F.col(ROW_ID).try_cast("bigint")
    return spread_order(answers, [number.isNull(), number, F.col(ROW_ID)])
