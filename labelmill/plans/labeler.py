"""The whole job: prepare, answer, collect."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.functions.template import template_columns
from labelmill.operators import responses as R
from labelmill.operators.cost import estimate_cost
from labelmill.operators.hot import hot_ids, written
from labelmill.operators.ids import ROW_ID, ROW_NO, assign_batches, assign_ids, id_from_column
from labelmill.operators.merge import answered_rows, merge_results, merge_stored, results_ordered, split_parts, unanswered_rows
from labelmill.operators.preflight import preflight_report
from labelmill.operators.requests import Responder, build_requests, infer
from labelmill.session import shared_dir
from labelmill.sources.records import as_input, read_lines, write_lines, write_requests
from labelmill.spec import LabelSpec
from labelmill.streaming.rounds import ROUND, STREAM, add_round, current, history, read_log

#: Whether a stored row is a good answer. No answer field may have this name.
GOOD = "_is_good"

#: How often a row may fail in each way before it is given up.
ATTEMPTS = {"service": 5, "expired": 5, "unanswered": 5, "malformed": 3, "empty": 3, "unreadable": 3, "misfit": 2, "canceled": 1}
ROUND_NAME, ROUND_NO = "asked", "_round_no"


@dataclass(frozen=True)
class Labeled:
    """Rows with ids and their parsed responses; every view is a lazy DataFrame.

    ``seen`` is what was observed while the parsed table was written: good rows, all rows, frequent ids. The summary comes from it without a
    job, and merging knows the hot ids. Good and bad rows lie in folders of their own, so a view reads only its part.
    """

    rows: DataFrame
    parsed: DataFrame
    spec: LabelSpec
    keep_reasoning: bool = True
    seen: dict[str, Any] | None = None
    attempts: DataFrame | None = None

    @property
    def answers(self) -> DataFrame:
        return R.answers(self.parsed.drop(GOOD), self.spec, self.keep_reasoning) if self.seen is None else self._good(self.keep_reasoning)

    def _good(self, keep_reasoning: bool) -> DataFrame:
        return R.answers(self.parsed.where(F.col(GOOD)).drop(GOOD), self.spec, keep_reasoning)

    @property
    def errors(self) -> DataFrame:
        return R.error_rows(self.parsed if self.seen is None else self.parsed.where(~F.col(GOOD)))

    @property
    def summary(self) -> DataFrame:
        return R.results_summary(self.parsed, None if self.seen is None else (self.seen["rows"], self.seen["all"]))

    def require_all(self) -> None:
        """Raise if any row failed."""
        R.require_all(self.parsed, None if self.seen is None else self.seen["all"] - self.seen["rows"])

    def merged(self, on_duplicate: str = "keep", order_answers: Column | None = None) -> DataFrame:
        """All input rows with their answers, null where there is none."""
        if on_duplicate == "keep" and self.seen is not None:
            return merge_stored(self.rows, self.answers, hot_ids(self.seen, split_parts(self.rows)))
        return merge_results(self.rows, self.answers, on_duplicate, order_answers)

    def typed(self) -> DataFrame:
        """Only the declared fields, in row order. Raises if any row failed."""
        self.require_all()
        good = R.answers(self.parsed, self.spec, keep_reasoning=False) if self.seen is None else self._good(False)
        return results_ordered(good).select(*[f"`{f.name}`" for f in self.spec.fields])

    def unanswered(self) -> DataFrame:
        return unanswered_rows(self.rows, self.answers)

    def answered(self) -> DataFrame:
        return answered_rows(self.rows, self.answers)


class Labeler:
    """Labels the rows of a table as a spec asks for."""

    def __init__(self, spec: LabelSpec):
        self.spec = spec

    def preflight(self, df: DataFrame) -> DataFrame:
        return preflight_report(df, self.spec)

    def estimate_cost(self, data: DataFrame | list[dict[str, Any]], spark: SparkSession | None = None, **options: Any) -> DataFrame:
        return estimate_cost(self._input(data, spark), self.spec, **options)

    def number(self, data: DataFrame | list[dict[str, Any]], order_by: Sequence[str | Column] | None = None, offset: int = 1,
               spark: SparkSession | None = None) -> DataFrame:
        """Rows with ids and batches. Ids come from the id column, where the spec names one, else from the rows' numbers."""
        df = self._input(data, spark)
        if ROW_ID in df.columns:
            return df
        numbered = assign_ids(df, order_by, offset)
        if self.spec.id_column is not None:
            numbered = id_from_column(numbered.drop(ROW_ID), self.spec.id_column)
        return assign_batches(numbered, self.spec.batch_size, ROW_NO, offset)

    def requests(self, rows: DataFrame) -> DataFrame:
        return build_requests(rows, self.spec)

    def prepare(self, rows: DataFrame, path: str) -> DataFrame:
        """Write the requests of numbered rows, a file per batch, and return them. Without a responder this is a dry run."""
        requests = self.requests(rows)
        write_requests(requests, path)
        return requests

    def collect(self, rows: DataFrame, lines: DataFrame | str, mode: str = "strict", keep_reasoning: bool = True,
                check_bounds: bool | None = None, store: str | None = None) -> Labeled:
        """Parse responses (a table with ``value``, or a folder of JSONL) for numbered rows.

        They are parsed once and written, good and bad ones apart, to ``store``, a new folder, or the shared folder; all views read that."""
        if isinstance(lines, str):
            lines = read_lines(rows.sparkSession, lines)
        parsed = R.parse_responses(lines, self.spec, mode, check_bounds=check_bounds)
        return self._store(rows, parsed, store or shared_dir(rows.sparkSession, "parsed"), keep_reasoning)

    def _store(self, rows: DataFrame, parsed: DataFrame, path: str, keep_reasoning: bool = True, attempts: DataFrame | None = None) -> Labeled:
        parsed = parsed.withColumn(GOOD, F.col(R.book_column(parsed, "error")).isNull())
        seen = written(parsed, path, F.col(ROW_ID), F.col(GOOD), GOOD)
        return Labeled(rows, rows.sparkSession.read.schema(parsed.schema).parquet(path), self.spec, keep_reasoning, seen, attempts)

    def label(self, data: DataFrame | list[dict[str, Any]], responder: Responder, order_by: Sequence[str | Column] | None = None,
              responses: str | None = None, fail_on_error: bool = False, spark: SparkSession | None = None, **options: Any) -> Labeled:
        """Prepare, answer and collect.

        The responses are written first, to ``responses`` or the shared folder, and all results come from what was written: however
        often they are used, no row is answered again.
        """
        rows = self.number(data, order_by, spark=spark)
        path = responses or shared_dir(rows.sparkSession, "responses")
        write_lines(infer(self.requests(rows), responder), path)
        done = self.collect(rows, path, **options)
        if fail_on_error:
            done.require_all()
        return done

    def label_rounds(self, data: DataFrame | list[dict[str, Any]], responder: Callable[[int], Responder], order_by: Sequence[str | Column] | None = None,
                     limits: Mapping[str, int] | None = None, most_rounds: int = 10, folder: str | None = None, spark: SparkSession | None = None) -> Labeled:
        """Prepare, answer and collect, and ask again for what failed, round by round, until no row is left to ask for.

        ``responder(number)`` gives the responder of a round (from 0). A row is asked for again as long as it has no good answer and the kind
        of its last error (``responses.error_kind``, or ``unanswered``) occurred less often than ``limits`` allows; kinds not named there go by
        ``ATTEMPTS``. Each round's responses are written before they are read, and its parsed rows added to a table with a log
        (``streaming.rounds``): with the same ``folder``, numbered rows and a job that broke off, rounds that are there are not answered again.

        ``attempts`` of the result has a row for each attempt: row id, round, kind and text of the error.
        """
        rows = self.number(data, order_by, spark=spark)
        session, limits = rows.sparkSession, ATTEMPTS | dict(limits or {})
        if unknown := set(limits) - set(ATTEMPTS):
            raise SpecError(f"Unknown kinds of errors: {', '.join(sorted(unknown))}")
        base = folder or shared_dir(session, "rounds")
        pending = rows
        for number in range(most_rounds):
            done = {e.name for e in read_log(session, base)}
            if f"{ROUND_NAME}-{number:012d}" not in done:
                path = f"{base}/responses/{number}-{uuid4().hex}"
                write_lines(infer(self.requests(pending), responder(number)), path)
                add_round(R.parse_responses(read_lines(session, path), self.spec).withColumn(ROUND_NO, F.lit(number)), base, ROUND_NAME, number)
            ids = shared_dir(session, "pending")
            left = written(self._unsettled(rows, history(session, base), number + 1, limits), ids, F.col(ROW_ID))["all"]
            if not left:
                break
            asked = session.read.schema(f"{ROW_ID} string").parquet(ids)
            pending = rows.withColumn(ROW_ID, F.col(ROW_ID).cast("string")).join(asked, ROW_ID, "left_semi").select(*rows.columns)
        parsed = history(session, base)
        attempts = parsed.select(ROW_ID, F.col(ROUND_NO).alias("round"), R.error_kind(parsed).alias("kind"), F.col(R.book_column(parsed, "error")).alias("error"))
        return self._store(rows, current(parsed).drop(ROUND, STREAM, ROUND_NO), f"{base}/settled-{uuid4().hex}", attempts=attempts)

    def _unsettled(self, rows: DataFrame, parsed: DataFrame, rounds: int, limits: Mapping[str, int]) -> DataFrame:
        """Ids of the rows to ask for again. The attempts are combined by row before the shuffle; a row meets one line of the ledger."""
        kind = R.error_kind(parsed)
        tries = [F.count_if(F.col("kind") == k).alias(k) for k in R.ERROR_KINDS]
        ledger = parsed.select(ROW_ID, ROUND_NO, kind.alias("kind")).groupBy(ROW_ID).agg(
            F.bool_or(F.col("kind").isNull()).alias("good"), F.max_by("kind", ROUND_NO).alias("last"), *tries)
        spent = F.lit(False)
        for k in R.ERROR_KINDS:
            spent = F.when(F.col("last") == k, F.col(k) >= limits[k]).otherwise(spent)
        settled = ledger.select(ROW_ID, (F.col("good") | spent).alias("_settled"))
        asked = rows.select(F.col(ROW_ID).cast("string").alias(ROW_ID)).where(F.col(ROW_ID).isNotNull())
        return asked.join(settled, ROW_ID, "left").where(~F.coalesce("_settled", F.lit(rounds >= limits["unanswered"]))).select(ROW_ID).distinct()

    def _input(self, data: DataFrame | list[dict[str, Any]], spark: SparkSession | None) -> DataFrame:
        if isinstance(data, DataFrame):
            return data
        session = spark or SparkSession.getActiveSession()
        if session is None:
            raise SpecError("A list of rows needs a session")
        names = template_columns(self.spec.template) or list(self.spec.columns)
        return as_input(session, data, required=[*names, *([self.spec.id_column] if self.spec.id_column else [])])
