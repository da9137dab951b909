"""Response lines to typed answers and row errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.errors import LabelError
from labelmill.functions.conform import NOT_OBJECT, aside, cast_fields, conform_fields, undeclared
from labelmill.functions.constraints import violations
from labelmill.functions.identity import decode_request_id
from labelmill.functions.jsondoc import at, is_blank, is_exact, kind_at, parse_exact
from labelmill.spec import LabelSpec

# Error texts of the taxonomy, and how much of an unreadable answer is kept.
MALFORMED = "Malformed record"
NO_RESULT = "No result in response"
UNKNOWN = "Unknown error"
NO_MESSAGE = "No message in result"
NO_CONTENT = "Empty content in message"
NOT_JSON = "Failed to parse JSON"
CONTENT_CHARS = 200

ROW_ID = "_row_id"
EXTRA = "_extra"
# What a good line is read by; all of it is cast in one go.
_HEAD = "struct<custom_id: string, result: struct<type: string, message: struct<content: array<struct<text: string>>>>>"


_BOOK = ("custom_id", "error", "content", "raw", "state")


def _book_names(taken: list[str]) -> dict[str, str]:
    """What the bookkeeping columns are called beside columns of the given names."""
    used, out = {c.lower() for c in taken}, {}
    for name in _BOOK:
        own = name
        while own in used:
            own = "_" + own
        out[name] = own
    return out


def book_column(parsed: DataFrame, name: str) -> str:
    """The bookkeeping column of parsed responses: the one of this name with most underscores in front."""
    return max((c for c in parsed.columns if c.lstrip("_") == name), key=len)


def nonblank_lines(lines: DataFrame) -> DataFrame:
    """Drop lines of white space only."""
    return lines.filter(F.col("value").rlike(r"(?U)\S"))


def parse_responses(lines: DataFrame, spec: LabelSpec, mode: str = "strict", keep_reasoning: bool = True,
                    check_bounds: bool | None = None) -> DataFrame:
    """One row per response line: ``_row_id``, ``custom_id``, answer fields, ``error``, ``content``, ``raw``, ``state``.

    ``lines`` has a ``value`` column and may carry further columns, which are kept. ``error`` is null for a good answer; then all
    declared fields are typed. ``mode="strict"`` turns an answer that does not fit the declared fields into an error row.
    ``mode="loose"`` never does: fields are cast as far as possible and undeclared ones kept in the VARIANT column ``_extra``. Declared bounds,
    of nested values too, are part of what must fit; ``check_bounds`` says otherwise, by default it is so in strict mode.
    Where an answer field or a carried column has one of the names ``custom_id``, ``error``, ``content``, ``raw`` or ``state``, the
    column of that name here gets underscores in front, as few as it takes.
    ``content`` holds the start of an unreadable answer, ``raw`` the whole line of an error row.

    The result is narrow (no shuffle) and the same over a stream. Each line and each answer is parsed once: both parses sit in
    projections of their own, which the optimizer does not fold into their many users.
    """
    if mode not in ("strict", "loose"):
        raise LabelError("mode must be 'strict' or 'loose'")
    further = [c for c in lines.columns if c not in ("value", "custom_id")]
    fields = spec.answer_fields
    names = _book_names([f.name for f in fields] + further)
    if clash := {c.lower() for c in further} & {f.name.lower() for f in fields}:
        raise LabelError(f"Columns carried along have names of answer fields: {', '.join(sorted(clash))}")
    # What is carried along and what is kept of the line go by names of their own: an answer field may have any name.
    kept, line = [F.col("_line_kept")], F.col("_line_text")
    carried = F.struct(*[F.col(f"`{c}`") for c in further]) if further else F.lit(0)

    enveloped = nonblank_lines(lines).select(carried.alias("_line_kept"), F.col("value").alias("_line_text"))
    enveloped = enveloped.select(*kept, line, parse_exact(line).alias("_env"))
    env = F.col("_env")
    head = F.col("_head")
    headed = enveloped.select(*kept, line, "_env", at(env, "", _HEAD).alias("_head"), is_exact(env, line).alias("_whole"))
    opened = headed.select(
        *kept, line, F.coalesce(head["custom_id"], F.lit("")).alias("_line_id"), head["result"]["type"].alias("_type"),
        F.get(head["result"]["message"]["content"], 0)["text"].alias("_text"), "_whole", "_env",
    )
    faulted = opened.select(*kept, line, "_line_id", "_type", "_text", _envelope_error(env).alias("_fault"))
    text, fault = F.col("_text"), F.col("_fault")
    answered = faulted.select("*", F.when(fault.isNull(), parse_exact(text)).alias("_ans"))

    ans = F.col("_ans")
    if mode == "strict":
        typed = conform_fields(answered, ans, "$[0]", fields, "_misfit")
    else:
        typed = cast_fields(answered, ans, "$[0]", fields)
        typed = typed.select("*", undeclared(ans, "$[0]", fields).alias(EXTRA), _object_only(ans).alias("_misfit"))
    misfit = F.col("_misfit")
    if check_bounds or (check_bounds is None and mode == "strict"):
        # Enumerations are part of strict conformance already.
        broken = F.array_join(violations(fields, enums=mode == "loose"), "; ")
        misfit = F.coalesce(misfit, F.when(broken != "", broken))
    judged = typed.select("*", F.when(fault.isNotNull(), fault).when(~is_exact(ans, text), NOT_JSON).otherwise(misfit).alias("_error"))

    error = F.col("_error")
    shown = fields if keep_reasoning else spec.fields
    out = [F.when(error.isNull(), F.col(f"`{f.name}`")).alias(f.name) for f in shown]
    if mode == "loose":
        out.append(F.when(error.isNull(), F.col(EXTRA)).alias(EXTRA))
    result = F.struct(
        decode_request_id(F.col("_line_id")).alias(ROW_ID), *[F.col(f"_line_kept.`{c}`").alias(c) for c in further], F.col("_line_id").alias(names["custom_id"]), *out,
        error.alias(names["error"]),
        F.when(error == NOT_JSON, F.substring(F.coalesce("_text", F.lit("")), 1, CONTENT_CHARS)).alias(names["content"]),
        F.when(error.isNotNull(), line).alias(names["raw"]),
        F.coalesce("_type", F.lit("errored")).alias(names["state"]),
    )
    # A filter on the result must stay above this line: pushed below the projections, it would repeat the parsing of every row.
    # Filters on what a generator yields are not pushed.
    return judged.select(F.inline(F.array(result)))


def _object_only(ans: Column) -> Column:
    return F.when(~kind_at(ans).startswith("OBJECT"), NOT_OBJECT)


def _envelope_error(env: Column) -> Column:
    """First fault of the envelope, or null. A line with a good answer text passes on the first test and is not looked at again."""
    whole, kind, text = F.col("_whole"), F.col("_type"), F.col("_text")
    return F.when(~(whole & (kind == "succeeded") & text.isNotNull()) | kind.isNull(), aside(F.struct(env.alias("env"), whole, kind), _find_fault))


def _find_fault(line: Column) -> Column:
    env, whole, kind = line["env"], line["_whole"], line["_type"]
    message = F.coalesce(at(env, ".result.error.message", "string"), at(env, ".result.error.error.message", "string"), F.lit(UNKNOWN))
    return (
        F.when(~whole | ~kind_at(env).startswith("OBJECT"), MALFORMED)
        .when(is_blank(env, ".result"), NO_RESULT)
        .when(kind.isNull() | (kind != "succeeded"), message)
        .when(is_blank(env, ".result.message"), NO_MESSAGE)
        .when(is_blank(env, ".result.message.content"), NO_CONTENT)
    )


def answers(parsed: DataFrame, spec: LabelSpec, keep_reasoning: bool = True) -> DataFrame:
    """The good answers: row id, further key columns, typed fields."""
    drop = {book_column(parsed, c) for c in _BOOK} | (set() if keep_reasoning else {f.name for f in spec.reasoning_fields})
    return parsed.filter(F.col(book_column(parsed, "error")).isNull()).select(*[F.col(f"`{c}`") for c in parsed.columns if c not in drop])


def error_rows(parsed: DataFrame) -> DataFrame:
    """The failed rows: ``_row_id``, ``custom_id``, ``error``, ``content``, ``raw``."""
    own = [F.col(book_column(parsed, c)).alias(c) for c in _BOOK[:4]]
    return parsed.filter(F.col(book_column(parsed, "error")).isNotNull()).select(ROW_ID, *own)


# What kinds of errors there are, for rules on what to ask again.
ERROR_KINDS = ("malformed", "empty", "canceled", "expired", "service", "unreadable", "misfit")


def error_kind(parsed: DataFrame) -> Column:
    """The kind of each row's error, null for a good answer: a line or response without what it must have (``malformed``, ``empty``), a request
    that was not worked on (``canceled``, ``expired``) or failed (``service``), an answer that is no JSON (``unreadable``) or not as declared
    (``misfit``)."""
    error, state = F.col(book_column(parsed, "error")), F.col(book_column(parsed, "state"))
    return (
        F.when(error.isNull(), None).when(error == MALFORMED, "malformed").when(error == NO_RESULT, "empty").when(state.isin("canceled", "expired"), state)
        .when(state != "succeeded", "service").when(error.isin(NO_MESSAGE, NO_CONTENT), "empty").when(error == NOT_JSON, "unreadable").otherwise("misfit")
    )


def results_summary(parsed: DataFrame, counts: tuple[int, int] | None = None) -> DataFrame:
    """One row: successes, errors, total and their percentages (0 for an empty input). With ``counts``, successes and total, nothing is read."""
    if counts is not None:
        good, total = counts
        counted = parsed.sparkSession.createDataFrame([(good, total - good, total)], "success_count long, error_count long, total long")
    else:
        error = F.col(book_column(parsed, "error"))
        counted = parsed.agg(
            F.count_if(error.isNull()).alias("success_count"),
            F.count_if(error.isNotNull()).alias("error_count"),
            F.count(F.lit(1)).alias("total"),
        )

    def percent(part: str) -> Column:
        return F.when(F.col("total") > 0, F.col(part) / F.col("total") * 100).otherwise(0.0)

    return counted.select("*", percent("success_count").alias("success_pct"), percent("error_count").alias("error_pct"))


def require_all(parsed: DataFrame, failed: int | None = None) -> None:
    """Raise if any row failed; ``failed`` says how many, where that is known."""
    if failed is None:
        failed = parsed.agg(F.count_if(F.col(book_column(parsed, "error")).isNotNull())).first()[0]
    if failed:
        raise LabelError(f"{failed} row(s) failed. See the error rows for details.")


def reasoning_dropped(df: DataFrame, spec: LabelSpec) -> DataFrame:
    """Take the reasoning columns off a result."""
    return df.drop(*[f.name for f in spec.reasoning_fields])
