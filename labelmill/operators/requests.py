"""Requests: one JSON document per row, and the responder that answers them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.functions.cells import NULL_TEXT
from labelmill.functions.identity import encode_request_id
from labelmill.functions.template import render_prompt, template_columns
from labelmill.operators.ids import BATCH_NO, ROW_ID, ROW_NO
from labelmill.spec import LabelSpec

Responder = Callable[[list[dict[str, Any]]], Iterable[Any]]


def prompt_columns(spec: LabelSpec) -> list[str]:
    """The input columns a job reads: those its spec names, else those its template names."""
    return list(spec.columns) if spec.columns is not None else template_columns(spec.template)


def project_columns(df: DataFrame, columns: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Only the job's columns, and ``keep`` where present. Columns that do not exist are an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SpecError(f"Missing columns: {', '.join(missing)}")
    wanted = list(dict.fromkeys([c for c in keep if c in df.columns] + list(columns)))
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def request_json(request_id: Column, prompt: Column, spec: LabelSpec) -> Column:
    """The request document as JSON text.

    All that is the same for every row is one literal before and one behind; only the id and the prompt are encoded per row. The
    system text is marked as cacheable, and the order of the schema's fields is kept.
    """
    system = {"role": "user", "content": [{"type": "text", "text": spec.system, "cache_control": {"type": "ephemeral"}}]}
    output = {"type": "json_schema", "schema": spec.json_schema()}
    head = (
        f', "params": {{"model": {_dump(spec.model)}, "max_tokens": {spec.max_tokens}, '
        f'"messages": [{_dump(system)}, {{"role": "user", "content": '
    )
    tail = f'}}], "output_format": {_dump(output)}}}}}'
    return F.concat(F.lit('{"custom_id": '), _json_text(request_id), F.lit(head), _json_text(prompt), F.lit(tail))


def _dump(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def _json_text(text: Column) -> Column:
    # {"t":"..."} without the five characters before the text and the one behind.
    doc = F.to_json(F.struct(text.alias("t")))
    return F.substring(doc, F.lit(6), F.length(doc) - 6)


def build_requests(df: DataFrame, spec: LabelSpec, row_id: str = ROW_ID, null_text: str = NULL_TEXT) -> DataFrame:
    """``_row_id``, ``custom_id``, ``prompt`` and ``request`` (JSON text) per row; row and batch numbers are kept if present.

    Narrow, so it runs the same over a stream. Unused columns never leave the scan.
    """
    if row_id not in df.columns:
        raise SpecError(f"Rows need the id column '{row_id}'; see assign_ids and id_from_column")
    columns = prompt_columns(spec)
    source = project_columns(df, columns, keep=(row_id, ROW_NO, BATCH_NO))
    numbers = [c for c in (ROW_NO, BATCH_NO) if c in source.columns]
    rendered = source.select(
        F.col(row_id).cast("string").alias(ROW_ID), *numbers,
        encode_request_id(F.coalesce(F.col(row_id).cast("string"), F.lit(null_text))).alias("custom_id"),
        render_prompt(source, spec.template, columns, null_text).alias("prompt"),
    )
    return rendered.withColumn("request", request_json(F.col("custom_id"), F.col("prompt"), spec))


def infer(requests: DataFrame, responder: Responder, batch_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """Answer requests with a user's function; gives ``custom_id`` and ``value`` (the response line).

    ``responder`` gets the parsed requests of one Arrow batch and returns or yields one item for each, in order: the answer as text
    or as a dict, a whole response (a dict with ``result``), or an exception object for a row that failed. If it raises, the rows
    it had not yet answered become error responses: a failing row never fails the task, so answers already paid for are not
    asked for again; so does an answer that cannot be written as JSON, and all rows of a batch that gets too many answers.
    ``partitions`` sets how many batches are answered side by side. A lost executor can still make a batch be answered twice, so write the result before doing more with it.
    """
    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows or max(len(pdf), 1)):
                part = pdf.iloc[start : start + batch_rows] if batch_rows else pdf
                docs = [json.loads(r) for r in part["request"]]
                yield pd.DataFrame({"custom_id": part["custom_id"].to_list(), "value": _response_lines(part["custom_id"], docs, responder)})

    asked = requests.select("custom_id", "request")
    if partitions:
        asked = asked.repartition(partitions)
    return asked.mapInPandas(answer, "custom_id string, value string")


def _response_lines(ids: Iterable[str], docs: list[dict[str, Any]], responder: Responder) -> list[str]:
    results: list[Any] = []
    try:
        for item in responder(docs):
            results.append(item)
    except Exception as e:  # noqa: BLE001 - any failure of the user's function becomes error rows
        results += [e] * (len(docs) - len(results))
    if len(results) > len(docs):  # which answer belongs to which request can no longer be told
        results = [RuntimeError("More answers than requests from responder")] * len(docs)
    results += [RuntimeError("No answer from responder")] * (len(docs) - len(results))
    return [_guarded_line(i, r) for i, r in zip(ids, results, strict=True)]


def _guarded_line(request_id: str, result: Any) -> str:
    try:
        return _response_line(request_id, result)
    except (TypeError, ValueError, RecursionError) as e:
        return _response_line(request_id, RuntimeError(f"Answer is not JSON: {e}"))


def _response_line(request_id: str, result: Any) -> str:
    if isinstance(result, BaseException):
        body: dict[str, Any] = {"type": "errored", "error": {"message": str(result) or type(result).__name__}}
    elif isinstance(result, dict) and "result" in result:
        body = result["result"]
    else:
        text = result if isinstance(result, str) else json.dumps(result, ensure_ascii=False)
        body = {"type": "succeeded", "message": {"content": [{"type": "text", "text": text}]}}
    return json.dumps({"custom_id": request_id, "result": body}, ensure_ascii=False)
