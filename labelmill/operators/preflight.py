"""Checks before a job: columns, ids, template, and the first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.cells import canonical_str
from labelmill.functions.template import check_template, template_columns
from labelmill.operators.requests import prompt_columns
from labelmill.sources.prices import MODEL_PRICES
from labelmill.spec import LabelSpec

# What a preview shows of a long cell.
PREVIEW_CHARS = 50
PREVIEW_CUT = 47
PREVIEW_MARK = "..."


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def id_uniqueness(df: DataFrame, id_column: str) -> DataFrame:
    """One row: ``row_count``, ``unique_count`` (null counts as a value), ``null_count``, ``is_unique``."""
    return df.agg(*_id_counts(id_column)).withColumn("is_unique", F.col("row_count") == F.col("unique_count"))


def _id_counts(id_column: str) -> list[Column]:
    key = F.col(f"`{id_column}`")
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.count_distinct(F.struct(key)).alias("unique_count"),
        F.count_if(key.isNull()).alias("null_count"),
    ]


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once, with their count."""
    key = F.col(f"`{id_column}`").cast("string").alias("id")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def preflight_report(df: DataFrame, spec: LabelSpec, models: Sequence[str] = tuple(MODEL_PRICES)) -> DataFrame:
    """The checks of a job in order, up to the first error: ``seq``, ``check``, ``status`` (ok, warn, error), ``detail``.

    Names and the template are checked without data. All counts come from one aggregate over the input, which reads the id column
    only (and nothing but file footers if there is none).
    """
    columns = prompt_columns(spec)
    counts = [F.count(F.lit(1)).alias("row_count")]
    has_id = spec.id_column is not None and spec.id_column in df.columns
    if has_id:
        counts = _id_counts(spec.id_column)

    steps: list[tuple[str, Column, Column]] = []

    def step(check: str, status: str | Column, detail: str | Column) -> None:
        steps.append((check, F.lit(status) if isinstance(status, str) else status, F.lit(detail) if isinstance(detail, str) else detail))

    if spec.model in models:
        step("model", "ok", spec.model)
    else:
        step("model", "warn", f"Unknown model: {spec.model} (cost estimation may be inaccurate)")
    step("rows", "ok", F.concat(F.col("row_count").cast("string"), F.lit(f" rows, {len(df.columns)} columns")))
    missing = missing_columns(df, columns)
    step("columns", "error" if missing else "ok", f"Missing columns: {', '.join(missing)}" if missing else ", ".join(columns))
    if spec.id_column is None:
        step("id_column", "ok", "will be auto-generated")
    elif not has_id:
        step("id_column", "error", f"ID column '{spec.id_column}' not found in CSV. Available columns: {', '.join(df.columns)}")
    else:
        u, n, nulls = (F.col(c).cast("string") for c in ("unique_count", "row_count", "null_count"))
        good = (F.col("unique_count") == F.col("row_count")) & (F.col("null_count") == 0)
        twice = F.concat(F.lit(f"ID column '{spec.id_column}' contains duplicate values. Found "), u, F.lit(" unique values in "), n, F.lit(" rows."))
        empty = F.concat(F.lit(f"ID column '{spec.id_column}' has "), nulls, F.lit(" rows without a value."))
        detail = F.when(F.col("unique_count") != F.col("row_count"), twice).when(F.col("null_count") > 0, empty)
        step("id_column", F.when(good, "ok").otherwise("error"), F.coalesce(detail, F.concat(F.lit(f"{spec.id_column} ("), n, F.lit(" unique values)"))))
    fits, message = check_template(spec.template, columns)
    step("template", "ok" if fits else "error", f"{len(template_columns(spec.template))} variables" if fits else f"Template validation failed: {message}")
    extra = f" + {len(spec.reasoning_fields)} reasoning fields" if spec.reasoning else ""
    step("output", "ok", f"{len(spec.fields)} fields{extra}")

    rows = [F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(c).alias("check"), s.alias("status"), d.alias("detail")) for i, (c, s, d) in enumerate(steps, 1)]
    first_error = F.array_min(F.transform(F.filter("checks", lambda c: c["status"] == "error"), lambda c: c["seq"]))
    report = df.agg(*counts).select(F.array(*rows).alias("checks")).withColumn("last", F.coalesce(first_error, F.lit(len(steps)).cast("bigint")))
    return report.select(F.inline(F.filter("checks", lambda c: c["seq"] <= F.col("last"))))


def sample_row(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first row, its cells as text: in the order given, else the first that the scan yields. Unknown columns are skipped."""
    first = df.orderBy(*order_by).limit(1) if order_by else df.limit(1)
    types = {f.name: f.dataType for f in df.schema.fields}
    wanted = [c for c in (columns or df.columns) if c in types]
    return first.select(*[canonical_str(F.col(f"`{c}`"), types[c]).alias(c) for c in wanted])


def sample_dict(df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str | Column] | None = None) -> dict[str, str]:
    """``sample_row`` on the driver; empty for an empty input."""
    row = sample_row(df, columns, order_by).first()
    return row.asDict() if row is not None else {}


def preview_rows(df: DataFrame, max_rows: int = 5, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """The first rows for display: cells as text, long ones cut, missing ones empty."""
    head = df.orderBy(*order_by).limit(max_rows) if order_by else df.limit(max_rows)
    cells = []
    for f in df.schema.fields:
        text = canonical_str(F.col(f"`{f.name}`"), f.dataType, null_text="")
        cut = F.concat(F.substring(text, 1, PREVIEW_CUT), F.lit(PREVIEW_MARK))
        cells.append(F.when(F.length(text) > PREVIEW_CHARS, cut).otherwise(text).alias(f.name))
    return head.select(*cells)
