"""Token and cost estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.errors import LabelError, SpecError
from labelmill.functions.template import render_prompt
from labelmill.functions.tokens import cached_tokens, output_tokens, token_estimate
from labelmill.operators.requests import prompt_columns
from labelmill.sources.prices import FALLBACK_MODEL, price_table
from labelmill.spec import LabelSpec

_PER_MILLION = 1_000_000


def prompt_tokens(df: DataFrame, spec: LabelSpec) -> Column:
    """Estimated tokens of a row's rendered prompt."""
    return token_estimate(render_prompt(df, spec.template, prompt_columns(spec)))


def token_totals(df: DataFrame, spec: LabelSpec, method: str = "exact", order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """One row: ``total_requests``, ``input_tokens``, ``avg_input_tokens``.

    ``method="exact"`` adds up every row's tokens. ``method="first_row"`` takes the first row (by ``order_by``, else as the scan
    yields it) for all of them. Either way the table is read once at most, and nothing is shuffled but one row per task.
    """
    tokens = prompt_tokens(df, spec)
    count = F.count(F.lit(1))
    if method == "exact":
        return df.agg(count.alias("total_requests"), F.coalesce(F.sum(tokens), F.lit(0)).alias("input_tokens"),
                      F.coalesce(F.avg(tokens), F.lit(0.0)).alias("avg_input_tokens"))
    if method != "first_row":
        raise SpecError("method must be 'exact' or 'first_row'")
    if order_by:
        keys = [c if isinstance(c, Column) else F.col(f"`{c}`") for c in order_by]
        totals = df.agg(count.alias("total_requests"), F.min_by(tokens, F.struct(*keys)).alias("first"))
    else:
        totals = df.agg(count.alias("total_requests")).withColumn("first", df.limit(1).select(tokens.alias("t")).scalar())
    first = F.coalesce("first", F.lit(0))
    return totals.select("total_requests", (first * F.col("total_requests")).alias("input_tokens"), first.cast("double").alias("avg_input_tokens"))


def estimate_cost(df: DataFrame, spec: LabelSpec, method: str = "exact", order_by: Sequence[str | Column] | None = None,
                  prices: DataFrame | None = None, on_unknown_model: str = "error") -> DataFrame:
    """Cost of a job, one row. A model without a price is an error, or takes the fallback model's (``on_unknown_model="fallback"``)."""
    if on_unknown_model not in ("error", "fallback"):
        raise SpecError("on_unknown_model must be 'error' or 'fallback'")
    prices = prices if prices is not None else price_table(df.sparkSession)
    known = {r[0] for r in prices.filter(F.col("model").isin(spec.model, FALLBACK_MODEL)).select("model").collect()}
    model = spec.model
    if model not in known:
        if on_unknown_model == "error" or FALLBACK_MODEL not in known:
            raise LabelError(f"Unknown model: {model}")
        model = FALLBACK_MODEL
    totals = token_totals(df, spec, method, order_by)
    return cost_by_model(totals, spec, prices.filter(F.col("model") == model)).withColumn("model", F.lit(spec.model))


def cost_by_model(totals: DataFrame, spec: LabelSpec, prices: DataFrame) -> DataFrame:
    """Cost of the same job under every model of a price table.

    The one row of totals enters as a scalar subquery, so no join is needed. The first request writes the cache and the others read
    it; an empty job costs nothing.
    """
    packed = totals.select(F.struct("total_requests", "input_tokens", "avg_input_tokens"))
    priced = prices.withColumn("t", packed.scalar())
    n, tokens = F.col("t.total_requests"), F.col("t.input_tokens")
    shared, answer = cached_tokens(spec), output_tokens(spec)
    some = n > 0

    def cost(amount: Column, price: str) -> Column:
        return F.when(some, amount * F.col(price) / _PER_MILLION).otherwise(F.lit(0.0))

    def per_job(tokens: int) -> Column:
        return F.when(some, F.lit(tokens).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    out = priced.select(
        "model",
        per_job(shared).alias("cached_tokens"),
        F.col("t.avg_input_tokens").alias("avg_input_tokens"),
        per_job(answer).alias("estimated_output_tokens"),
        n.alias("total_requests"),
        cost(F.lit(shared), "cache_write_price").alias("cache_write_cost"),
        cost((n - 1) * shared, "cache_read_price").alias("cache_read_cost"),
        cost(tokens, "input_price").alias("input_cost"),
        cost(n * answer, "output_price").alias("output_cost"),
    )
    total = F.col("cache_write_cost") + F.col("cache_read_cost") + F.col("input_cost") + F.col("output_cost")
    return out.withColumn("total_cost", total).withColumn(
        "cost_per_row", F.when(F.col("total_requests") > 0, F.col("total_cost") / F.col("total_requests")).otherwise(0.0)
    )
