"""Model prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Price per million tokens as (batch input, batch output, cache write, cache read); each model has a dated name and an alias.
MODEL_PRICES: dict[str, tuple[float, float, float, float]] = {
    "claude-opus-4-5-20251101": (2.50, 12.50, 3.125, 0.25),
    "claude-opus-4-5": (2.50, 12.50, 3.125, 0.25),
    "claude-sonnet-4-5-20250929": (1.50, 7.50, 1.875, 0.15),
    "claude-sonnet-4-5": (1.50, 7.50, 1.875, 0.15),
    "claude-haiku-4-5-20251001": (0.50, 2.50, 0.625, 0.05),
    "claude-haiku-4-5": (0.50, 2.50, 0.625, 0.05),
}

# Fixed value: whose prices stand in for a model without any.
FALLBACK_MODEL = "claude-sonnet-4-5-20250929"

PRICE_SCHEMA = "model string, input_price double, output_price double, cache_write_price double, cache_read_price double"


def price_table(spark: SparkSession, prices: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """Prices as a table, one row per model name; pass ``prices`` to use your own."""
    rows = [(model, *p) for model, p in (MODEL_PRICES if prices is None else prices).items()]
    return spark.createDataFrame(rows, PRICE_SCHEMA)
