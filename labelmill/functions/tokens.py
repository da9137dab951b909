"""Token estimates: about four characters to a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.spec import LabelSpec

# Fixed values of the estimate.
CHARS_PER_TOKEN = 4
OUTPUT_TOKENS_PER_FIELD = 50
REASONING_TOKENS_PER_FIELD = 100


def token_estimate(text: Column) -> Column:
    """Estimated tokens of a text column, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def text_tokens(text: str) -> int:
    """The same estimate for one driver-side string."""
    return max(1, len(text) // CHARS_PER_TOKEN)


def cached_tokens(spec: LabelSpec) -> int:
    """Tokens every request shares: system text and output schema."""
    return text_tokens(spec.system) + text_tokens(spec.schema_text())


def output_tokens(spec: LabelSpec) -> int:
    """Expected tokens of one answer."""
    per_field = OUTPUT_TOKENS_PER_FIELD + (REASONING_TOKENS_PER_FIELD if spec.reasoning else 0)
    return per_field * len(spec.fields)
