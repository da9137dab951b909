"""Request ids: a fixed prefix before the row id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what stands before a row id in a request id.
REQUEST_PREFIX = "row_"


def encode_request_id(row_id: Column) -> Column:
    return F.concat(F.lit(REQUEST_PREFIX), row_id.cast("string"))


def decode_request_id(request_id: Column) -> Column:
    """Row id of a request id. Only a leading prefix is cut, so ids that hold the prefix elsewhere survive the round trip."""
    return F.when(request_id.startswith(REQUEST_PREFIX), F.substr(request_id, F.lit(len(REQUEST_PREFIX) + 1))).otherwise(request_id)
