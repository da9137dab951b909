"""Cells as text, the way a prompt shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: text of a missing cell.
NULL_TEXT = "None"

# A decimal wide enough for every double from 1e-4 up to 1e16 with all its digits (17 of them).
_PLAIN_DECIMAL = "decimal(38,21)"


def canonical_str(col: Column, dtype: T.DataType, null_text: str = NULL_TEXT) -> Column:
    """Text of a cell: ``True``/``False``, doubles in shortest form always with a fraction or exponent, null as ``null_text``."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(col, "True").when(~col, "False")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = double_str(col.cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(col, "SSSSSS")
        text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    elif isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        text = F.to_json(col)
    else:
        text = col.cast("string")
    return F.coalesce(text, F.lit(null_text))


def double_str(x: Column) -> Column:
    """Shortest text that reads back as the same double: plain from 1e-4 up to 1e16, else with a two-digit exponent."""
    size = F.abs(x)
    # In this range the JVM prints plain digits already; its text may carry digits to spare, seen from the length.
    direct = x.cast("string")
    return (
        F.when(F.isnan(x), "nan")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-3) & (size < 1e7) & (F.length(direct) < 16), direct)
        .when(x == 0, direct)
        .otherwise(_reformat(x, size))
    )


def _reformat(x: Column, size: Column) -> Column:
    short = _shortest_scientific(x)
    plain = F.regexp_replace(short.try_cast(_PLAIN_DECIMAL).cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.regexp_extract(short, "^([^e]+)e", 1), r"\.?0+$", "")
    exponent = F.regexp_extract(short, "e(.+)$", 1)
    return F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.concat(mantissa, F.lit("e"), exponent))


def _shortest_scientific(x: Column) -> Column:
    # 15 digits are exact when they read back; otherwise 16, otherwise all 17.
    d15, d16, d17 = (F.format_string(f"%.{n}e", x) for n in (14, 15, 16))
    return F.when(d15.cast("double") == x, d15).when(d16.cast("double") == x, d16).otherwise(d17)
