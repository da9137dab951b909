"""Answers against declared fields: typed values, and a reason where a value does not fit.

The rules are those of lax validation: numbers and truth values may come as text, but text never comes from numbers.

Nearly all objects hold values of just the declared types, and for them one cast of the whole object is right. Only objects that do
not are judged field by field. That part is long; it sits in a lambda, which Spark evaluates without generating code for it, so that
the generated code of the common path stays small enough to be compiled, however many fields there are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.spec import OutputField

# Texts taken as a number or a truth value. The integer to cast is the group. A number is looked at without the white space
# around it, or without underscores inside of it, but not both.
INTEGER_TEXT = r"(?U)^\s*([+-]?[0-9]+(?:_[0-9]+)*)(?:\.0+)?\s*$"
NUMBER_TEXT = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"
NUMBER_BAD = r"(?U)^_|_$|__|^\s.*_|_.*\s$"
TRUE_TEXTS = ("true", "yes", "on", "t", "y", "1")
FALSE_TEXTS = ("false", "no", "off", "f", "n", "0")
NOT_OBJECT = "Answer is not a JSON object"

_RAW, _PLAIN, _FITS, _SLOW = "_raw", "_plain", "_fits", "_slow"


def conform_fields(df: DataFrame, doc: Column, path: str, fields: Sequence[OutputField], misfit: str = "_misfit", lax: bool = False) -> DataFrame:
    """Add a typed column per field of the object at ``path`` of a VARIANT, and ``misfit``: all reasons why the object does not fit.

    A field of a misfitting object may have a value; a missing or null one has its default or null. With ``lax``, text fields take any value.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    raw, plain, slow = F.col(_RAW), F.col(_PLAIN), F.col(_SLOW)
    opened = df.select(*kept, _members(doc, path, fields).alias(_RAW), _typed_members(doc, path, fields).alias(_PLAIN))
    fits = reduce(lambda a, b: a & b, [_fits(raw[f.name], plain[f.name], f) for f in fields])
    tested = opened.select(*kept, _RAW, _PLAIN, F.coalesce(fits, F.lit(False)).alias(_FITS))
    judged = tested.select(*kept, _PLAIN, _FITS, F.when(~F.col(_FITS), aside(raw, lambda r: _judge_members(r, fields, lax))).alias(_SLOW))
    values = [F.when(F.col(_FITS), plain[f.name]).otherwise(slow["value"][f.name]).alias(f.name) for f in fields]
    return judged.select(*kept, *values, slow["reason"].alias(misfit))


def aside(col: Column, build: Callable[[Column], Column]) -> Column:
    """``build(col)`` outside of the generated code, for rare and long expressions; ``col`` is evaluated once."""
    return F.get(F.transform(F.array(col), build), 0)


def _fits(raw: Column, plain: Column, field: OutputField) -> Column:
    """True where the plain cast of a value is its value. Not true for all values that fit, but for those in the field's own type."""
    kind = F.schema_of_variant(raw)
    if _is_nested(field):
        pattern = _kind_pattern(field)
        if pattern is None:
            return F.lit(False)
        own = kind.rlike(f"^{pattern}$")
        # The kind of an array tells nothing of nulls among its elements.
        return own & (F.size(F.array_compact(plain)) == F.size(plain)) if field.type == "array" else own
    # Kinds of JSON values start differently, but for BIGINT and BOOLEAN: numeric fields take both.
    own = {"string": kind == "STRING", "boolean": kind == "BOOLEAN", "integer": kind.startswith("B"), "number": F.left(kind, F.lit(1)).isin("B", "D")}[field.type]
    if field.enum is not None:
        own = own & plain.isin(*[F.lit(v) for v in field.enum])
    if not field.required and field.default is None:
        own = own | kind.isNull()
    if field.nullable:
        own = own | (kind == "VOID")
    return own


# How the kind of a JSON value of a scalar type is worded.
_KIND_PATTERNS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "number": r"(BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))"}


def _kind_pattern(field: OutputField) -> str | None:
    """Pattern of the kinds that surely fit, None where the kind cannot tell: enumerations, and arrays of more than plain values."""
    if field.enum is not None:
        return None
    if field.type == "array":
        return f"ARRAY<{_KIND_PATTERNS[field.items.type]}>" if not _is_nested(field.items) and field.items.enum is None else None
    if field.type != "object":
        return _KIND_PATTERNS[field.type]
    if any(f.type == "array" or not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", f.name) for f in field.fields):
        return None
    parts = [(f.name, _kind_pattern(f)) for f in sorted(field.fields, key=lambda f: f.name)]
    return None if any(p is None for _, p in parts) else "OBJECT<" + ", ".join(f"{n}: {p}" for n, p in parts) + ">"


def _judge_members(raw: Column, fields: Sequence[OutputField], lax: bool) -> Column:
    """Struct of ``value`` (a struct of the fields) and ``reason`` for an object given as ``_members``."""
    def assemble(parts: Column) -> Column:
        value = F.struct(*[parts[f.name]["value"].alias(f.name) for f in fields])
        reason = _joined([F.concat(F.lit(f"Field {f.name}: "), parts[f.name]["reason"]) for f in fields])
        return F.struct(value.alias("value"), F.when(raw.isNull(), NOT_OBJECT).otherwise(reason).alias("reason"))

    return aside(F.struct(*[_judge(raw[f.name], f, lax).alias(f.name) for f in fields]), assemble)


def _members(doc: Column, path: str, fields: Sequence[OutputField]) -> Column:
    """The raw members of an object as a struct of VARIANTs: null where absent, a VARIANT null where null."""
    return F.try_variant_get(doc, path, "struct<" + ", ".join(f"`{f.name.replace('`', '``')}`: variant" for f in fields) + ">")


def _typed_members(doc: Column, path: str, fields: Sequence[OutputField]) -> Column:
    """The members of an object by plain casts; those that cannot be cast are null."""
    return F.try_variant_get(doc, path, T.StructType([T.StructField(f.name, f.spark_type) for f in fields]).simpleString())


def _chain(cases: list[tuple[Column, str]]) -> Column:
    """Text of the first condition that holds, else null."""
    if not cases:
        return F.lit(None).cast("string")
    out = F.when(*cases[0])
    for cond, text in cases[1:]:
        out = out.when(cond, text)
    return out


def _joined(reasons: list[Column]) -> Column:
    return F.nullif(F.concat_ws("; ", *reasons), F.lit(""))


# --- scalars ------------------------------------------------------------------------------------------------------------------


def _get(raw: Column, kind: str) -> Column:
    return F.try_variant_get(raw, "$", kind)


def _base(raw: Column, field: OutputField) -> Column:
    """The plain cast of a scalar, right for values that come in the field's own type."""
    return _get(raw, field.spark_type.simpleString())


def _scalar(raw: Column, kind: Column, base: Column, field: OutputField, lax: bool) -> Column:
    """Typed value of a scalar, null if it has none. Enumerated values are never read from text of another type."""
    from_text = field.enum is None
    is_text = kind == "STRING"
    if field.type == "string":
        return F.when(kind != "VOID", base) if lax else F.when(is_text, base)
    fraction = kind.startswith("D")  # DECIMAL or DOUBLE
    if field.type == "boolean":
        number = _get(raw, "double")
        value = F.when(kind == "BOOLEAN", base).when(fraction | (kind == "BIGINT"), F.when(number.between(0, 1) & (number % 1 == 0), number == 1))
        if from_text:
            known = F.create_map(*[x for t in TRUE_TEXTS for x in (F.lit(t), F.lit(True))], *[x for t in FALSE_TEXTS for x in (F.lit(t), F.lit(False))])
            value = value.when(is_text, F.try_element_at(known, F.lower(_get(raw, "string"))))
        return value
    own = kind.isin("BIGINT", "BOOLEAN")
    if field.type == "integer":
        # The cast cuts fractions off, so a number is an integer where it equals its cast.
        value = F.when(own | (fraction & (base.cast("double") == _get(raw, "double"))), base)
    else:
        value = F.when(own | fraction, base)
    if from_text:
        # Only what is known to be a number is cast: a cast that fails costs far more than the rest.
        value = value.when(is_text, _digits(_get(raw, "string"), field).try_cast(field.spark_type))
    return value


def _digits(text: Column, field: OutputField) -> Column:
    """The text to cast to a number, null if it is none."""
    if field.type == "integer":
        return F.nullif(F.replace(F.regexp_extract(text, INTEGER_TEXT, 1), F.lit("_"), F.lit("")), F.lit(""))
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$|_", "")
    # A signed NaN is not a text the cast knows.
    return F.when(~text.rlike(NUMBER_BAD) & bare.rlike(NUMBER_TEXT), F.regexp_replace(bare, "(?i)^[+-]nan$", "nan"))


# What is said of a value that is not of its field's type.
_NOT_OF_TYPE = {"string": "not a string", "integer": "not an integer", "number": "not a number", "boolean": "not a boolean"}


def _refusals(kind: Column, value: Column, field: OutputField) -> list[tuple[Column, str]]:
    """When and why a value is refused; at most one condition holds."""
    out = []
    if field.required:
        out.append((kind.isNull(), "missing"))
    if not field.nullable:
        out.append((kind == "VOID", "null is not allowed"))
    present = kind.isNotNull() & (kind != "VOID")
    if field.enum is None:
        out.append((present & value.isNull(), _NOT_OF_TYPE[field.type]))
    else:
        known = F.coalesce(value.isin(*[F.lit(v) for v in field.enum]), F.lit(False))
        of_type = "not a string" if field.type == "string" else None
        if of_type:
            out.append((present & value.isNull(), of_type))
            present = value.isNotNull()
        out.append((present & ~known, "not one of the allowed values"))
    return out


def _filled(kind: Column, value: Column, field: OutputField) -> Column:
    if field.default is None:
        return value
    return F.when(kind.isNull(), _default(field)).otherwise(value)


def _default(field: OutputField) -> Column:
    if field.default is None:
        return F.lit(None).cast(field.spark_type)
    if _is_nested(field):
        return F.from_json(F.lit(json.dumps(field.default)), field.spark_type)
    return F.lit(field.default).cast(field.spark_type)


# --- objects and arrays -------------------------------------------------------------------------------------------------------


def _is_nested(field: OutputField) -> bool:
    return field.type in ("object", "array")


def _judge(raw: Column, field: OutputField, lax: bool) -> Column:
    """Struct of ``value`` and ``reason`` for one value."""
    if not _is_nested(field):
        def scalar(kind: Column) -> Column:
            return aside(_scalar(raw, kind, _base(raw, field), field, lax), lambda value: _judged(
                _filled(kind, value, field), _chain(_refusals(kind, value, field)), field))

        return aside(F.schema_of_variant(raw), scalar)

    inner = _judge_object if field.type == "object" else _judge_array
    missing = _judged(_default(field), F.lit("missing") if field.required else F.lit(None), field)
    null = _judged(F.lit(None), F.lit(None) if field.nullable else F.lit("null is not allowed"), field)
    return aside(F.schema_of_variant(raw), lambda kind: F.when(kind.isNull(), missing).when(kind == "VOID", null).otherwise(inner(raw, kind, field, lax)))


def _judged(value: Column, reason: Column, field: OutputField) -> Column:
    return F.struct(value.cast(field.spark_type).alias("value"), reason.cast("string").alias("reason"))


def _judge_object(raw: Column, kind: Column, field: OutputField, lax: bool) -> Column:
    judged = aside(_members(raw, "$", field.fields), lambda m: _judge_members(m, field.fields, lax))
    return F.when(kind.startswith("OBJECT"), aside(judged, lambda j: _judged(j["value"], j["reason"], field))).otherwise(
        _judged(F.lit(None), F.lit("not an object"), field))


def _judge_array(raw: Column, kind: Column, field: OutputField, lax: bool) -> Column:
    # Null elements come as SQL null; as a VARIANT null they are judged like null members.
    null = F.parse_json(F.lit("null"))
    judged = F.transform(_get(raw, "array<variant>"), lambda v: _judge(F.coalesce(v, null), field.items, lax))

    def assemble(items: Column) -> Column:
        reasons = F.transform(items, lambda j, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), j["reason"]))
        return _judged(F.transform(items, lambda j: j["value"]), F.nullif(F.array_join(reasons, ", "), F.lit("")), field)

    return F.when(kind.startswith("ARRAY"), aside(judged, assemble)).otherwise(_judged(F.lit(None), F.lit("not an array"), field))


# --- loose mode ---------------------------------------------------------------------------------------------------------------


def cast_fields(df: DataFrame, doc: Column, path: str, fields: Sequence[OutputField]) -> DataFrame:
    """Add a typed column per field without any judgement: a value that does not fit is null, wherever it stands in objects and arrays; text
    fields take any value as text."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    lax = [_undemanding(f) for f in fields if f.type != "string"]
    direct = [f for f in fields if f.type == "string"]
    out = conform_fields(df, doc, path, lax, "_unused", lax=True) if lax else df
    if direct:
        out = out.select("*", _typed_members(doc, path, direct).alias(_PLAIN))
    chosen = [(F.col(_PLAIN)[f.name] if f in direct else F.col(f"`{f.name}`")).alias(f.name) for f in fields]
    return out.select(*kept, *chosen)


def _undemanding(field: OutputField) -> OutputField:
    """The field without demands: any value, none, or null."""
    return OutputField(field.name, field.type, required=False, nullable=True, fields=tuple(map(_undemanding, field.fields)),
                       items=None if field.items is None else _undemanding(field.items))


def undeclared(doc: Column, path: str, fields: Sequence[OutputField]) -> Column:
    """Members of an object outside ``fields`` as one VARIANT object; null if there are none."""
    rest = F.map_filter(F.try_variant_get(doc, path, "map<string,variant>"), lambda k, _: ~k.isin(*[f.name for f in fields]))
    return F.when(F.size(rest) > 0, F.to_variant_object(rest))
