"""Declared constraints as boolean expressions: enumerations and numeric bounds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.spec import OutputField


def violations(fields: Iterable[OutputField], columns: dict[str, Column] | None = None, enums: bool = True) -> Column:
    """Texts of all constraints a row breaks, as an array in field order (empty if it breaks none).

    Values inside of objects and arrays are looked at too; a text begins with the path to the value, such as ``keys[3].price``. Missing
    values break nothing. ``columns`` gives the column of each field, by default the one of the same name. Enumerations compare exactly, with case.
    """
    checks = [_checks(f, F.col(f"`{f.name}`") if columns is None else columns[f.name], F.lit(f.name), enums) for f in fields if _constrained(f, enums)]
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.concat(*checks))


def _constrained(f: OutputField, enums: bool) -> bool:
    """Whether there is anything to check in a field."""
    inner = [*f.fields, *([f.items] if f.items is not None else [])]
    return f.has_bounds or (enums and f.enum is not None) or any(_constrained(g, enums) for g in inner)


def _checks(f: OutputField, col: Column, path: Column, enums: bool) -> Column:
    """An array with a text, or null, for each constraint on a value and what is in it."""
    if f.type == "object":
        inner = [_checks(g, col.getField(g.name), F.concat(path, F.lit("." + g.name)), enums) for g in f.fields if _constrained(g, enums)]
        return F.concat(*inner)
    if f.type == "array":
        def item(value: Column, i: Column) -> Column:
            return _checks(f.items, value, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), enums)

        return F.flatten(F.coalesce(F.transform(col, item), F.array().cast("array<array<string>>")))
    return F.array(*[F.when(broken, F.concat(path, F.lit(f" {text}"))) for broken, text in _rules(f, col, enums)])


def _rules(f: OutputField, col: Column, enums: bool) -> list[tuple[Column, str]]:
    rules = []
    if enums and f.enum is not None:
        rules.append((~col.isin(*[F.lit(v) for v in f.enum]), "is not one of the allowed values"))
    if f.minimum is not None:
        rules.append((col < F.lit(f.minimum), f"is below {f.minimum}"))
    if f.maximum is not None:
        rules.append((col > F.lit(f.maximum), f"is above {f.maximum}"))
    if f.exclusive_minimum is not None:
        rules.append((col <= F.lit(f.exclusive_minimum), f"is not above {f.exclusive_minimum}"))
    if f.exclusive_maximum is not None:
        rules.append((col >= F.lit(f.exclusive_maximum), f"is not below {f.exclusive_maximum}"))
    if f.multiple_of is not None:
        rules.append((~_is_multiple(f, col), f"is not a multiple of {f.multiple_of}"))
    return rules


def _is_multiple(f: OutputField, col: Column) -> Column:
    step = f.multiple_of
    if f.type == "integer" and float(step).is_integer():
        return col % F.lit(int(step)) == 0
    # Doubles: the quotient must be a whole number up to rounding of the division.
    quotient = col / F.lit(float(step))
    return F.abs(quotient - F.rint(quotient)) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(quotient))
