"""Prompt templates as column expressions.

A template is read once on the driver and becomes one ``concat`` of literals and columns, so rendering stays in generated code.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.errors import SpecError
from labelmill.functions.cells import NULL_TEXT, canonical_str


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """Split a template into (literal text, column name or None) pairs.

    Only plain ``{column}`` placeholders are taken; ``{{`` and ``}}`` stand for braces.
    """
    parts = []
    try:
        for text, name, spec, conversion in string.Formatter().parse(template):
            if name is not None:
                if not name:
                    raise SpecError("Template validation error: empty placeholder {}")
                if spec or conversion or any(c in name for c in ".[]"):
                    raise SpecError(f"Template validation error: only plain placeholders are supported, not '{{{name}}}' with "
                                    "attribute, index, conversion or format")
            parts.append((text, name))
    except SpecError:
        raise
    except ValueError as e:
        raise SpecError(f"Template validation error: {e}") from e
    return parts


def template_columns(template: str) -> list[str]:
    """Column names a template uses, each once, in order of appearance."""
    return list(dict.fromkeys(name for _, name in template_parts(template) if name is not None))


def check_template(template: str, columns: Iterable[str]) -> tuple[bool, str]:
    """Tell whether every placeholder names one of ``columns``; the message names the first that does not."""
    try:
        unknown = [c for c in template_columns(template) if c not in set(columns)]
    except SpecError as e:
        return False, str(e)
    if unknown:
        return False, f"Template references undefined variable: '{unknown[0]}'"
    return True, ""


def render_prompt(df: DataFrame, template: str, columns: Iterable[str] | None = None, null_text: str = NULL_TEXT) -> Column:
    """The rendered prompt as a column of ``df``. With ``columns`` given, the template may use no others."""
    allowed = df.columns if columns is None else list(columns)
    ok, message = check_template(template, allowed)
    if not ok:
        raise SpecError(message)
    types = {f.name: f.dataType for f in df.schema.fields}
    pieces = []
    for text, name in template_parts(template):
        if text:
            pieces.append(F.lit(text))
        if name is not None:
            if name not in types:
                raise SpecError(f"Missing columns: {name}")
            pieces.append(canonical_str(df[name], types[name], null_text))
    return F.concat(*pieces) if pieces else F.lit("")
