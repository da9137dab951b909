"""JSON text as VARIANT, with the strictness a record format needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text is parsed as first element of an array, so that a document ends where the text ends.
_DOC = "$[0]"


def parse_exact(text: Column) -> Column:
    """Parse a text that must be exactly one JSON document; read the result with ``is_exact``, ``at`` and ``kind_at``.

    ``try_parse_json`` alone stops after the first document and accepts whatever follows. Here the text is wrapped as
    ``[<text>,<hash of text>]``: any other shape of the outcome than these two elements shows that something followed.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text).cast("string"), F.lit("]")))


def is_exact(doc: Column, text: Column) -> Column:
    """True where ``parse_exact`` found one whole document; never null."""
    return F.coalesce(F.try_variant_get(doc, "$[1]", "bigint") == F.xxhash64(text), F.lit(False))


def at(doc: Column, path: str, kind: str) -> Column:
    """Value at ``path`` (below the document's root) as Spark type ``kind``, null if absent or not castable."""
    return F.try_variant_get(doc, _DOC + path, kind)


def kind_at(doc: Column, path: str = "") -> Column:
    """Type name at ``path``: null if absent, ``VOID`` for JSON null, else as ``schema_of_variant`` words it."""
    return F.schema_of_variant(at(doc, path, "variant"))


# Texts of the values that count as nothing.
BLANK_TEXTS = ("", "{}", "[]", "false", "0", "0.0", "-0.0")


def is_blank(doc: Column, path: str) -> Column:
    """True where the value is absent, null, false, zero, or an empty text, array or object."""
    return F.coalesce(at(doc, path, "string").isin(*BLANK_TEXTS), F.lit(True))
