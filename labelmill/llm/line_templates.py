"""Operator 5: lines that recur across documents, by a tree of line templates. DataFrame functions only.

A line's tokens are its runs between blanks; a token with a digit is a variable field. The tree has a fixed depth: number of tokens, then the
``DEPTH`` leading tokens. A leaf's templates are its lines as they are (with their variable fields open), and, for lines of at least
``LONG`` tokens, those that leave one of three equal parts of the rest open: so lines of one leaf that differ in one part only have a template
in common.

A template recurs if at least ``min_docs`` different documents hold it. Its first occurrence (least id, then line) stays, and every other line
under it is dropped. Every line that has a token is looked at, however short.

Cases: null texts stay null and have no lines; blank lines stay; rows with equal id and text are one document and share its result; a null id
comes first; an empty table gives no rows; other columns are kept by ``drop_recurring`` and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import stage

DEPTH, LONG, MIN_DOCS = 3, 12, 3
_DOC = ["_id", "_hash"]


def templates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _hash, line, leaf, key``: every template of every line, as the hashes of its leaf (32 bits) and of what it fixes there (64 bits)."""
    text = F.col(f"`{text_col}`")
    lines = docs.where(text.isNotNull()).select(F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_hash"), F.posexplode(F.split(text, "\n")).alias("line", "body"))
    tokens = F.array_remove(F.split("body", r"[ \t\r]+"), "")
    masked = F.when(F.col("body").rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))).otherwise(tokens)
    # As the output of a generator, tokens are computed once, however often they are used below.
    rows = lines.select(*_DOC, "line", F.explode(F.array(masked)).alias("t")).withColumn("n", F.size("t")).where(F.col("n") > 0)
    third = F.ceil((F.col("n") - DEPTH) / 3).cast("int")
    parts = [F.xxhash64(F.slice("t", DEPTH + 1 + k * third, third)).alias(f"p{k}") for k in range(3)]
    # Again once only, and in little generated code: large methods are not compiled.
    hashed = rows.select(*_DOC, "line", "n", F.explode(F.array(F.struct(F.hash("n", F.slice("t", 1, DEPTH)).alias("leaf"), F.xxhash64("t").alias("whole"), *parts))).alias("h"))
    open_parts = [F.xxhash64(F.lit(k), *[f"h.p{j}" for j in range(3) if j != k]) for k in range(3)]
    own = F.array("h.whole")
    keys = F.when(F.col("n") >= LONG, F.array("h.whole", *open_parts)).otherwise(own)
    return hashed.select(*_DOC, "line", F.col("h.leaf").alias("leaf"), F.explode(keys).alias("key"))


def recurring_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _hash, lines``: for each document with lines to drop, their numbers."""
    parts = stage(templates(docs, id_col, text_col), "templates")
    held = parts.groupBy("leaf", "key", *_DOC).agg(F.min("line").alias("line"))
    shared = held.groupBy("leaf", "key").agg(F.count("*").alias("docs"), F.min(F.struct("_id", "_hash", "line")).alias("first")).where(F.col("docs") >= min_docs)
    shared = stage(shared.select("leaf", "key", "first"), "recurring")
    later = parts.join(shared, ["leaf", "key"]).where(~F.struct("_id", "_hash", "line").eqNullSafe(F.col("first")))
    return later.groupBy(*_DOC).agg(F.collect_set("line").alias("lines"))  # at most a document's lines


def drop_recurring(docs: DataFrame, *, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without its dropped lines, and ``n_lines``, ``n_dropped`` added (columns of these names are replaced)."""
    found = recurring_lines(docs, min_docs=min_docs, id_col=id_col, text_col=text_col).alias("f")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("_hash"))
    rows = rows.alias("r").join(found, F.expr("r._id <=> f._id and r._hash = f._hash"), "left").select("row", "lines")
    text = F.col(f"row.`{text_col}`")
    left = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("lines", i)), "\n"))
    columns = [left.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return rows.select(*columns, n_lines.alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"))
