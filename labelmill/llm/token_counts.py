"""Operator 3: tokens of whole documents, attributed to their fields and sections.

A document is its fields, joined by a line end, and is encoded once. Byte spans of its tokens (they follow from the ids) are joined with the
spans of its sections by position. Sections are the lines of each field, each with its line end; they cover the document without gaps.

A token that lies across a boundary goes to one section only, by ``rule``: ``first`` (where its first byte is), ``last`` (where its last
byte is) or ``most`` (where most of its bytes are; the earlier of equals). So the sections' counts add up to the document's.

Cases: null fields are empty; a document without text has no tokens and one empty section per field; null ids, repeated rows and other
columns take no part in the counts; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import chunked

RULES = ("first", "last", "most")
_encodings: dict[tuple[str, str], tuple] = {}


def _encoding(path: str, pattern: str) -> tuple:
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        _encodings[path, pattern] = tiktoken.Encoding("attribution", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens per section for tokens that end at ``ends`` and sections that begin at ``bounds``; and how many tokens lie across a boundary."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, begins, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    across = last > first
    section = last if rule == "last" else first
    if rule == "most" and across.any():
        section = first.copy()
        for i in np.flatnonzero(across):
            edges = np.concatenate([[begins[i]], bounds[first[i] + 1 : last[i] + 1], [ends[i]]])
            section[i] += np.diff(edges).argmax()
    return np.bincount(section, minlength=len(bounds)), int(across.sum())


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, fields: Sequence[str] = ("text",), rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """Per document: its tokens, those across boundaries, the tokens of each field, and those of each section (number, field, first byte, tokens)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.concat_ws("\n", *parts).alias("text"), F.array(*[F.octet_length(p).cast("long") for p in parts]).alias("sizes"))
    section = pa.struct([("section", pa.int32()), ("field", pa.int32()), ("start", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, token_sizes = _encoding(vocabulary, pattern)
        for batch in chunked(batches, "text"):
            out: list[list] = [[], [], [], []]
            for text, field_sizes in zip(batch.column("text").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(token_sizes[np.frombuffer(encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)]) if text else np.zeros(0, np.int64)
                field_at = np.concatenate([[0], np.cumsum(np.array(field_sizes) + 1)[:-1]]).astype(np.int64)
                bounds = np.concatenate([[0], np.flatnonzero(raw == 10) + 1]).astype(np.int64)
                counts, across = attribute(ends, bounds, rule)
                owner = np.searchsorted(field_at, bounds, "right") - 1
                out[0].append(len(ends))
                out[1].append(across)
                out[2].append(np.bincount(owner, counts, len(names)).astype(np.int64).tolist())
                out[3].append([{"section": i, "field": f, "start": s, "tokens": n} for i, (f, s, n) in enumerate(zip(owner.tolist(), bounds.tolist(), counts.tolist(), strict=True))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(section))],
                ["doc_id", "n_tokens", "n_across", "field_tokens", "sections"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_across long, field_tokens array<long>, sections array<struct<section:int,field:int,start:long,tokens:long>>")
