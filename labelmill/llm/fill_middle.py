"""Operator 13: fill-in-the-middle documents as piece tables.

A document is one descriptor (buffer, start, length) over its immutable bytes. Cutting splits it into prefix, middle and suffix at unit borders; an
arrangement permutes the three and puts sentinels, descriptors over a second buffer, before them. Nothing is copied for that: an output is
rendered, or digested, by walking its descriptors. Restoring reads the sentinels' places from the output itself, makes descriptors over it
and applies the inverse permutation.

Units are runs of ASCII letters and single other characters. The cuts and the form follow from a hash of the seed and the id, so every run
gives the same. A document stays plain if it is empty, holds a sentinel, or by a share of ``plain`` in 100; of the others a share of ``spm``
in 100 has its suffix first.

Cases: null texts are empty ones; a null id hashes as the seed alone; rows of one id and text give the same output each time; texts are read whole
with a few passes over their bytes; an empty table gives no rows; columns of the names added are replaced, all others kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import chunked, text_buffer

TEXT, SENTINEL = 0, 1
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: The parts of each form in order; numbers are those of prefix, suffix and middle, and of their sentinels.
ARRANGEMENTS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Piece(NamedTuple):
    """``length`` bytes of a buffer from ``start`` on."""

    buffer: int
    start: int
    length: int

    def split(self, at: int) -> tuple[Piece, Piece]:
        """The piece before and the one from ``at`` on."""
        return Piece(self.buffer, self.start, at), Piece(self.buffer, self.start + at, self.length - at)


def unit_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every unit of every text, and the number of the first unit of each text, closed by the total."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    letter = _LETTER[data]
    start = data & 0xC0 != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[at[(at > 0) & (at < len(data))]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, at)


def draw(seed: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers for a document."""
    digest = hashlib.sha256((seed + ("" if doc_id is None else str(doc_id))).encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def choose_form(h3: int, h4: int, text: bytes, plain: int = 10, spm: int = 20) -> str:
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= 100 - plain:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def cut(document: Piece, first: int, second: int) -> list[Piece]:
    """Prefix, suffix and middle of a document cut at two places, ``first <= second``."""
    prefix, rest = document.split(first)
    middle, suffix = rest.split(second - first)
    return [prefix, suffix, middle]


def arrange(parts: list[Piece], form: str) -> list[Piece]:
    """The pieces of the output: each part behind its sentinel, in the form's order."""
    return [piece for i in ARRANGEMENTS[form] for piece in (Piece(SENTINEL, sum(map(len, SENTINELS[:i])), len(SENTINELS[i])), parts[i])]


def restored(output: bytes, form: str) -> list[Piece]:
    """The document's pieces over a rendered output (its buffer is the output): sentinels located, parts put back in order."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    parts: list[Piece | None] = [None] * 3
    rest = Piece(TEXT, 0, len(output))
    order = ARRANGEMENTS[form]
    for here, following in zip(order, [*order[1:], None], strict=True):
        if not output.startswith(SENTINELS[here], rest.start):
            raise ValueError(f"Not an output of form {form}")
        _, rest = rest.split(len(SENTINELS[here]))
        end = len(output) if following is None else output.find(SENTINELS[following], rest.start)
        if end < 0:
            raise ValueError(f"Not an output of form {form}")
        parts[here], rest = rest.split(end - rest.start)
    prefix, suffix, middle = parts
    return [prefix, middle, suffix]


def stream(pieces: Iterable[Piece], text: bytes) -> Iterator[memoryview]:
    """The bytes the pieces stand for, without copying them."""
    buffers = memoryview(text), memoryview(b"".join(SENTINELS))
    for p in pieces:
        yield buffers[p.buffer][p.start : p.start + p.length]


def _digest(pieces: Iterable[Piece], text: bytes) -> str:
    out = hashlib.sha256()
    for view in stream(pieces, text):
        out.update(view)
    return out.hexdigest()


_ADDED = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "pieces": "array<struct<buffer: int, start: bigint, length: bigint>>", "output_sha256": "string", "restored_sha256": "string"}


def fill_in_middle(docs: DataFrame, *, seed: str = "1:", plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, with ``n`` (units), ``form``, the lengths of prefix and middle in characters (null if plain), the output's ``pieces`` (buffer 0
    is the text's bytes, 1 the sentinels in a row), and digests of the output and of what is restored from it.

    ``render`` makes the outputs, ``restore`` the texts from outputs.
    """
    rest = [c for c in docs.columns if c not in _ADDED]
    others = [F.col(f"`{c}`") for c in rest if c != text_col]
    inner = docs.select((F.struct(*others) if others else F.lit(0)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("source"))
    added = T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in _ADDED.items()))
    schema = T.StructType([inner.schema["row"], inner.schema["source"], *added.fields])
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(piece), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "source"):
            data, at = text_buffer(batch.column("source"))
            starts, first = unit_starts(data, at)
            characters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
            raw, out = data.tobytes(), []
            for i, doc_id in enumerate(batch.column("id").to_pylist()):
                begin, end, n = int(at[i]), int(at[i + 1]), int(first[i + 1] - first[i])
                text = raw[begin:end]
                h1, h2, h3, h4 = draw(seed, doc_id)
                form, whole, lengths = choose_form(h3, h4, text, plain, spm), Piece(TEXT, 0, len(text)), (None, None)
                pieces = [whole]
                if form != "plain":
                    bounds = [int(starts[first[i] + k]) if k < n else end for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
                    pieces = arrange(cut(whole, *(b - begin for b in bounds)), form)
                    lengths = int(characters[bounds[0]] - characters[begin]), int(characters[bounds[1]] - characters[bounds[0]])
                output = b"".join(stream(pieces, text))
                out.append((n, form, *lengths, [p._asdict() for p in pieces], _digest(pieces, text), _digest(restored(output, form), output)))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("source"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["row", "source", *_ADDED])

    found = inner.mapInArrow(run, schema)
    own = {c: F.col(f"row.`{c}`").alias(c) for c in rest if c != text_col} | {text_col: F.col("source").alias(text_col)}
    return found.select(*[own[c] for c in rest], *_ADDED)


def _mapped(rows: DataFrame, text_col: str, second: str, third: str, column: str, step) -> DataFrame:
    """All columns, with a text column made of three others row by row, in chunks."""
    kept = [c for c in rows.columns if c != column]
    inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text_col}`").alias("source"), F.col(f"`{second}`").alias("b"), F.col(f"`{third}`").alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "source"):
            values = [step((a or "").encode(), b, c).decode() for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("source", "b", "c")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(values, pa.string())], ["row", "made"])

    out = inner.mapInArrow(run, T.StructType([inner.schema["row"], T.StructField("made", T.StringType())]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("made").alias(column))


def render(arranged: DataFrame, *, text_col: str = "text", output_col: str = "output") -> DataFrame:
    """All columns, with the output text that the pieces stand for."""
    return _mapped(arranged, text_col, "pieces", "form", output_col, lambda text, pieces, _: b"".join(stream([Piece(**p) for p in pieces], text)))


def restore(rendered: DataFrame, *, output_col: str = "output", text_col: str = "restored") -> DataFrame:
    """All columns, with the text that an output of a form was made from."""
    return _mapped(rendered, output_col, "form", "form", text_col, lambda output, form, _: b"".join(stream(restored(output, form), output)))
