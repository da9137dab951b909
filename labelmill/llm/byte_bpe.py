"""Operator 12: byte-level BPE encoding and decoding, by a sentencepiece model written from a vocabulary of ranks.

The model is serialised here: each token is a piece whose characters stand for its bytes (byte ``b`` is code point 256 + b), scored by its
negative rank, so that the library merges the pair of least rank, leftmost first. Normalisation is the identity, without added or escaped
spaces. A text is cut into pre-tokens by a pattern; each is encoded by itself, or is one token where the vocabulary has it whole, merges or
not. Ids are ranks. Decoding maps each piece's characters back to bytes. Letters, numbers and spaces of a pattern are those of the ``regex`` package's
Unicode tables; a library with older tables can cut differently at characters assigned since.

Ids come as packed little-endian unsigned 32-bit numbers, so they may be digested as they are; ``octet_length(ids) / 4`` counts them.

Cases: null and empty texts have no ids and decode to no bytes; long texts are cut and encoded in steps of bounded size; repeated rows are encoded
each; an empty table gives no rows; columns of the names added are replaced, all others kept.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import chunked

#: A byte's character.
OFFSET = 256
#: A worker forgets its pre-tokens beyond these, and never keeps longer ones; they are only encoded again.
KEPT, KEPT_CHARS = 300_000, 64
#: Texts of more characters are cut into pre-tokens a part at a time.
_LONG_TEXT, _PART = 1 << 20, 1 << 17

# Fields and codes of the model format.
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2
_UNKNOWN_PIECE = "<unk>"


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: per line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary: piece ``i`` is the token of rank ``i``; the piece for unknown characters is the last."""
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("A vocabulary needs ranks without gaps, and every single byte")
    out = [_piece(as_characters(t), -float(i), _NORMAL) for i, t in enumerate(tokens)]
    out.append(_piece(_UNKNOWN_PIECE, 0.0, _UNKNOWN))
    trainer = _number(3, _BPE) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_varint(f << 3) + _varint((1 << 64) - 1) for f in (41, 42, 43))
    normalizer = _bytes(1, b"identity") + _bytes(2, b"") + b"".join(_number(f, 0) for f in (3, 4, 5))
    return b"".join(out) + _bytes(2, trainer) + _bytes(3, normalizer)


_TO_CHARACTERS = {b: OFFSET + b for b in range(256)}
_TO_BYTES = {OFFSET + b: b for b in range(256)}


def as_characters(token: bytes) -> str:
    return token.decode("latin-1").translate(_TO_CHARACTERS)


def as_bytes(piece: str) -> bytes:
    return piece.translate(_TO_BYTES).encode("latin-1")


class Codec:
    """Encodes and decodes with a serialised model."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size() - 1)]
        self.tokens = list(map(as_bytes, pieces))
        self.whole = {token: struct.pack("<I", i) for i, token in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _learn(self, pretokens: list[str]) -> dict[str, bytes]:
        """The packed ids of each pre-token."""
        raw = [p.encode() for p in pretokens]
        out = {p: self.whole[r] for p, r in zip(pretokens, raw, strict=True) if r in self.whole}
        merged = [(p, as_characters(r)) for p, r in zip(pretokens, raw, strict=True) if p not in out]
        for (p, _), ids in zip(merged, self.processor.encode([c for _, c in merged], out_type=int, num_threads=1), strict=True):
            out[p] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        if len(text) <= _LONG_TEXT:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, _PART)):
            yield part

    def _pack(self, parts: list[list[str]]) -> Iterator[bytes]:
        """The packed ids of each list of pre-tokens; those not known yet are encoded together."""
        wanted = set().union(*parts)
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > KEPT:
            self.known, new = {}, wanted
        learned = self._learn(list(new)) if new else {}
        kept = {p: ids for p, ids in learned.items() if len(p) <= KEPT_CHARS}
        self.known.update(kept)
        for part in parts:
            if len(kept) == len(learned):
                yield b"".join(map(self.known.__getitem__, part))
            else:
                yield b"".join([self.known[p] if p in self.known else learned[p] for p in part])

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[list[bytes]] = []
        held: list[tuple[int, list[str]]] = []

        def flush() -> None:
            for (i, _), ids in zip(held, self._pack([part for _, part in held]), strict=True):
                out[i].append(ids)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            out.append([])
            for part in self._pretokens(text or ""):
                held.append((i, part))
                size += len(part)
                if size >= _PART:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, packed: Iterable[bytes]) -> Iterator[bytes]:
        """The bytes of each text's packed ids."""
        for ids in packed:
            parts = []
            for begin in range(0, len(ids), 4 * _PART):
                part = memoryview(ids)[begin : begin + 4 * _PART]
                parts.append(b"".join(map(self.tokens.__getitem__, struct.unpack(f"<{len(part) // 4}I", part))))
            yield b"".join(parts)


@lru_cache(maxsize=2)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _added(docs: DataFrame, source: str, model: bytes, pattern: str, names: list[str], step) -> DataFrame:
    """All columns, with binary columns ``names`` that ``step`` makes of ``source`` in chunks."""
    shared = docs.sparkSession.sparkContext.broadcast((model, pattern))  # its size is that of the vocabulary
    rest = [c for c in docs.columns if c not in names]
    others = [F.col(f"`{c}`") for c in rest if c != source]
    inner = docs.select((F.struct(*others) if others else F.lit(0)).alias("rest"), F.col(f"`{source}`").alias("source"))
    schema = T.StructType([*inner.schema.fields, *[T.StructField(n, T.BinaryType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in chunked(batches, "source"):
            yield pa.RecordBatch.from_arrays([*batch.columns, *step(codec, batch.column("source"))], ["rest", "source", *names])

    out = inner.mapInArrow(run, schema)
    own = {c: F.col(f"rest.`{c}`").alias(c) for c in rest if c != source} | {source: F.col("source").alias(source)}
    return out.select(*[own[c] for c in rest], *[f"`{n}`" for n in names])


def encode(docs: DataFrame, model: bytes, pattern: str, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """All columns, with the packed ids of each text; ``decoded_col`` names a further column for the bytes that these ids decode to."""
    def step(codec: Codec, texts: pa.Array) -> list[pa.Array]:
        packed = codec.encode(texts.to_pylist())
        out = [pa.array(packed, pa.binary())]
        if decoded_col:
            out.append(pa.array(list(codec.decode(packed)), pa.binary()))
        return out

    return _added(docs, text_col, model, pattern, [ids_col, *([decoded_col] if decoded_col else [])], step)


def decode(rows: DataFrame, model: bytes, pattern: str, *, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """All columns, with the bytes that packed ids stand for; null ids are none."""
    return _added(rows, ids_col, model, pattern, [decoded_col], lambda codec, ids: [pa.array(list(codec.decode(x or b"" for x in ids.to_pylist())), pa.binary())])
