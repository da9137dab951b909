"""Operator 10: tokenized documents packed into sequences, best fit decreasing.

Only longer documents are cut, into whole pieces of ``capacity`` tokens and a last piece. Pieces of one length are interchangeable, so best
fit decreasing needs no more than how many pieces there are of each length: ``plan_sequences`` runs it over that histogram (at most
``capacity`` rows, whatever the corpus) with a segment tree over remaining capacities, and yields for each length which ranks go where.
Spark tokenizes, ranks the pieces of each length, and places them by the plan.

A bin is never filled with what another rank of the same length could not fill as well; so the result is that of the plain algorithm on all
pieces in descending order, up to the numbers of the bins.

Cases: null text is an empty one (its one token is the end token); null ids and repeated rows are packed like others; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, stage, text_buffer, word_hashes

CAPACITY = 4096
END_ID = 1
_KEPT_UNITS = 800_000  # a worker forgets its units beyond these; they are only encoded again
_STEP = 1 << 19  # bytes of text at a time: arrays over them take tens of times as much
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Kinds of bytes. Those of ``_JOINED`` are never cut from a neighbour: apostrophes, which begin contractions, and what is not known by its byte.
_SPACE, _LETTER, _DIGIT, _SIGN, _JOINED = range(5)
_WORD_KINDS = np.full(256, _JOINED, np.uint8)
_WORD_KINDS[[9, 10, 13, 32]] = _SPACE
_KINDS = _WORD_KINDS.copy()
for _code in range(128):
    if _KINDS[_code] != _SPACE and _code != ord("'"):
        _KINDS[_code] = _LETTER if chr(_code).isalpha() else _DIGIT if chr(_code).isdigit() else _SIGN
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF: letters, but for the two whose second bytes follow
_NO_LETTERS = (0x97, 0xB7)
# Whether a unit ends between two bytes, by the first one's kind times 5 and the second one's.
_CUT = np.array([(a != b and _JOINED not in (a, b)) or _SPACE in (a, b) or a == b == _DIGIT for a in range(5) for b in range(5)])

# What a tokenizer must do for its words to be cut: signs, letters and single digits apart, whatever stands beside them.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _cuts_words(told: dict) -> bool:
    """Whether a tokenizer (its file) cuts words as units are cut here. Its added tokens must be found as they stand, and not be words."""
    return (
        told.get("normalizer") == {"type": "Sequence", "normalizers": _NORMALIZERS}
        and told.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": _PRE_TOKENIZERS}
        and not any(t["content"].isalpha() or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told.get("added_tokens", []))
    )


class _Letters(dict):
    """For ``str.translate``: what a tokenizer hands its model for each letter; a blank for other characters."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, code: int) -> str:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{self.tokenizer.normalizer.normalize_str(chr(code))}a")
        self[code] = pieces[0][0][1:-1] if len(pieces) == 1 and chr(code).isalpha() else " "
        return self[code]


class WordEncoder:
    """Token ids of whole texts for a tokenizer that drops white space and never merges over it: every unit of text is encoded once.

    Words, the runs between blanks, tabs and line ends, are units. Where the tokenizer's file shows that it cuts words further, units are runs of
    letters, runs of signs and single digits, so that neither numbers nor signs at a word's ends make new ones; added tokens stay whole. Units of
    letters alone go to the library's model as the tokenizer would hand them on, all others through the whole tokenizer. Known units are looked
    up by a 64-bit hash in a sorted array, which takes a tenth of a dictionary's memory.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.cuts = _cuts_words(told)
        self.added = [t["content"].encode() for t in told.get("added_tokens", [])]
        self.letters, self.model = _Letters(self.tokenizer), self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.begin, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every unit of every text (no unit spans two texts), and the number of the first unit of each text, closed by the total."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        cut = np.ones(len(data) + 1, bool)
        if self.cuts:
            kinds = _KINDS[data]
            latin = np.flatnonzero(data[:-1] == _LATIN)
            latin = latin[~np.isin(data[latin + 1], _NO_LETTERS)]
            kinds[latin] = kinds[latin + 1] = _LETTER
        else:
            kinds = _WORD_KINDS[data]
        cut[1:-1] = _CUT[kinds[:-1] * 5 + kinds[1:]]
        if self.cuts:
            raw = data.tobytes()
            for token in self.added:
                found = raw.find(token)
                while found >= 0:
                    cut[found + 1 : found + len(token)] = False
                    found = raw.find(token, found + 1)
        cut[at] = True
        bounds = np.flatnonzero(cut)
        inside = np.flatnonzero(kinds[bounds[:-1]] != _SPACE)
        begins = bounds[inside]
        return begins, bounds[inside + 1], np.searchsorted(begins, at)

    def _ids(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        out: list[list[int]] = [[]] * len(units)
        others = []
        for i, unit in enumerate(units):
            letters = unit.translate(self.letters) if self.cuts else " "
            if " " not in letters and unicodedata.is_normalized("NFC", unit):
                out[i] = [token.id for token in self.model.tokenize(letters)]
            else:
                others.append(i)
        for begin in range(0, len(others), 5000):
            part = others[begin : begin + 5000]
            encoded = self.tokenizer.encode_batch_fast([units[i] for i in part], add_special_tokens=False)
            for i, encoding in zip(part, encoded, strict=True):
                out[i] = encoding.ids
        return out

    def _learn(self, hashes: np.ndarray, units: list[str]) -> np.ndarray:
        encoded = self._ids(units)
        n = len(self.known)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        total = int(sizes.sum())
        while n + len(units) > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.begin[n : n + len(units)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(units)] = sizes
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.uint32, total)
        self.used += total
        places, into = np.arange(n, n + len(units)), np.searchsorted(self.known, hashes)
        self.known, self.place = np.insert(self.known, into, hashes), np.insert(self.place, into, places)
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.known) > _KEPT_UNITS:
            self._forget()
        data, at = text_buffer(texts)
        begins, ends, first = self._spans(data, at)
        distinct, sample, inverse = np.unique(word_hashes(data, begins, ends, fold_case=False), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        places = np.where(self.known[at] == distinct, self.place[at], -1) if len(self.known) else np.full(len(distinct), -1)
        new = np.flatnonzero(places < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(begins[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)
            places[new] = self._learn(distinct[new], [raw[a:b].decode() for a, b in spans])
        units = places[inverse]
        sizes = self.size[units]
        until = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.begin[units] - until[:-1], sizes) + np.arange(until[-1])]
        bounds = until[first].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its document, number, first token and length, and the checksum of its ids. The tokenizer is a file every worker has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in chunked(batches, "text", _STEP):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


class CapacityTree:
    """How many open bins there are of each remaining capacity, as a segment tree: the tightest fit is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity of at least ``size`` that an open bin has, or -1."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit decreasing over a histogram of lengths: rows (length, first rank, ranks, first bin, ranks per bin, offset).

    Rank r of a row goes to bin ``first bin + (r - first rank) // per`` at ``offset + (r - first rank) % per * length``. When a piece went into
    the tightest bin, that bin is the tightest for the next equal piece as long as it has room; so whole runs of equal bins are filled at once.
    """
    tree = CapacityTree(capacity)
    runs: dict[int, deque[tuple[int, int]]] = {}  # remaining capacity: runs of (first bin, bins)
    plan: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, deque()).append((first, n))
            tree.add(room, n)

    def fill(length: int, rank: int, left: int, room: int, first: int, n: int) -> int:
        """Fills bins of one room, as many as are needed; the number of pieces placed."""
        per = room // length
        full, rest = divmod(left, per)
        whole = min(n, full)
        if whole:
            plan.append((length, rank, whole * per, first, per, capacity - room))
            put(room - per * length, first, whole)
        if whole < n:
            if rest and whole == full:
                plan.append((length, rank + whole * per, rest, first + whole, rest, capacity - room))
                put(room - rest * length, first + whole, 1)
                whole += 1
                put(room, first + whole, n - whole)
                return left
            put(room, first + whole, n - whole)
        return min(left, whole * per)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].popleft()
                tree.add(room, -n)
            placed = fill(length, rank, left, room, first, n)
            rank, left = rank + placed, left - placed
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def best_fit_pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there. Sequences are gapless and hold at most ``capacity`` tokens."""
    pieces = tokenize_pieces(docs, tokenizer, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col)
    spark = docs.sparkSession
    # The salt splits lengths that very many pieces have; ranks follow from the counts of the parts before.
    salted = stage(pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(1024)).cast("int")), "pieces")
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece_counts")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    plan = plan_sequences(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = spark.sparkContext.broadcast(plan[order])  # its rows depend on the capacity, not on the corpus
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("_rank", F.row_number().over(within) - 1)
        .join(parts.select("length", "_salt", "_before"), ["length", "_salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            row = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
