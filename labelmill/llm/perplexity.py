"""Operator 9: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays and memory-mapped by workers.

Counting: each task hashes its words, counts its distinct bigrams with numpy, and hands one packed array to each shard. A shard's task adds
them up and writes one file to the shared folder: its bigrams' keys in order with their counts, and its contexts' hashes in order with their
totals and how many words follow them once, twice, and more often. Words' continuation counts go the same way in a second, smaller round.
Contexts so frequent that they would overload a shard (found on a sample that is used for this alone) are spread over all shards by bigram.

Scoring: workers map the files of the shared folder into memory and look bigrams up by binary search, sorted within each chunk of text. With
count-dependent discounts D, p(w|v) = (c(vw) - D(c)) / c(v) + rest(v) * p(w); p(w) is the same with the number of words before w as count, and
its rest falls to 1 / (known words + 1). An unknown context leaves p(w). Hashes of words keep 64 bits as context and 40 as successor.

Words are apart at white space, A-Z lower-cased, and every text ends with one end token. A text's context begins with a start mark.

Cases: null texts are empty (one end token); a null id is not learned from and counts as held out; without training text all scores are 0;
repeated rows count as often as they come; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, fold, mix, stage, text_buffer, word_hashes, word_spans
from labelmill.session import shared_dir

START, END = np.uint64(0), np.uint64(0xE11DE11DE11DE11D)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_SUCCESSOR = np.uint64(24)  # a successor keeps the upper 40 bits of its word's hash
_FULL = 255
_CHUNK = 4_000_000
_BALANCE_ROWS = 2000


def token_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and words of all tokens of the batch, each text closed by its end token; and where each text begins."""
    data, at = text_buffer(batch.column("text"))
    begins, ends, first = word_spans(data, at)
    hashes = word_hashes(data, begins, ends)
    counts = np.diff(first) + 1
    close = np.cumsum(counts)
    words = np.empty(int(close[-1]) if len(close) else 0, np.uint64)
    is_end = np.zeros(len(words), bool)
    is_end[close - 1] = True
    words[~is_end], words[is_end] = hashes, END
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[close - counts] = START
    return before, words, close - counts


def _bigram_keys(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    return mix(context * _FACTOR ^ successor)


def _shard_of(context: np.ndarray, successor: np.ndarray, shards: int, frequent: np.ndarray) -> np.ndarray:
    own = context >> np.uint64(20)
    spread = np.isin(context, frequent)
    own[spread] = _bigram_keys(context[spread], successor[spread]) >> np.uint64(3)
    return (own % np.uint64(shards)).astype(np.int64)


def _pack_counts(counts: np.ndarray) -> bytes:
    large = counts >= _FULL
    return np.minimum(counts, _FULL).astype(np.uint8).tobytes() + counts[large].astype("<u4").tobytes()


def _unpack_counts(data: memoryview, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = counts == _FULL
    counts[large] = np.frombuffer(data, "<u4", int(large.sum()), n)
    return counts


def _forty(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_forty(data: memoryview, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _pack(context: np.ndarray, successor: np.ndarray, counts: np.ndarray) -> bytes:
    """Bigrams sorted by context: contexts once each, with their numbers of successors."""
    heads, sizes = np.unique(context, return_counts=True)
    lead = np.array([len(heads), len(context)], "<i8").tobytes()
    return lead + heads.tobytes() + sizes.astype("<u4").tobytes() + _forty(successor) + _pack_counts(counts)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(blob)
    h, n = np.frombuffer(view, "<i8", 2).tolist()
    heads, sizes = np.frombuffer(view, np.uint64, h, 16), np.frombuffer(view, "<u4", h, 16 + 8 * h)
    at = 16 + 12 * h
    return np.repeat(heads, sizes), _from_forty(view[at:], n), _unpack_counts(view[at + 5 * n :], n)


def _summed(context: np.ndarray, successor: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((successor, context))
    context, successor, counts = context[order], successor[order], counts[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
    first = np.flatnonzero(new)
    return context[first], successor[first], np.add.reduceat(counts, first) if len(first) else counts


def _by_count(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist()


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file of arrays in the shared folder; written aside and renamed, so that tasks that run again do no harm."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    aside = f"{base}/{name}.{np.random.default_rng().integers(1 << 62)}"
    with system.open_output_stream(aside) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
            out.write(b"\0" * (-array.nbytes % 8))
    system.move(aside, f"{base}/{name}")


def _mapped(folder: str, name: str, shapes: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of a file, mapped where the shared folder is mounted, else read."""
    system, base = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        data = np.memmap(f"{base}/{name}", np.uint8, "r")
    else:
        with system.open_input_file(f"{base}/{name}") as file:
            data = np.frombuffer(file.read(), np.uint8)
    out, at = [], 0
    for kind, n in shapes:
        size = np.dtype(kind).itemsize * n
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _frequent_contexts(rows: DataFrame, shards: int) -> np.ndarray:
    """Contexts with more than a quarter of a shard's share in a small sample; the start mark is always one. Only how work is dealt depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text", _CHUNK):
            keys, counts = np.unique(token_hashes(batch)[0], return_counts=True)
            often = counts * 8 * shards > counts.sum()
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

    some = rows.limit(_BALANCE_ROWS).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(4 * shards).toPandas()
    return np.unique(np.append(some["h"].to_numpy(np.int64).view(np.uint64), START))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", where: str | None = None) -> dict:
    """Counts all rows (or those ``where`` holds) and writes the model's files; returns where they are, their sizes, and the model's constants."""
    rows = docs.where(where) if where else docs
    rows = rows.select(F.col(text_col).alias("text"))
    folder = shared_dir(docs.sparkSession, "ngrams")
    shards = min(1024, max(8, rows.rdd.getNumPartitions()))
    frequent = _frequent_contexts(rows, shards)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(c) for c in zip(*parts, strict=True)))

        for batch in chunked(batches, "text", _CHUNK):
            context, word, _ = token_hashes(batch)
            parts.append(_summed(context, word >> _SUCCESSOR, np.ones(len(word), np.int64)))
            size += len(parts[-1][0])
            if size > 6_000_000:
                yield from deal(merged())
                parts, size = [], 0
        if parts:
            yield from deal(merged())

    def deal(bigrams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        shard = _shard_of(bigrams[0], bigrams[1], shards, frequent)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            own = order[edges[s] : edges[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([_pack(*(c[own] for c in bigrams))], pa.binary())], ["shard", "blob"])

    def shard_file(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        context, successor, counts = _summed(*(np.concatenate(c) for c in zip(*map(_unpack, frame["blob"]), strict=True)))
        heads, first = np.unique(context, return_index=True)
        total = np.add.reduceat(counts, first)
        follow = [np.add.reduceat((counts == n) if n < 3 else (counts >= 3), first, dtype=np.int64) for n in (1, 2, 3)]
        often = np.isin(heads, frequent)
        keys = _bigram_keys(context, successor)
        order = np.argsort(keys)
        keys, sorted_counts = keys[order], counts[order]
        large = np.flatnonzero(sorted_counts >= _FULL)
        own = ~often
        _write(folder, f"bigrams-{shard}", [keys, np.minimum(sorted_counts, _FULL).astype(np.uint8), large.astype(np.int64), sorted_counts[large], heads[own], np.stack([total, *follow], 1)[own].astype(np.uint32)])
        rows = [("file", shard, [len(keys), len(large), int(own.sum()), *_by_count(counts), int(total.sum())], None)]
        rows += [("context", int(h.view(np.int64)), [int(t), *map(int, f)], None) for h, t, *f in zip(heads[often], total[often], *(x[often] for x in follow), strict=True)]
        words, before = np.unique(successor, return_counts=True)
        part = (words >> np.uint64(10)) % np.uint64(shards)
        for p in np.unique(part):
            mine = part == p
            rows.append(("words", int(p), [], np.array([int(mine.sum())], "<i8").tobytes() + _forty(words[mine]) + _pack_counts(before[mine])))
        return pd.DataFrame(rows, columns=["kind", "id", "numbers", "blob"])

    def word_file(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        words, before = [], []
        for blob in frame["blob"]:
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            view = memoryview(blob)[8:]
            words.append(_from_forty(view, n))
            before.append(_unpack_counts(view[5 * n :], n))
        unique, inverse = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(before)).astype(np.int64)
        _write(folder, f"words-{part}", [unique, counts.astype(np.uint32)])
        return pd.DataFrame([("words", part, [len(unique), *_by_count(counts), int(counts.sum()), int((counts >= 3).sum())], None)], columns=["kind", "id", "numbers", "blob"])

    schema = "kind string, id long, numbers array<long>, blob binary"
    first = stage(rows.mapInArrow(count, "shard long, blob binary").groupBy("shard").applyInPandas(shard_file, schema), "bigram_shards")
    second = first.where("kind = 'words'").groupBy("id").applyInPandas(word_file, schema).drop("blob").collect()  # one row a shard
    files = first.where("kind = 'file'").drop("blob").collect()  # one row a shard
    hot = first.where("kind = 'context'").groupBy("id").agg(*[F.sum(F.col("numbers")[i]).alias(f"x{i}") for i in range(4)]).collect()  # the frequent ones
    sizes = {r["id"]: r["numbers"][:3] for r in files}
    contexts = {np.int64(r["id"]).view(np.uint64).item(): [r[f"x{i}"] for i in range(4)] for r in hot}
    documents = contexts.get(int(START), [0])[0]
    tokens = sum(r["numbers"][7] for r in files)  # as many successors as tokens
    word_sizes = {r["id"]: r["numbers"][0] for r in second}
    distinct = sum(s[2] for s in sizes.values()) + len(contexts) - (int(START) in contexts) + (documents > 0)
    by_count = lambda rows, at: np.sum([r["numbers"][at : at + 4] for r in rows], axis=0) if rows else np.zeros(4)
    below = by_count(second, 1)
    return {
        "folder": folder, "shards": shards, "frequent": frequent, "sizes": sizes, "word_sizes": word_sizes, "contexts": contexts, "documents": documents, "tokens": tokens,
        "distinct": distinct, "discounts": discounts(by_count(files, 3)), "lower": discounts(below),
        "bigrams": sum(r["numbers"][5] for r in second), "lower_kinds": [int(below[0]), int(below[1]), sum(r["numbers"][6] for r in second)], "words": sum(word_sizes.values()),
    }


def discounts(by_count: np.ndarray) -> np.ndarray:
    """D(0) to D(3 and more) from how many n-grams occur once to four times. Where these are too few to tell, 1/2."""
    n1, n2, n3, n4 = (float(x) for x in by_count)
    if min(n1, n2, n3) <= 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1))])


class Scorer:
    """The model of one worker: mapped files, and lookups for many tokens at once."""

    def __init__(self, model: dict):
        self.model, self.bigrams, self.words = model, {}, {}
        self.hot = np.array(sorted(model["contexts"]), np.uint64)
        self.hot_rows = np.array([model["contexts"][int(h)] for h in self.hot], np.int64).reshape(-1, 4)

    def _shard(self, s: int) -> list[np.ndarray]:
        if s not in self.bigrams:
            n, large, heads = self.model["sizes"].get(s, (0, 0, 0))
            shapes = [(np.uint64, n), (np.uint8, n), (np.int64, large), (np.int64, large), (np.uint64, heads), (np.uint32, 4 * heads)]
            self.bigrams[s] = _mapped(self.model["folder"], f"bigrams-{s}", shapes) if n else [np.zeros(0, t) for t, _ in shapes]
        return self.bigrams[s]

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    @staticmethod
    def _by_shard(shard: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.lexsort((keys, shard))
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=1 << 40))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(shard[order[a]]), order[a:b]

    def bigram_counts(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        out = np.zeros(len(context), np.int64)
        keys = _bigram_keys(context, successor)
        for s, own in self._by_shard(_shard_of(context, successor, self.model["shards"], self.model["frequent"]), keys):
            sorted_keys, small, large, values, *_ = self._shard(s)
            at, found = self._find(sorted_keys, keys[own])
            if len(sorted_keys):
                counts = np.where(found, small[at], 0).astype(np.int64)
                full = np.flatnonzero(counts == _FULL)
                counts[full] = values[np.searchsorted(large, at[full])]
                out[own] = counts
        return out

    def context_rows(self, context: np.ndarray) -> np.ndarray:
        """Total, and how many words follow once, twice, more often; zeros for a context never seen."""
        out = np.zeros((len(context), 4), np.int64)
        at, found = self._find(self.hot, context)
        out[found] = self.hot_rows[at[found]]
        rest = np.flatnonzero(~found)
        for s, own in self._by_shard(_shard_of(context[rest], context[rest], self.model["shards"], self.model["frequent"]), context[rest]):
            *_, heads, rows = self._shard(s)
            at, found = self._find(heads, context[rest[own]])
            if len(heads):
                out[rest[own[found]]] = rows.reshape(-1, 4)[at[found]]
        return out

    def word_counts(self, successor: np.ndarray) -> np.ndarray:
        """How many different contexts come before each word."""
        out = np.zeros(len(successor), np.int64)
        for p, own in self._by_shard(((successor >> np.uint64(10)) % np.uint64(self.model["shards"])).astype(np.int64), successor):
            n = self.model["word_sizes"].get(p, 0)
            if n:
                if p not in self.words:
                    self.words[p] = _mapped(self.model["folder"], f"words-{p}", [(np.uint64, n), (np.uint32, n)])
                keys, counts = self.words[p]
                at, found = self._find(keys, successor[own])
                out[own] = np.where(found, counts[at], 0)
        return out

    def score(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        model = self.model
        before, words, first = token_hashes(batch)
        successor = words >> _SUCCESSOR
        heads, head = np.unique(np.concatenate([before, words]), return_inverse=True)
        rows = self.context_rows(heads)
        seen = rows[:, 0].copy()
        seen[heads == END] = model["documents"]
        own = seen[head[len(words) :]]
        base = np.log10((own + 1) / (model["tokens"] + model["distinct"] + 1))
        kinds, kind = np.unique(successor, return_inverse=True)
        ahead = self.word_counts(kinds)
        if model["bigrams"]:
            lower = (ahead - model["lower"][np.minimum(ahead, 3)]) / model["bigrams"]
            lower += model["lower"][1:] @ np.array(model["lower_kinds"]) / model["bigrams"] / (model["words"] + 1)
        else:
            lower = np.ones(len(kinds))
        p = lower[kind]
        context = rows[head[: len(words)]]
        counts = self.bigram_counts(before, successor)
        total = np.maximum(context[:, 0], 1)
        mixed = (counts - model["discounts"][np.minimum(counts, 3)]) / total + context[:, 1:] @ model["discounts"][1:] / total * p
        p = np.where(context[:, 0] > 0, mixed, p)
        sums = [np.add.reduceat(x, first) for x in (np.ones(len(words), np.int64), (own > 0).astype(np.int64), base, np.log10(p))]
        return sums


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` (log10) for every row; perplexity is 10 ** (-score / n_tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model["folder"] not in _scorers:
            _scorers.clear()
            _scorers[model["folder"]] = Scorer(model)
        scorer = _scorers[model["folder"]]
        for batch in chunked(batches, "text"):
            tokens, known, base, value = scorer.score(batch)
            train = np.full(len(tokens), model["tokens"], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (tokens, known, train, base, value))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
