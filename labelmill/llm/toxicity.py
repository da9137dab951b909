"""Operator 8: toxicity of whole texts after noisy-channel deobfuscation.

* Character model: Spark counts letter 4-grams over all texts (letters a-z, one class for all other letters, one mark for a word's ends); each text begins
  after and ends with a mark, so the counts do not depend on how the texts are split over tasks.
* Channel: runs that look disguised (signs or digits within letters, single letters spaced out, a letter three times or more) become a lattice
  of readings for each character: itself, letters it stands for, a repetition to collapse, a sign to skip. Viterbi decoding, over all states, finds the
  reading that the character model and the channel's fixed costs make likeliest. A letter repeated more than three times counts as three. Spaced or
  dotted runs of more than ``LONG_RUN`` characters, whatever their length, are no single word: there a separator can also be read as a word's end. Other tokens
  that stay longer than that have no separators and are no words but keys or hashes; they stay as they are.
* Score: words of the restored text and their first four and five letters have an evidence, the smoothed log ratio of their shares among toxic
  and other documents. A logistic regression on a document's strongest evidence, the sum of its three strongest, and its length gives the score.

Evidence and regression are fitted on a bounded sample of labelled rows, ``sample`` of each class in order of a hash of their ids, and the model keeps
the ``terms`` strongest words and beginnings; rows whose crc32 of the id leaves 0 modulo ``folds`` are never used.

Cases: null and empty texts score as texts without words; conflicting labels of one id count as toxic; null labels and ids are not learned
from, and a null id counts as held out; if one class is missing, every score is 0; other columns and other languages need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import LOWER, chunked, fold, stage, text_buffer

SAMPLE = 6000
_CLASSES = np.full(256, 29, np.int64)  # 0: a word's end, 1-26: a-z, 27: other letters, 29: none of these
_CLASSES[97:123] = np.arange(1, 27)
_CLASSES[128:] = 27
_SIZE = 32**4
_WORD = re.compile(r"[^\W\d_]+")
# What signs and digits stand for in disguised words.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou"}
_SIGNS = re.escape("".join(READINGS))
_PIECE = re.compile(rf"[a-z{_SIGNS}.\-_]+")
_DISGUISED = re.compile(
    rf"(?<![a-z])(?:[a-z]*[{_SIGNS}](?=[a-z{_SIGNS}]*[a-z])[a-z{_SIGNS}.\-_]*|[a-z]+[{_SIGNS}][a-z{_SIGNS}.\-_]*"  # s1gns
    r"|[a-z]*([a-z])\1\1[a-z]*"  # repeeeated
    r"|[a-z](?:[.\-_][a-z]){2,}(?![^\W_]))"  # d.o.t.t.e.d
)
_SPACED = re.compile(rf"[\W_]((?:[a-z{_SIGNS}][ .\-_*]{{1,3}}){{2,}}[a-z{_SIGNS}](?![^\W_]))")  # s p a c e d
_DOTTED = re.compile(r"(?<![a-z])[a-z](?:[.\-_]+[a-z](?![a-z]))+")
_TRIPLE = re.compile(r"([a-z])\1\1")
_POINTS = ".,;:?'\""  # around a word, these disguise nothing
_REPEATED = re.compile(r"([a-z])\1{3,}")
LONG_RUN = 48  # no word is written in more characters, once repetitions are cut to three
TERMS = 1 << 16
_COST = {"itself": 0.0, "sign": 0.5, "skip": 0.3, "repeat": 0.4, "double": 1.2, "end": 0.3}


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter 4-grams over all texts, as one vector of 32^4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE, np.int64)
        for batch in chunked(batches, "text"):
            data, at = text_buffer(batch.column("text"))
            sizes = np.diff(at)
            code = _CLASSES[LOWER[data]]
            code[code == 29] = 0
            line = np.zeros(len(code) + 3 * len(sizes) + 3, np.int64)  # three marks before each text; the first of the next ones ends it
            place = np.arange(len(code)) + 3 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
            line[place] = code
            last = at[1:][sizes > 0] + 3 * np.arange(1, len(sizes) + 1)[sizes > 0]
            for counted in (place, last):
                grams = line[counted - 3] << 15 | line[counted - 2] << 10 | line[counted - 1] << 5 | line[counted]
                total += np.bincount(grams, minlength=_SIZE)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # 32^4 rows at most
    out = np.zeros(_SIZE)
    out[counted["gram"].to_numpy(np.int64)] = counted["n"]
    return out


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-log2 of each letter after three, interpolated down to shorter contexts (Witten-Bell)."""
    chance = np.full(32, 1 / 28)
    for order in range(4):
        table = counts.reshape(-1, 32 ** (order + 1)).sum(axis=0).reshape(-1, 32)
        total, distinct = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        shorter = np.tile(chance.reshape(-1, 32), (32 if order else 1, 1)) if order else chance[None, :]
        chance = np.where(total > 0, (table + distinct * shorter) / np.maximum(total + distinct, 1), shorter)
    return -np.log2(np.maximum(chance, 1e-12)).reshape(-1)


def decode(run: str, costs: Sequence[float], collapse: bool = True, ends: bool = False) -> str:
    """The likeliest reading of a disguised run: the best path through the lattice of its characters' readings; with repetitions collapsed or not, and with
    ``ends`` also reading separators as word ends (spaces). A state is the three letters before, so there are as many as three characters have readings."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # its least cost, and the letters read, last first
    last = ""
    for char in run:
        again = collapse and char == last
        options = [(ord(c) - 96, c, _COST["double"] if again else _COST["itself"]) for c in char if "a" <= c <= "z"]
        options += [(ord(c) - 96, c, _COST["sign"] + (_COST["double"] if again else 0)) for c in READINGS.get(char, "")]
        stays = [_COST["repeat"]] if again else []
        if not char.isalpha():
            stays.append(_COST["skip"] + (2.5 if options else 0))
            if ends and not options:
                options.append((0, " ", _COST["end"]))
        stay = min(stays, default=None)
        following: dict[int, tuple[float, tuple | None]] = {}
        for before, (cost, letters) in states.items():
            for code, letter, extra in options:
                place = before << 5 | code
                value = cost + extra + costs[place]
                held = following.get(place & 0x7FFF)
                if held is None or value < held[0]:
                    following[place & 0x7FFF] = value, (letters, letter)
            if stay is not None:
                held = following.get(before)
                if held is None or cost + stay < held[0]:
                    following[before] = cost + stay, letters
        if following:
            states, last = following, char
    best = min(states.items(), key=lambda s: s[1][0] + costs[s[0] << 5])[1][1]
    out = []
    while best is not None:
        best, letter = best
        out.append(letter)
    return "".join(reversed(out))


class Restorer:
    """Words of texts as they are and as restored. What was read is kept, up to a number of tokens and runs."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known, self.tokens = memoryview(np.ascontiguousarray(costs, np.float64)), {}, {}
        self.plain: set[str] = set()  # tokens that are words as they stand

    def readings(self, run: str) -> set[str]:
        run = _REPEATED.sub(r"\1\1\1", run)
        if len(run) > LONG_RUN:
            return {w for collapse in (True, False) for w in decode(run, self.costs, collapse, ends=True).split()}
        if run not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            starts = [run, run[2:]] if run[:2] in ("a ", "i ") else [run]  # the one letter may be a word of its own
            doubled = any(map(str.__eq__, run, run[1:]))
            self.known[run] = {decode(r, self.costs, collapse) for r in starts for collapse in ((True, False) if doubled else (True,))} - {""}
        return self.known[run]

    def _token(self, token: str) -> tuple[str, ...]:
        plain = token.strip(_POINTS)
        if plain.isalpha() and not _TRIPLE.search(plain):
            return (plain,)
        found = set(_WORD.findall(token))
        for piece in _PIECE.findall(_REPEATED.sub(r"\1\1\1", token)):
            if len(piece) > LONG_RUN:
                for match in _DOTTED.finditer(piece):
                    if len(match[0]) > LONG_RUN:
                        found |= self.readings(match[0])
            for part in [piece] if len(piece) <= LONG_RUN else re.split(r"[.\-_]+", piece):
                if len(part) <= LONG_RUN:
                    for match in _DISGUISED.finditer(part):
                        found |= self.readings(match[0])
        return tuple(found)

    def words(self, text: str) -> set[str]:
        low, tokens = text.lower(), self.tokens
        distinct = set(low.split())
        found = distinct & self.plain
        for token in distinct - found:
            words = tokens.get(token)
            if words is None:
                words = self._token(token)
                if len(token) <= 2 * LONG_RUN:
                    if len(tokens) + len(self.plain) > 400_000:
                        tokens.clear()
                        self.plain.clear()
                    if words == (token,):
                        self.plain.add(token)
                    else:
                        tokens[token] = words
            found.update(words)
        for match in _SPACED.finditer(" " + low):
            found |= self.readings(match[1])
        return found


def _keys(word: str) -> tuple[str, ...]:
    n = len(word)
    return (word,) if n <= 4 else (word, word[:4] + "*") if n == 5 else (word, word[:4] + "*", word[:5] + "*")


class Evidence:
    @classmethod
    def of(cls, model: dict) -> Evidence:
        """Kept with the model, so that the tasks of one worker process share what was read."""
        if "judge" not in model:
            model["judge"] = cls(model)
        return model["judge"]

    def __init__(self, model: dict):
        self.restorer, self.table = Restorer(model["costs"]), model["evidence"]
        self.strong: dict[str, float] = {}
        self.weak: set[str] = set()

    def features(self, text: str | None) -> tuple[float, float, float]:
        words, table = self.restorer.words(text or ""), self.table
        if len(self.weak) + len(self.strong) > 500_000:
            self.weak.clear()
            self.strong.clear()
        rest, values = words - self.weak, []
        for word in rest:
            value = self.strong.get(word)
            if value is None:
                value = max([table.get(key, 0.0) for key in _keys(word)])
                if value <= 0:
                    self.weak.add(word)
                    continue
                self.strong[word] = value
            values.append(value)
        values.sort(reverse=True)
        return values[0] if values else 0.0, sum(values[:3]), float(np.log1p(len(words)))


def _sample(docs: DataFrame, labels: DataFrame, folds: int, sample: int) -> DataFrame:
    marked = labels.where(F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [marked.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for value in (0, 1)]
    return stage(docs.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "text", "label"), "labelled")  # 2 * sample rows are broadcast


def learn(docs: DataFrame, labels: DataFrame, *, folds: int = 5, sample: int = SAMPLE, terms: int = TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: character costs, evidence by word or beginning (the ``terms`` strongest), weights of the regression."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    costs = letter_costs(letter_counts(docs))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(costs)
    labelled = _sample(docs, labels, folds, sample)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, seen = Restorer(shared.value), {}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                for key in {k for w in restorer.words(text or "") for k in _keys(w)}:
                    seen.setdefault(key, [0, 0])[1 if label else 0] += 1
        keys = list(seen)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pd.DataFrame({"key": part, "clean": [seen[k][0] for k in part], "toxic": [seen[k][1] for k in part]})

    sizes = {int(r["label"] == 1): r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return {"costs": costs, "evidence": {}, "weights": None}
    keys = labelled.mapInPandas(count, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = F.col("toxic") - F.sqrt("toxic")  # a few chance occurrences prove little
    ratio = F.log((least + 0.25) / sizes[1]) - F.log((F.col("clean") + 0.5) / sizes[0])
    strong = keys.where("toxic >= 3").withColumn("evidence", ratio).where("evidence > 0.5").orderBy(F.desc("evidence"), "key").limit(terms)
    evidence = {r["key"]: r["evidence"] for r in strong.collect()}
    model = {"costs": costs, "evidence": evidence, "weights": None}
    shared_model = spark.sparkContext.broadcast(model)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Evidence.of(shared_model.value)
        for frame in frames:
            out = pd.DataFrame([judge.features(t) for t in frame["text"]], columns=["a", "b", "c"])
            out["label"] = frame["label"].to_numpy()
            yield out

    points = labelled.mapInPandas(measure, "a double, b double, c double, label int").toPandas()  # 2 * sample rows at most
    return model | {"weights": _logistic(points[["a", "b", "c"]].to_numpy(), (points["label"] == 1).to_numpy(float))}


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method, slightly shrunk; both classes weigh as in the sample."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, w = Evidence.of(shared.value), shared.value["weights"]
        for batch in chunked(batches, "text"):
            x = np.array([judge.features(t) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
            p = np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w[:3] + w[3], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
