"""Operator 4: language of whole texts by prediction with partial matching.

For each language, Spark counts every byte (A-Z lower-cased) after the ``order`` bytes before, over all training rows. From these counts comes the
language's context tree, a suffix trie: a context of one to ``order`` bytes is a node if it makes up at least one in ``share`` of the
language's bytes (``share=None`` keeps all contexts). A byte seen in a node costs -log2(n / (total + distinct)); one not seen costs the escape,
-log2(distinct / (total + distinct)), and then what it costs in the next shorter context, down to 1/256. These statistics are frozen into a
table of costs for each language, so the model grows in proportion to the languages; a text's code length in a language is the sum over its
bytes, and the shortest code wins.

``score`` is the winner's share of the posterior under equal priors. Training rows are those with a text, a language and an id whose crc32
leaves no 0 modulo ``folds``.

Texts are coded in slices of ``SLICE`` bytes, whatever their length, and only they are sent to Python workers; other columns stay where they are.

Cases: null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned; a null id is never learned
from and counts as held out; equal costs go to the first language in order; repeated rows count as often as they come; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.common import LOWER, chunked, fold, stage, text_buffer

ORDER, MOST = 3, 6
SHARE = 4096
UNDETERMINED = "und"
SLICE = 1 << 17
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123)]] = 1


def _before(data: np.ndarray, at: np.ndarray, back: int) -> np.ndarray:
    """For each byte, the one ``back`` places before it in its text; zeros stand before a text."""
    out = np.zeros(len(data), np.uint8)
    out[back:] = data[:-back] if back < len(data) else 0
    for k in range(back):
        out[at[at + k < len(data)] + k] = 0
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def byte_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Of ``text, lang``: how often each byte comes after each ``order`` bytes, by language. The nearest byte is the lowest of ``gram >> 8``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in chunked(batches, "text", 4 * SLICE):
            data, at = text_buffer(batch.column("text"))
            data = LOWER[data]
            gram = data.astype(np.int64)
            for back in range(1, order + 1):
                gram |= _before(data, at[:-1], back).astype(np.int64) << 8 * back
            langs = np.array(batch.column("lang").to_pylist(), object)
            sizes = np.diff(at)
            for lang in set(langs.tolist()):
                found = parts.setdefault(lang, [])
                found.append(np.unique(gram[np.repeat(langs == lang, sizes)], return_counts=True))
                if len(found) > 16:
                    parts[lang] = [_merge(found)]
        for lang, found in parts.items():
            keys, counts = _merge(found)
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[i : i + 50_000])], ["lang", "gram", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def context_tree(k: np.ndarray, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """A language's tree from its counts: ``child`` (node by byte before the context, 0 for none) and ``cost`` (bits by next byte), flat."""
    nodes, place = np.unique(np.stack([k, context], axis=1), axis=0, return_inverse=True)
    counts = np.zeros((len(nodes), 256))
    counts[place.reshape(-1), byte] = n
    total, distinct = counts.sum(axis=1), (counts > 0).sum(axis=1)
    whole = (total + distinct)[:, None]
    chance = np.where(counts > 0, counts / whole, distinct[:, None] / whole)
    child = np.zeros((len(nodes), 256), np.int32)
    number = {}
    for i, (order, here) in enumerate(nodes.tolist()):  # shorter contexts come first
        number[order, here] = i
        shorter = 1 / 256
        if order:
            parent = number[order - 1, here & (1 << 8 * (order - 1)) - 1]
            child[parent, here >> 8 * (order - 1)] = i
            shorter = chance[parent]
        chance[i] *= np.where(counts[i] > 0, 1.0, shorter)
    child = child.astype(np.uint16) if len(nodes) < 1 << 16 else child
    return {"child": child.reshape(-1), "cost": -np.log2(np.maximum(chance, 1e-30)).reshape(-1).astype(np.float32)}


def learn(docs: DataFrame, *, folds: int = 5, order: int = ORDER, share: int | None = SHARE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The frozen model: the languages and the context tree of each."""
    if not 1 <= order <= MOST:
        raise ValueError(f"order must be between 1 and {MOST}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != 0))
    grams = stage(byte_grams(rows, order), "byte_grams")
    levels = [F.struct(F.lit(k).alias("k"), F.shiftright("gram", 8).bitwiseAND((1 << 8 * k) - 1).alias("context")) for k in range(order + 1)]
    seen = grams.select("lang", F.explode(F.array(*levels)).alias("c"), F.col("gram").bitwiseAND(255).alias("byte"), "n")
    seen = stage(seen.groupBy("lang", "c.k", "c.context", "byte").agg(F.sum("n").alias("n")), "contexts")
    if share:
        totals = seen.where("k = 0").groupBy("lang").agg(F.sum("n").alias("all"))
        kept = seen.groupBy("lang", "k", "context").agg(F.sum("n").alias("m")).join(totals, "lang").where(F.col("m") * share >= F.col("all")).select("lang", "k", "context")
        seen = seen.join(kept, ["lang", "k", "context"])
    table = seen.toPandas()  # bounded: at most order * share contexts for each language, times bytes
    trees = {lang: context_tree(*(part[c].to_numpy(np.int64) for c in ("k", "context", "byte", "n"))) for lang, part in table.groupby("lang")}
    langs = sorted(trees)
    return {"langs": langs, "order": order, "trees": [trees[x] for x in langs]}


def code_lengths(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each text takes in each language, and whether it has a letter."""
    data, at = text_buffer(texts)
    bits = np.zeros((len(texts), len(model["langs"])))
    letters = np.zeros(len(texts), bool)
    full = np.flatnonzero(np.diff(at) > 0)
    begins = at[full]
    if not len(full):
        return bits, letters
    letters[full] = np.maximum.reduceat(_LETTERS[data], begins) > 0
    for i in full[~letters[full]]:
        letters[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    order = model["order"]
    for low in range(0, len(data), SLICE):
        high, lead = min(low + SLICE, len(data)), min(order, low)
        part = LOWER[data[low - lead : high]]
        first, last = np.searchsorted(begins, low, "right") - 1, np.searchsorted(begins, high)
        starts = begins[(begins >= low - lead) & (begins < high)] - (low - lead)
        before = [_before(part, starts, back)[lead:].astype(np.int32) for back in range(1, order + 1)]
        byte = part[lead:].astype(np.int32)
        cuts = np.maximum(begins[first:last] - low, 0)
        for k, tree in enumerate(model["trees"]):
            node, alive = np.zeros(len(byte), np.int32), np.ones(len(byte), bool)
            for b in before:
                longer = tree["child"][(node << 8) + b]
                alive &= longer > 0
                np.copyto(node, longer, where=alive)
            bits[full[first:last], k] += np.add.reduceat(tree["cost"][(node << 8) + byte].astype(np.float64), cuts)
    return bits, letters


def language_of(text: Column, model: dict, spark: SparkSession) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text. Each text is judged once: filters on the result do not move below it."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = np.array([*model["langs"], UNDETERMINED], object)
        for texts in batches:
            pred, score = [np.zeros(0, object)], [np.zeros(0)]
            for batch in chunked([pa.RecordBatch.from_arrays([texts], ["text"])], "text", 4 * SLICE):
                bits, letters = code_lengths(batch.column("text"), model)
                if bits.shape[1]:
                    gap = bits - bits.min(axis=1, keepdims=True)
                    pred.append(names[np.where(letters, bits.argmin(axis=1), -1)])
                    score.append(np.where(letters, 1 / np.exp2(np.maximum(-gap, -1000)).sum(axis=1), 0.0))
                else:
                    pred.append(np.full(len(letters), UNDETERMINED, object))
                    score.append(np.zeros(len(letters)))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(pred).tolist(), pa.string()), pa.array(np.concatenate(score))], ["lang_pred", "score"])

    judge = F.arrow_udf(run, "lang_pred string, score double")
    return judge.asNondeterministic()(text)


def identify(docs: DataFrame, model: dict, *, text_col: str = "text") -> DataFrame:
    """All columns, with ``lang_pred`` and ``score`` added (columns of these names are replaced)."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(*kept, language_of(F.col(f"`{text_col}`"), model, docs.sparkSession).alias("_judged"))
    return judged.select(*kept, "_judged.lang_pred", "_judged.score")
