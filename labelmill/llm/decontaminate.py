"""Operator 2: benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. A window is ``width`` consecutive words of an item; an item with
fewer words is one window.

* Frequencies: how often each benchmark term occurs in the documents.
* Anchors: the rarest and the second rarest term of each window. Windows with a term that no document holds cannot occur.
* Index: one posting (term, document, position, the words around) for each occurrence of an anchor term, written to the shared folder.
* Intersection: postings of a window's rarest term, less its offset in the item, meet those of its second rarest, less its own: both must
  put the item at the same place (``phrase_matches``), or within ``slop`` words of it (``proximity_matches``).
* Exact match: the item's and the document's words are compared outwards from the anchor, at most ``width - 1`` words each way, so that one
  matched run stands for all windows around one anchor.

Whether the terms' table is broadcast is left to Spark, by the size of the file it was written to.

Cases: null texts have no words; items without words have no windows; equal rows of items count once, and items without an id count as hits
but not as items; rows of documents with equal id and text share their result; an empty benchmark hits nothing; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import stage

WIDTH = 13
_APART = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOC = ["doc_id", "_text_hash"]


def words_of(text: Column) -> Column:
    """The words of a text, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _APART), "")


def low(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """One row per word of each item: ``item`` (a key), ``item_id``, ``n`` words, ``at``, ``term``, and the words around: ``left`` (nearest first), ``right``."""
    items = benchmark.select("item_id", low(F.coalesce("text", F.lit(""))).alias("text")).dropDuplicates()
    items = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", words_of(F.col("text")).alias("words"))
    return items.select("item", "item_id", F.size("words").alias("n"), "words", F.posexplode("words").alias("at", "word")).select(
        "item", "item_id", "n", "at", F.lower("word").alias("term"), "word", *_around(F.col("words"), F.col("at")))


def _around(words: Column, at: Column, reach: int = WIDTH - 1) -> tuple[Column, Column]:
    start = F.greatest(at - reach, F.lit(0))
    return F.reverse(F.slice(words, start + 1, at - start)).alias("left"), F.slice(words, at + 2, reach).alias("right")


def anchors(terms: DataFrame, frequencies: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item, first, second``: offsets of the rarest and the second rarest term of each window that can occur."""
    counted = terms.select("item", "n", "at", "term").join(frequencies, "term", "left")
    starts = F.sequence(F.greatest(F.col("at") - (width - 1), F.lit(0)), F.greatest(F.least(F.col("at"), F.col("n") - width), F.lit(0)))
    windows = counted.withColumn("start", F.explode(starts)).groupBy("item", "start").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "at"))).alias("rare"))  # a window's words
    possible = windows.where(F.col("rare")[0]["often"] > 0)
    return possible.select("item", F.col("rare")[0]["at"].alias("first"), F.coalesce(F.get("rare", F.lit(1))["at"], F.col("rare")[0]["at"]).alias("second")).distinct()


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of the documents (``doc_id, text``) for the given ``term`` rows, written to the shared folder."""
    words = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), words_of(F.col("text")).alias("words"))
    found = words.select(*_DOC, "words", F.posexplode("words").alias("pos", "word")).withColumn("term", F.lower("word")).join(terms, "term")
    return stage(found.select("term", *_DOC, "pos", "word", *_around(F.col("words"), F.col("pos"))), "postings")


def _same(columns: list[str]) -> Column:
    return F.expr(" and ".join(f"a.{c} <=> b.{c}" for c in columns))


def _run(item_side: str, doc_side: str) -> Column:
    """How many words agree, going outwards."""
    same = F.zip_with(F.col(item_side), F.col(doc_side), lambda a, b: a.eqNullSafe(low(b)))
    first = F.array_position(same, False).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _placed(index: DataFrame, terms: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Postings of one anchor of each pair, with the place they give the item."""
    rows = pairs.join(terms.select("item", F.col("at").alias(side), "term"), ["item", side]).join(index, "term")
    return rows.withColumn("place", F.col("pos") - F.col(side))


def phrase_matches(index: DataFrame, terms: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, _text_hash, item_id, item, begin, end``: matched runs of words (end excluded), each all windows around one anchor."""
    one = _placed(index, terms.select("item", "at", "term"), pairs, "first").select("item", "first", *_DOC, "place", "pos", F.col("word").alias("d_word"), F.col("left").alias("d_left"), F.col("right").alias("d_right"))
    two = _placed(index.select("term", *_DOC, "pos"), terms, pairs, "second").select("item", "first", *_DOC, "place").distinct()
    keys = ["item", "first", *_DOC, "place"]
    both = one.dropDuplicates(keys).alias("a").join(two.alias("b"), _same(keys), "left_semi")
    context = terms.select("item", "item_id", "n", F.col("at").alias("first"), "word", "left", "right")
    runs = both.join(context, ["item", "first"]).where(low(F.col("d_word")) == F.col("word")).withColumn("l", _run("left", "d_left")).withColumn("r", _run("right", "d_right"))
    whole = F.when(F.col("n") >= width, F.col("l") + F.col("r") + 1 >= width).otherwise((F.col("l") == F.col("first")) & (F.col("r") == F.col("n") - 1 - F.col("first")))
    return runs.where(whole).select(*_DOC, "item_id", "item", (F.col("pos") - F.col("l")).alias("begin"), (F.col("pos") + F.col("r") + 1).alias("end"))


def proximity_matches(index: DataFrame, terms: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """``doc_id, _text_hash, item_id, item, place``: where the two rarest terms of a window put its item within ``slop`` words of each other."""
    bucket = F.floor(F.col("place") / (slop + 1)).alias("bucket")
    keys = ["item", "first", "second", *_DOC]
    one = _placed(index, terms, pairs, "first").select(*keys, "place", bucket)
    two = _placed(index, terms, pairs, "second").select(*keys, F.col("place").alias("other"), F.explode(F.array(*[F.floor(F.col("place") / (slop + 1)) + k for k in (-1, 0, 1)])).alias("bucket"))
    near = one.alias("a").join(two.alias("b"), _same([*keys, "bucket"]))
    near = near.where(F.abs(F.col("place") - F.col("other")) <= slop).select("a.item", *[f"a.{c}" for c in _DOC], "place").distinct()
    return near.join(terms.select("item", "item_id").distinct(), "item").select(*_DOC, "item_id", "item", "place")


def prepare(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The benchmark's terms, the anchors of its windows, and the documents' index for them. ``doc_id, text`` and ``item_id, text`` are read."""
    terms = stage(item_terms(benchmark), "item_terms")
    vocabulary = stage(terms.select("term").distinct(), "vocabulary")
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.lower("word").alias("term")).join(vocabulary, "term")
    frequencies = stage(seen.groupBy("term").agg(F.count("*").alias("often")), "frequencies")
    pairs = stage(anchors(terms, frequencies, width), "anchors")
    at = F.explode(F.array("first", "second")).alias("at")
    wanted = stage(pairs.select("item", at).distinct().join(terms.select("item", "at", "term"), ["item", "at"]).select("term").distinct(), "anchor_terms")
    return terms, pairs, build_index(docs, wanted)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, text_hash: bool = False) -> DataFrame:
    """Per document (with ``_text_hash``, the hash of its text, if asked for): words, words inside matched windows, items with matched windows and the digest of their ids, and whether it is contaminated
    (at least one word in twenty is hit)."""
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    terms, pairs, index = prepare(docs, benchmark, width)
    runs = stage(phrase_matches(index, terms, pairs, width).distinct(), "runs")
    before = Window.partitionBy(*_DOC).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.select(*_DOC, "begin", "end").distinct().withColumn("reached", F.max("end").over(before))
    covered = F.greatest(F.col("end") - F.greatest("begin", F.coalesce("reached", F.lit(0))), F.lit(0))
    hits = spans.groupBy(*_DOC).agg(F.sum(covered).cast("long").alias("n_hit"))
    items = runs.where("item_id is not null").select(*_DOC, F.col("item_id").cast("string").alias("item_id")).distinct()
    items = items.groupBy(*_DOC).agg(F.collect_list("item_id").alias("ids")).select(*_DOC, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("ids"), ","), 256).alias("items_sha256"))
    sized = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    found = sized.alias("a").join(hits.alias("b"), _same(_DOC), "left").select("a.*", "b.n_hit")
    found = found.alias("a").join(items.alias("b"), _same(_DOC), "left").select(*[f"a.{c}" for c in (_DOC if text_hash else _DOC[:1])], "a.n_words", F.coalesce("a.n_hit", F.lit(0)).alias("n_hit"), F.coalesce("b.n_items", F.lit(0)).alias("n_items"), F.coalesce("b.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
