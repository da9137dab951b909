"""Operator 1: near-duplicate documents by MinHash, confirmed on full shingle sets.

A document's set is that of its distinct word 5-grams (A-Z lower-cased, words apart at white space); with fewer words, the whole sequence is
its one shingle. Documents are linked when 100 * intersection >= threshold * union.

* Signatures: one-permutation hashing. The hash range is cut into 96 bins; a bin's value is its least shingle hash, and an empty bin borrows
  from a bin drawn by its own fixed random sequence (optimal densification), so small sets keep unbiased signatures. 24 bands of 4 bins: a
  pair at a similarity of 0.85 shares no bucket with a probability of 2e-8.
* Equal sets are folded into one representative first, so that copies, however many, are never paired.
* Star edges: in each bucket, all members are compared with its least document alone. Where a bucket then still holds more than one
  component, its documents are searched again by their rarest shingles (an exact prefix filter), across components only; so no link is lost
  to the star, and pairs within a component are never made.
* Links are confirmed by the intersection of full sets (64-bit shingle hashes), and components are found by large-star / small-star rounds
  on written tables.

Cases: null or blank texts have an empty set and are linked with nothing; rows with a null id come back with a null component, not kept;
rows with the same id are one node of the graph; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import chunked, mix, stage, text_buffer, word_hashes, word_spans

SHINGLE_WORDS = 5
BINS, BAND_BINS = 96, 4
THRESHOLD = 85

_random = np.random.default_rng(1)
_WORD_FACTORS = _random.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _random.integers(1, 1 << 63, BAND_BINS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DONORS = _random.integers(0, BINS, (BINS, 2048))


def shingle_sets(batch: pa.RecordBatch, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text of the batch, the sorted distinct hashes of its shingles."""
    data, at = text_buffer(batch.column("text"))
    begins, ends, first = word_spans(data, at)
    hashes = word_hashes(data, begins, ends)
    count = len(hashes)
    rolled = np.zeros(max(count - words + 1, 0), np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _WORD_FACTORS[k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif n:
            yield mix((hashes[a:b] * _WORD_FACTORS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band, from the densified one-permutation signature of a non-empty sorted set."""
    where = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
    filled = np.zeros(BINS, bool)
    filled[where[least]] = True
    signature = np.zeros(BINS, np.uint64)
    signature[where[least]] = shingles[least]
    empty = np.flatnonzero(~filled)
    for width in (16, 256, _DONORS.shape[1]):
        if not len(empty):
            break
        donors = _DONORS[empty, :width]
        found = filled[donors]
        has = found.any(axis=1)
        signature[empty[has]] = signature[donors[has, found[has].argmax(axis=1)]]
        empty = empty[~has]
    for i in empty:  # no donor in the whole sequence: the next filled bin
        full = np.flatnonzero(filled)
        signature[i] = signature[full[np.searchsorted(full, i) % len(full)]]
    bands = signature.reshape(-1, BAND_BINS) * _BAND_FACTORS
    return mix(bands.sum(axis=1, dtype=np.uint64) + np.arange(BINS // BAND_BINS, dtype=np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """Of ``doc_id, text``: size of each document's set, a 128-bit digest of it, and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            sizes, one, two, keys, ends = [], [], [], [], [0]
            for shingles in shingle_sets(batch):
                sizes.append(len(shingles))
                one.append(mix(shingles ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64))
                two.append(mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(shingles):
                    keys.append(band_keys(shingles))
                ends.append(ends[-1] + (len(keys[-1]) if len(shingles) else 0))
            flat = np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["doc_id", "n_shingles", "h1", "h2", "keys"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """Of ``doc_id, text``: the shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            sets = list(shingle_sets(batch))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def confirmed(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The edges ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    na, nb, common = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    sized = (F.least(na, nb) * 100 >= F.greatest(na, nb) * threshold)
    return edges.join(left, "b").join(right, "a").where(sized).where(common * 100 >= (na + nb - common) * threshold).select("a", "b").distinct()


def rare_pairs(docs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs ``a, b`` of different components of ``doc, component`` that can be similar enough, none left out.

    Of a set of n, a similar one holds at least threshold * n; so both hold one of the n - ceil(threshold * n) + 1 shingles that are rarest
    in one fixed order. A shingle that leads to several components pairs the rest with its least component and with each other,
    unless too few shingles follow it in either set.
    """
    size = F.size("shingles").alias("n")
    rows = docs.join(sets, "doc").select("doc", "component", size, F.explode("shingles").alias("s"))
    rows = rows.join(rows.groupBy("s").agg(F.count("*").alias("often")), "s")
    rank = F.row_number().over(Window.partitionBy("doc").orderBy("often", "s"))
    rare = stage(rows.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).where("often > 1").select("s", "doc", "component", "n", "rank"), "rare")
    mixed = rare.groupBy("s").agg(F.min("component").alias("main"), F.max("component").alias("_most")).where("main <> _most").select("s", "main")
    rare = rare.join(mixed, "s")
    others = rare.where("component <> main").select("s", F.col("doc").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("rank").alias("rb"))
    most = F.least(F.col("n") - F.col("rank"), F.col("nb") - F.col("rb")) + 1  # in common, if this is the first shingle in common
    sized = most * (100 + threshold) >= (F.col("n") + F.col("nb")) * threshold
    return rare.join(others, "s").where("component <> cb and (component = main or doc < b)").where(sized).select(F.col("doc").alias("a"), "b").distinct()


def _measure(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node) for all nodes of the edges ``a, b``. Large-star and small-star rounds, each written to the shared folder."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    measure = _measure(now)
    while measure[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        now = stage(small, "edges")
        before, measure = measure, _measure(now)
        if measure == before:
            break
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def near_duplicates(docs: DataFrame, *, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the size of its set, its component (least document reachable) and whether it is kept (the least of its component)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stage(signatures(docs), "signatures")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    content = ["n_shingles", "h1", "h2"]
    classes = stage(signed.where(usable).groupBy(*content).agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys")), "classes")

    placed = classes.select(F.explode("keys").alias("key"), "doc")
    shared = placed.groupBy("key").agg(F.min("doc").alias("center"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    members = stage(placed.join(shared, "key"), "members")
    wanted = members.select("doc").distinct()
    sets = stage(full_sets(docs.join(wanted, F.col("doc_id") == F.col("doc"), "left_semi")), "sets")

    stars = members.where("doc <> center").select(F.col("center").alias("a"), F.col("doc").alias("b")).distinct()
    links = stage(confirmed(stars, sets, threshold), "links")
    found = stage(connected_components(links), "components")

    # Documents of buckets that the stars have not joined are searched again by their rarest shingles, across components.
    placed = members.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most"), F.count("*").alias("_n"))
    mixed = mixed.where("_least <> _most and _n > 2").select("key")
    open_docs = stage(placed.join(mixed, "key", "left_semi").select("doc", "component").distinct(), "open")
    more = stage(confirmed(rare_pairs(open_docs, sets, threshold), sets, threshold), "links")
    if not more.isEmpty():
        found = stage(connected_components(links.union(more)), "components")

    named = classes.join(found, F.col("doc") == F.col("node"), "left").select(*content, F.coalesce("component", "doc").alias("component_id"))
    linked = signed.where(usable).join(named, content).select("doc_id", "n_shingles", "component_id")
    alone = signed.where(~usable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
