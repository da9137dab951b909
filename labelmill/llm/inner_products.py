"""Operator 7: exact top-k by inner product, norm-sorted.

Components become floor(scale * x). Vectors are dealt out by descending length into packed blocks. Queries, in blocks too, first meet the
longest blocks, which give each a score that its k-th best cannot fall below; then all other blocks.

Many queries meet a block at once, in one product of single-precision matrices. Both are rotated by the eigenvectors of the Gram matrix (the right
singular vectors), whose first coordinates hold most of the length. Blocks come by descending length: a query leaves once query length times
vector length falls below its k-th best score. A pair is left when the product does, or, where a sample of the queries says that this is
cheaper, the product of the leading coordinates plus the product of the lengths of the rests (Cauchy-Schwarz). What remains is scored in
whole numbers. Bounds are widened by the rounding of the products, so no pair is left out wrongly.

A task takes some of the queries (a slab, of bounded size) and some of the blocks (a group). Slabs are copied to all groups and blocks to all
slabs, in one shuffle; no table is broadcast, and no pair of rows is made before scoring.

Cases: vectors that are null, or hold nulls or non-finite components, take no part; nor do rows without an id. Equal rows count once. Vectors
are compared with those of their own dimension. Equal scores go to the smaller id. With fewer than k candidates, all are returned. Other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import stage

BLOCK_ROWS = 4096
#: Queries and vectors of one product of matrices: its result stays in the cache.
TILE_ROWS, STEP_ROWS = 512, 2048
#: Bytes of a slab of queries in single precision.
SLAB_BYTES = 1 << 26
#: One in so many blocks, the longest, are met first.
FIRST_SHARE = 8
_PENDING = 1 << 19
_BLOCK = "dim int, longest double, n int, ids binary, matrix binary"
_HITS = "query_id long, vec_id long, score long"
_HIT_FIELDS = pa.schema([(c, pa.int64()) for c in ("query_id", "vec_id", "score")])


def whole_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v, dim, norm2`` of all vectors that take part, with whole components."""
    x = F.col(f"`{vector_col}`")
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))
    rows = rows.dropDuplicates(["vec_id", "v"])
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")).alias("norm2"))


def _block(ids: np.ndarray, x: np.ndarray, norm2: float) -> pa.RecordBatch:
    """One row of packed vectors, in the narrowest whole numbers that hold them."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            x = x.astype(kind)
            break
    values = [pa.array([x.shape[1]], pa.int32()), pa.array([float(np.sqrt(norm2))]), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, ["dim", "longest", "n", "ids", "matrix"])


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """The rows of each partition, in their order, as blocks of one dimension. ``no`` numbers them, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, float]] = []
        count = 0

        def block() -> pa.RecordBatch:
            return _block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), max(h[2] for h in held))

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, norm2 = batch.column("vec_id").to_numpy(), batch.column("norm2").to_numpy()
            lists = batch.column("v")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(at)
            edges = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(ids)]
            for begin, last in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0][1].shape[1] != dims[begin]:
                    yield block()
                    held, count = [], 0
                while begin < last:
                    end = min(last, begin + most - count)
                    # Copies: the batch's memory is given back.
                    held.append((ids[begin:end].astype(np.int64), flat[at[begin] : at[end]].reshape(end - begin, int(dims[begin])).copy(), float(norm2[begin:end].max())))
                    count += end - begin
                    if count == most:
                        yield block()
                        held, count = [], 0
                    begin = end
        if held:
            yield block()

    return rows.select("vec_id", "v", "norm2").mapInArrow(run, _BLOCK).withColumn("no", F.monotonically_increasing_id())


def _matrix(data: bytes, n: int, dim: int) -> np.ndarray:
    width = len(data) // (n * dim) if n * dim else 2
    return np.frombuffer(data, {2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(n, dim)


def rotations(blocks: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the eigenvectors of the vectors' Gram matrix, largest first. Summed in Spark, entry by entry."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for b in frame.itertuples():
                x = _matrix(b.matrix, b.n, b.dim).astype(np.float64)
                sums[b.dim] = sums.get(b.dim, 0) + x.T @ x
        for dim, gram in sums.items():
            i, j = np.indices(gram.shape).reshape(2, -1)
            yield pd.DataFrame({"dim": np.int32(dim), "i": i.astype(np.int32), "j": j.astype(np.int32), "g": gram.ravel()})

    entries = blocks.mapInPandas(run, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).toPandas()
    out = {}
    for dim, part in entries.groupby("dim"):
        gram = np.zeros((dim, dim))
        gram[part["i"], part["j"]] = part["g"]
        out[int(dim)] = np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy() if np.isfinite(gram).all() else np.eye(dim)
    return out


def _best_first(at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order by query, descending score and id: one sort by query and score where both fit a number, then one of the equal ones alone."""
    most, least = int(scores.max()), int(scores.min())
    if (int(at.max()) + 1) * (most - least + 1) >= 2**63:
        return np.lexsort((ids, ~scores, at))  # ~s falls as s rises, for all whole numbers
    key = at * (most - least + 1) + (most - scores)
    order = np.argsort(key)
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    tied = np.flatnonzero(same[1:] | same[:-1])
    order[tied] = order[tied][np.lexsort((ids[order[tied]], key[tied]))]
    return order


class Best:
    """The k best vectors of each query so far: the highest scores, ties to smaller ids. None under a query's floor need to be kept."""

    def __init__(self, query_ids: np.ndarray, floors: np.ndarray, k: int) -> None:
        n = len(query_ids)
        self.k, self.query_ids, self.floors = k, query_ids, floors
        self.scores, self.ids, self.have = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def least(self) -> np.ndarray:
        """What a score must reach to be among the best."""
        return np.maximum(self.floors, np.where(self.have == self.k, self.scores[:, -1], -np.inf))

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries at these places with vectors; they count from the next ``settle`` on."""
        kth, kth_id, floors = self.scores[at, -1], self.ids[at, -1], self.floors[at]
        better = (self.have[at] < self.k) | (scores > kth) | ((scores == kth) & (ids < kth_id))
        good = np.flatnonzero(better & (ids != self.query_ids[at]) & ((scores >= floors) | (np.abs(floors) >= 2.0**53)))
        if len(good):
            self.waiting.append((at[good], ids[good], scores[good]))
            self.n_waiting += len(good)
            if self.n_waiting >= _PENDING:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        at, ids, scores = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        old = np.unique(at)
        row, place = np.nonzero(np.arange(self.k) < self.have[old, None])
        old = old[row]
        at, ids, scores = np.concatenate([at, old]), np.concatenate([ids, self.ids[old, place]]), np.concatenate([scores, self.scores[old, place]])
        order = _best_first(at, scores, ids)
        at, ids, scores = at[order], ids[order], scores[order]
        begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        place = np.arange(len(at)) - np.repeat(begins, np.diff([*begins, len(at)]))
        stay = place < self.k
        at, place = at[stay], place[stay]
        self.ids[at, place], self.scores[at, place] = ids[stay], scores[stay]
        np.maximum.at(self.have, at, place + 1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, vector ids and scores."""
        self.settle()
        row, place = np.nonzero(np.arange(self.k) < self.have[:, None])
        return self.query_ids[row], self.ids[row, place], self.scores[row, place]


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, safe: bool) -> np.ndarray:
    """The products of these pairs of rows. ``safe``: no sum can pass 2**53."""
    out, some, kind = np.empty(len(i), np.int64), max(1, (1 << 21) // max(1, q.shape[1])), np.float64 if safe else np.int64
    for begin in range(0, len(i), some):
        part = slice(begin, begin + some)
        out[part] = np.einsum("ij,ij->i", q[i[part]].astype(kind), x[j[part]].astype(kind))
    return out


def _largest(x: np.ndarray) -> float:
    return float(max(int(x.max()), -int(x.min()))) if x.size else 0.0


def _turned(x: np.ndarray, rotation: np.ndarray, kind: type) -> np.ndarray:
    out = np.empty(x.shape, kind)
    for begin in range(0, len(x), BLOCK_ROWS):
        out[begin : begin + BLOCK_ROWS] = x[begin : begin + BLOCK_ROWS].astype(np.float64) @ rotation
    return out


def _rests(x: np.ndarray, head: int) -> np.ndarray:
    """The lengths of the rows without their first coordinates."""
    return np.sqrt(np.einsum("ij,ij->i", x[:, head:], x[:, head:], dtype=np.float64))


def _with_rest(x: np.ndarray, rests: np.ndarray, head: int) -> np.ndarray:
    """Rows whose products are upper bounds of the products of ``x``: the first coordinates and the length of the rest."""
    return x if head >= x.shape[1] else np.concatenate([x[:, :head], rests[:, None].astype(x.dtype)], axis=1)


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true; eight cells are looked at together, as few are."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    near = np.concatenate([(eights[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return np.divmod(near[flat[near]], mask.shape[1])


def search(query_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, blocks: Iterable[tuple[np.ndarray, np.ndarray]], rotation: np.ndarray, k: int) -> Best:
    """The best of each query in blocks (ids and vectors) that come, as their rows do, by descending length. ``floors``: what is lower is not asked for."""
    best, dim, seen = Best(query_ids, floors, k), q.shape[1], 0
    heads = sorted({max(1, dim * i // 4) for i in (1, 2, 3)} - {dim}) if dim else []
    lengths, q_most = _rests(_turned(q, rotation, np.float64), 0), _largest(q)
    turned: dict[type, tuple[np.ndarray, dict[int, np.ndarray]]] = {}
    room: dict[type, np.ndarray] = {}  # for products, so that none asks for memory of its own
    for ids, x in blocks:
        safe = q_most * _largest(x) * max(dim, 1) < 2**53
        kind, error = (np.float32, (dim + 8) * 2.0**-23) if safe else (np.float64, 1e-9)
        if kind not in turned:
            qr = _turned(q, rotation, kind)
            turned[kind] = qr, {h: _rests(qr, h) for h in heads} | {dim: np.zeros(len(q))}
            room[kind] = np.empty(TILE_ROWS * STEP_ROWS, kind)
        qr, q_rests = turned[kind]
        xr = _turned(x, rotation, kind)
        norms = _rests(_turned(x, rotation, np.float64), 0)
        slack = error * lengths * norms.max() + 1e-6

        def bars(least: np.ndarray) -> np.ndarray:
            return np.nextafter((least - slack).astype(kind), kind(-np.inf))  # noqa: B023

        head, least, begin = 0, best.least(), 0
        while begin < len(ids):
            part = slice(begin, begin + min(STEP_ROWS, max(32, seen)))
            asked = np.flatnonzero(lengths * norms[part].max() + slack >= least)
            if not len(asked):
                if not begin:
                    best.settle()
                    return best
                break
            bar = bars(least)
            if not head and np.isneginf(least).any():
                use = dim
            else:
                head = head or _cheapest_head(qr, q_rests, xr, bar, asked, heads)
                use = head
            across = np.ascontiguousarray(_with_rest(xr[part], _rests(xr[part], use), use).T)
            for tile in range(0, len(asked), TILE_ROWS):
                at = asked[tile : tile + TILE_ROWS]
                products = room[kind][: len(at) * across.shape[1]].reshape(len(at), -1)
                np.matmul(_with_rest(qr[at], q_rests[use][at], use), across, out=products)
                rows = np.flatnonzero(products.max(axis=1) >= bar[at])
                if not len(rows):
                    continue
                i, j = _places((products if len(rows) == len(at) else products[rows]) >= bar[at[rows], None])
                if len(i) * 16 > products.size:  # many remain: all at once
                    whole = (q[at].astype(np.float64) @ x[part].astype(np.float64).T).astype(np.int64) if safe else q[at].astype(np.int64) @ x[part].astype(np.int64).T
                    best.add(at[rows[i]], ids[part][j], whole[rows[i], j])
                else:
                    best.add(at[rows[i]], ids[part][j], _scores(q, x[part], at[rows[i]], j, safe))
            begin += len(ids[part])
            seen += len(ids[part])
            if begin >= len(ids) or best.n_waiting * 4 > len(q):
                best.settle()
                least = best.least()
    best.settle()
    return best


def _cheapest_head(qr: np.ndarray, q_rests: dict[int, np.ndarray], xr: np.ndarray, bar: np.ndarray, asked: np.ndarray, heads: list[int]) -> int:
    """How many leading coordinates to multiply first, by a sample of the queries: a coordinate costs 1, a pair that is left to be scored 5,000."""
    some = asked[:: max(1, min(len(asked) // 32, 64))]
    costs = {qr.shape[1]: float(qr.shape[1])}
    for head in heads:
        bound = _with_rest(qr[some], q_rests[head][some], head) @ _with_rest(xr, _rests(xr, head), head).T
        costs[head] = head + 1 + 5000 * float((bound >= bar[some, None]).mean())
    return min(costs, key=lambda h: (costs[h], h))


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector that ``is_query`` (a condition on ``vec_id``) picks, the k others of highest score."""
    spark = vectors.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(whole_vectors(vectors, scale, id_col, vector_col), "vectors")
    longest_first = rows.repartitionByRange(tasks, F.col("dim"), F.col("norm2").desc(), "vec_id").sortWithinPartitions("dim", F.col("norm2").desc(), "vec_id")
    blocks = stage(_packed(longest_first, BLOCK_ROWS), "blocks")
    asked = rows.where(is_query).repartitionByRange(F.col("dim"), "vec_id").sortWithinPartitions("dim", "vec_id")
    queries = stage(_packed(asked, BLOCK_ROWS), "queries")
    shared = spark.sparkContext.broadcast(rotations(blocks))  # dim * dim numbers for each dimension
    cell_of = F.shiftright("no", 33), F.col("no").bitwiseAND((1 << 33) - 1)

    def size(of: DataFrame) -> tuple[int, int, int, int]:
        """Blocks, numbers in them, partitions and rows."""
        r = of.agg(F.count("*"), F.sum(F.col("n").cast("long") * F.greatest("dim", F.lit(1))), F.countDistinct(cell_of[0])).first()
        return r[0], r[1] or 0, max(1, r[2])

    n_queries, query_numbers, query_parts = size(queries)
    slabs = max(1, -(-4 * query_numbers // SLAB_BYTES))

    def place(n: int, parts: int) -> Column:
        """About the number of a block among all, by its partition and its place there."""
        return cell_of[0] * (-(-n // parts)) + cell_of[1]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {c: batch.column(c)[i] for c in batch.schema.names}

        def numbers(of: pa.Scalar, kind: type) -> np.ndarray:
            return np.frombuffer(of.as_buffer(), kind)

        def packed(p: dict) -> tuple[np.ndarray, np.ndarray]:
            return numbers(p["ids"], np.int64), _matrix(p["matrix"].as_buffer(), p["n"].as_py(), p["dim"].as_py())

        for dim, same in groupby(parts(), key=lambda p: p["dim"].as_py()):
            asked, blocks = [], iter(())
            for is_block, some in groupby(same, key=lambda p: p["is_block"].as_py()):
                if is_block:
                    blocks = some
                    break
                asked = [(*packed(p), numbers(p["floors"], np.float64) if p["floors"].is_valid else np.full(p["n"].as_py(), -np.inf)) for p in some]
            if not asked:
                continue
            query_ids, q, floors = (np.concatenate(x) for x in zip(*asked, strict=True))
            asked = []
            rotation = shared.value.get(dim, np.eye(dim))
            hits = search(query_ids, q, floors, (packed(p) for p in blocks), rotation, k).hits()
            for begin in range(0, len(hits[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[begin : begin + 100_000]) for h in hits], schema=_HIT_FIELDS)

    def met(left: DataFrame, asked: DataFrame) -> DataFrame:
        """The hits of all queries in these blocks, at most k of each query in each group of blocks."""
        n, amount, parts = size(left)
        # As many groups as make the copies of queries no larger than those of blocks.
        groups = max(1, min(n, -(-tasks // slabs), max(8, slabs * amount // max(1, query_numbers))))
        columns = ["dim", "is_block", "longest", "n", "ids", "matrix", "floors"]
        right = asked.withColumns({"is_block": F.lit(0), "g": F.explode(F.expr(f"sequence(0L, {groups - 1}L)"))})
        right = right.select(*columns, (F.pmod(place(n_queries, query_parts), F.lit(slabs)) * groups + F.col("g")).cast("int").alias("cell"))
        left = left.withColumns({"is_block": F.lit(1), "floors": F.lit(None).cast("binary"), "s": F.explode(F.expr(f"sequence(0L, {slabs - 1}L)"))})
        left = left.select(*columns, (F.col("s") * groups + F.pmod(place(n, parts), F.lit(groups))).cast("int").alias("cell"))
        cells = right.unionByName(left).repartitionById(slabs * groups, F.col("cell")).sortWithinPartitions("dim", "is_block", F.desc("longest"))
        return cells.select(*columns).mapInArrow(found, _HITS)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cuts = blocks.groupBy("dim").agg(F.percentile_approx("longest", 1 - 1 / FIRST_SHARE, 10_000).alias("cut")).collect()
    is_first = F.lit(False)
    for r in cuts:
        is_first = is_first | ((F.col("dim") == r["dim"]) & (F.col("longest") >= r["cut"]))
    none = F.lit(None).cast("binary").alias("floors")
    first = stage(met(blocks.where(is_first), queries.withColumn("floors", none)), "first")
    seeds = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", "score")

    def floored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples():
                ids, known = np.frombuffer(b.ids, np.int64), dict(b.known)
                floors = np.array([known.get(int(i), -np.inf) for i in ids], np.float64)
                yield pd.DataFrame([(b.dim, b.longest, b.n, b.ids, b.matrix, b.no, floors.tobytes())], columns=["dim", "longest", "n", "ids", "matrix", "no", "floors"])

    # Each block of queries gets back its own floors, as many as it has queries at most.
    numbered = queries.select("no", "n", "ids").mapInPandas(lambda frames: (pd.DataFrame({"no": np.repeat(np.int64(b.no), b.n), "query_id": np.frombuffer(b.ids, np.int64)}) for f in frames for b in f.itertuples()), "no long, query_id long")
    known = numbered.join(seeds, "query_id").groupBy("no").agg(F.map_from_entries(F.collect_set(F.struct("query_id", F.col("score").cast("double")))).alias("known"))
    ready = queries.join(known, "no", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<long,double>"))).select("dim", "longest", "n", "ids", "matrix", "no", "known")
    ready = stage(ready.mapInPandas(floored, _BLOCK + ", no long, floors binary"), "queries")
    hits = first.unionByName(met(blocks.where(~is_first), ready))
    best = hits.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
