"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample
(SAMPLE vectors, least hashed ids first); every row is then indexed: its cell and one
byte per subspace. Residuals are measured in units of their cell's own spread, so vectors that lie close
around one point are told apart as finely as those that lie far apart. A query looks into its nearest cells, takes the asymmetric distances
of its own residual to the codes there (decoded once a slice, which costs less than a distance table a query and cell), keeps the DEPTH best, and these are reranked by exact distances on the original vectors.
How many cells a query needs is measured on the sample: the least number with which ASKS of its queries have
the cells of COVER of their true neighbours, so that a dense region is not paid for by others.

Index rows are dealt into slices by the hash of their ids, so a cell with a third of all vectors is in every slice, and
each query goes to each slice once. A task holds one slice at a time (some SLICE_ROWS codes) and streams the queries
past it in blocks, handing on at most DEPTH candidates a query and slice; these are merged in groups of a counted size.

Defined results: vectors that are null, zero, of another than the prevailing length, or hold null or
non-finite components take no part, nor do rows without id; rows that repeat an id are one candidate
(the nearer one); equal distances go to the smaller id; fewer candidates give fewer ranks; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 20_000
CELLS = 4096
SUBSPACES = 32
CODES = 256
DEPTH = 64
#: Probes are such that this share of queries finds the cells of this share of its neighbours.
ASKS, COVER = 0.95, 0.9
TOP = 10
QUERY_EVERY = 100
#: Rows of a slice of the index, about, and queries that are held against a slice at once.
SLICE_ROWS, ASK_BLOCK = 1 << 18, 1024
#: Codes that meet a block of queries at once; candidates that a task gathers before it keeps the best of each query; candidates merged at once.
CODE_BLOCK, GATHERED, MERGED = 1 << 11, 1 << 18, 1 << 20


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = np.concatenate([_distances(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        counts = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(np.cumsum(counts) - counts, len(x)))
        full = counts > 0
        c[full] = sums[full] / counts[full, None]
    return c


class Quantiser:
    """Coarse centroids, residual codebooks and the number of cells to look into."""

    def __init__(self, sample: np.ndarray, rows: int):
        n, d = sample.shape
        self.coarse = k_means(sample, max(1, min(CELLS, round(math.sqrt(rows)), n // 8 or 1)))
        self.parts = next(m for m in range(min(SUBSPACES, d), 0, -1) if d % m == 0)
        near = self.nearest(sample, 1)[:, 0]
        residual = sample - self.coarse[near]
        counts = np.bincount(near, minlength=len(self.coarse))
        spread = np.sqrt(np.bincount(near, weights=(residual * residual).sum(1), minlength=len(self.coarse)) / np.maximum(counts, 1))
        usual = float(np.median(spread[spread > 0])) if (spread > 0).any() else 1.0
        self.scale = np.where((counts > 1) & (spread > 1e-9 * usual), spread, usual)
        residual = (residual / self.scale[near][:, None]).reshape(n, self.parts, -1)
        self.books = [k_means(np.ascontiguousarray(residual[:, m]), CODES, 8) for m in range(self.parts)]
        ask = sample[:: max(1, n // 256)]
        d2 = _distances(ask, sample)
        true = np.argsort(d2, axis=1, kind="stable")[:, 1 : TOP + 1]
        place = np.argsort(np.argsort(_distances(ask, self.coarse), axis=1, kind="stable"), axis=1)
        seen = np.sort(np.take_along_axis(place, near[true], 1), axis=1) if true.size else np.zeros((1, 1), np.int64)
        need = np.sort(seen[:, math.ceil(COVER * seen.shape[1]) - 1])  # cells that a query needs for so many of its neighbours
        self.probes = int(min(len(self.coarse), need[math.ceil(ASKS * len(need)) - 1] + 1))

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        d = _distances(x, self.coarse)
        if k >= d.shape[1]:
            return np.argsort(d, axis=1, kind="stable")
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        r = ((x - self.coarse[cell]) / self.scale[cell][:, None]).reshape(len(x), self.parts, -1)
        return np.stack([_distances(r[:, m], b).argmin(1) for m, b in enumerate(self.books)], 1).astype(np.uint8)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for, in units of their cell's spread."""
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)


def valid_vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    ok = F.expr("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    d = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null").where(ok)
    common = d.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    size = common["n"] if common else 0
    return d.where(F.size("v") == size), size


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


#: What is kept of a row of the index.
KEPT = ["vec_id", "cell", "code"]


def _index(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            cell = q.nearest(x, 1)[:, 0]
            codes = q.encode(x, cell)
            blobs = pa.array([c.tobytes() for c in codes], pa.binary())
            columns = [batch.column(0), pa.array(cell.astype(np.int32)), blobs]
            yield pa.RecordBatch.from_arrays(columns, KEPT)

    return run


def _runs(sorted_: np.ndarray) -> tuple[list, list, list]:
    step = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[step].tolist(), step.tolist(), np.append(step[1:], len(sorted_))[: len(step)].tolist()


def _best(ask: np.ndarray, distance: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `depth` nearest of each ask, in order; ties go to smaller ids."""
    order = np.lexsort((ids, distance, ask))
    ask, distance, ids = ask[order], distance[order], ids[order]
    _, begin = np.unique(ask, return_index=True)
    keep = np.arange(len(ask)) - np.repeat(begin, np.diff(np.append(begin, len(ask)))) < depth
    return ask[keep], distance[keep], ids[keep]


class _Gathered:
    """Candidates of the queries that a task has met, the best `depth` of each."""

    def __init__(self, depth: int):
        self.depth, self.parts, self.size = depth, [], 0
        self.edge: dict[int, float] = {}

    def add(self, asks: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        """distance: (asks, ids); what is farther than a query's depth-th nearest so far is left out."""
        edge = np.array([self.edge.get(a, np.inf) for a in asks.tolist()], distance.dtype)
        if len(ids) > self.depth:
            edge = np.minimum(edge, np.partition(distance, self.depth - 1, axis=1)[:, self.depth - 1])
        row, column = np.nonzero((distance <= edge[:, None]) & np.isfinite(distance))
        found = _best(asks[row], distance[row, column], ids[column], self.depth)
        self.parts.append(found)
        self.size += len(found[0])
        if self.size > GATHERED:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64))
        whole = _best(*(np.concatenate(x) for x in zip(none, *self.parts, strict=True)), self.depth)
        self.parts, self.size = [whole], len(whole[0])
        value, lo, hi = _runs(whole[0])
        self.edge = {a: float(whole[1][h - 1]) for a, b, h in zip(value, lo, hi, strict=True) if h - b == self.depth}
        return whole


def _slice_best(q: Quantiser, index: list[pa.RecordBatch], depth: int):
    """A function from a block of queries (ids, vectors) to their best in a slice, whose rows come in order of their cells."""
    ids, cells = (np.concatenate([np.asarray(b.column(c)) for b in index] or [np.zeros(0, np.int64)]) for c in ("vec_id", "cell"))
    codes = (np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in index)
    decoded = np.concatenate([q.decoded(c).astype(np.float32) for c in codes] or [np.zeros((0, q.coarse.shape[1]), np.float32)])
    spans = list(zip(*_runs(cells), strict=True))

    def best(asks: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        have = _Gathered(depth)
        looks = np.zeros((len(x), len(q.coarse)), bool)
        np.put_along_axis(looks, q.nearest(x, q.probes), True, 1)
        for cell, lo, hi in spans:
            who = np.flatnonzero(looks[:, cell])
            if not len(who):
                continue
            residual = ((x[who] - q.coarse[cell]) / q.scale[cell]).astype(np.float32)
            for a in range(lo, hi, CODE_BLOCK):
                own = ids[a : min(hi, a + CODE_BLOCK)]
                d = _distances(residual, decoded[a : a + len(own)]) * np.float32(q.scale[cell] ** 2)
                d[own == asks[who][:, None]] = np.inf
                have.add(asks[who], d, own)
        return have.settle()

    return best


def _meet(held, depth: int):
    """Rows in order of slice, kind and cell: a slice's index is held, and then its queries pass by."""
    schema = pa.schema([("query_id", pa.int64()), ("found", pa.binary()), ("distances", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantiser = held.value
        at, index, best = None, [], None
        for batch in batches:
            part = np.asarray(batch.column("slice")).astype(np.int64) * 2 + np.asarray(batch.column("kind"))
            for value, lo, hi in zip(*_runs(part), strict=True):
                rows = batch.slice(lo, hi - lo)
                if value // 2 != at:
                    at, index, best = value // 2, [], None
                if value % 2 == 0:
                    index.append(rows.select(KEPT))
                    continue
                if best is None:
                    best = _slice_best(q, index, depth)
                    index = []
                for a in range(0, rows.num_rows, ASK_BLOCK):
                    some = rows.slice(a, ASK_BLOCK)
                    ask, distance, ids = best(np.asarray(some.column("vec_id")), _matrix(some.column("v")))
                    value_, begin, end = _runs(ask)
                    spans = list(zip(begin, end, strict=True))
                    blobs = [[x[i:j].tobytes() for i, j in spans] for x in (ids.astype("<i8"), distance.astype("<f4"))]
                    yield pa.RecordBatch.from_arrays([pa.array(value_, pa.int64()), *[pa.array(x, pa.binary()) for x in blobs]], schema=schema)

    return run


def _merge(depth: int):
    def run(group: pa.Table) -> pa.Table:
        found, distances = group["found"].to_pylist(), group["distances"].to_pylist()
        many = [len(b) // 8 for b in found]
        ask = np.repeat(np.asarray(group["query_id"]), many)
        ask, _, ids = _best(ask, np.frombuffer(b"".join(distances), "<f4"), np.frombuffer(b"".join(found), "<i8"), depth)
        return pa.table([pa.array(ask), pa.array(ids)], names=["query_id", "vec_id"])

    return run


def search(rows: DataFrame, query_every: int = QUERY_EVERY, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by query_every, against all rows."""
    spark = rows.sparkSession
    vectors, size = valid_vectors(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if not size:
        return spark.createDataFrame([], schema)
    total = vectors.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    held = spark.sparkContext.broadcast(Quantiser(_matrix(sample["v"].combine_chunks()), total))
    index = vectors.mapInArrow(_index(held), "vec_id long, cell int, code binary")
    asked = vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    slices = max(2 * spark.sparkContext.defaultParallelism, -(-total // SLICE_ROWS))
    mine = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(0).alias("kind"), *KEPT, F.lit(None).cast("array<double>").alias("v"))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    asks = asked.select(every, F.lit(1).alias("kind"), "vec_id", F.lit(-1).alias("cell"), F.lit(None).cast("binary").alias("code"), "v")
    dealt = mine.unionByName(asks).repartition(slices, "slice").sortWithinPartitions("slice", "kind", "cell")
    met = dealt.mapInArrow(_meet(held, depth), "query_id long, found binary, distances binary")
    groups = max(8, -(-asked.count() * slices * depth // MERGED))
    near = met.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g").applyInArrow(_merge(depth), "query_id long, vec_id long")
    near = cut(near, "ann-candidates")
    pairs = near.join(vectors.select("vec_id", F.col("v").alias("x")), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _matrix(b.column(2)) - _matrix(b.column(3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt((d * d).sum(1)) if b.num_rows else np.zeros(0))], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "vec_id", "x", "q").mapInArrow(exact, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
