"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Units are bytes; n-grams of up to ORDER bytes are exact integers. Slices of trusted text count
their n-grams first and send each history's shard one block, so that all
continuations of a history meet. From the distinct n-grams of the highest order the
lower orders take continuation counts (distinct bytes before), each by a sharded
count join on the suffix. Discounts for counts of one, two and three or more come from the
counts of counts, per order. Probabilities and back-off weights are
interpolated by joins from the lowest order up.

The model stays in sharded tables, whole. The distinct n-grams of all
texts take their probabilities from it by a join per order. Up to HELD_GRAMS of these answers are broadcast (32 MB), and texts
are scored where they are read; where there are more, documents are dealt into slices, a slice
sends each shard its distinct n-grams in one block, the shard answers with their log-probabilities,
and the answers meet the slice's texts again. Trusted documents are found by a join on their ids, however many
there are; ids are broadcast only up to TRUSTED_IDS. Perplexity is per byte. Texts longer than a slice are read in parts. A document is kept if its perplexity
lies between two quantiles of the trusted documents of its language; languages
with fewer than LEAST trusted documents use those of all trusted documents.

Defined results: null and empty texts have perplexity null and are not kept; a null lang is a language of its
own; without trusted text nothing is scored (perplexity null) and nothing kept; rows that repeat are scored
alike and train as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import bucket_count, cut

ORDER = 5
QUANTILES = (0.0005, 0.998)
LEAST = 30
SLICE = (1 << 20) - 64
#: Input bytes whose documents make one slice of the scoring, input bytes a shard of n-grams is for, n-grams a task counts before it hands them on.
SCORE_BYTES, SHARD_BYTES, HELD = 8 << 20, 24 << 20, 1 << 20
#: Answers, and ids of trusted documents, of which a broadcast is asked for; with more, tables are joined.
HELD_GRAMS, TRUSTED_IDS = 1 << 21, 1 << 21


def codes(buf: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, the integer of the `order` bytes that end there; bytes before a text's beginning are 0."""
    out = np.zeros(len(buf), np.uint64)
    into = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    wide = buf.astype(np.uint64)
    for k in range(order):
        part = np.zeros(len(buf), np.uint64)
        part[k:] = wide[: max(0, len(buf) - k)]
        part[into < k] = 0
        out |= part << np.uint64(8 * k)
    return out


def _parts(buf: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, codes, offsets) of a slice, a text of more than `size` bytes in parts that each begin with the bytes before."""
    if len(buf) <= size:
        yield 0, codes(buf, offsets), offsets
        return
    for k, (a, b) in enumerate(pairwise(offsets.tolist())):
        for lo in range(a, b, size):
            hi, before = min(b, lo + size), min(ORDER - 1, lo - a)
            own = codes(buf[lo - before : hi], np.array([0, hi - lo + before]))[before:]
            yield k, own, np.array([0, hi - lo])


def _shards(gram: np.ndarray, shards: int) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Order of the n-grams by the shard of their history, shards that have any, and the edges of these in that order."""
    shard = (T.mix(gram >> np.uint64(8)) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    full, begin = np.unique(shard[order], return_index=True)
    return order, full.tolist(), [*begin.tolist(), len(gram)]


def _added(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate(grams), return_inverse=True)
    return gram, np.bincount(at, weights=np.concatenate(counts), minlength=len(gram)).astype(np.int64)


def _count(shards: int):
    def blocks(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order, full, edges = _shards(gram, shards)
        gram, n = gram[order], n[order]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(full, np.int32)), pa.array([_pack(gram[a:b]) for a, b in pairwise(edges)], pa.binary()), pa.array([n[a:b].astype("<u4").tobytes() for a, b in pairwise(edges)], pa.binary())],
            ["shard", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for _, buf, offsets, _ in T.slices(batches, size=SLICE):
            for _, own, _ in _parts(buf, offsets):
                gram, n = np.unique(own, return_counts=True)
                grams.append(gram)
                counts.append(n)
                if sum(map(len, grams)) > HELD:
                    gram, n = _added(grams, counts)
                    grams, counts = [gram], [n]
                    if len(gram) > HELD // 2:
                        grams, counts = [], []
                        yield blocks(gram, n)
        if grams:
            yield blocks(*_added(grams, counts))

    return run


def _pack(gram: np.ndarray) -> bytes:
    return np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ORDER]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // ORDER, 8), np.uint8)
    out[:, :ORDER] = np.frombuffer(b, np.uint8).reshape(-1, ORDER)
    return out.view("<u8").ravel()


def _sum_shard(group: pa.Table) -> pa.Table:
    n = np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")
    gram, c = _added([_unpack(b"".join(group["grams"].to_pylist()))], [n])
    return pa.table([pa.array(np.full(len(gram), group["shard"][0].as_py(), np.int32)), pa.array(gram.astype(np.int64)), pa.array(c)], names=["shard", "gram", "c"])


def counted(texts: DataFrame, shards: int) -> DataFrame:
    """shard, gram, c: the distinct n-grams of the highest order."""
    return texts.select("text").mapInArrow(_count(shards), "shard int, grams binary, counts binary").groupBy("shard").applyInArrow(T.releasing(_sum_shard), "shard int, gram long, c long")


def interpolate(highest: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1 up: (gram, p, c) interpolated probabilities and (history, weight, c) back-off weights.

    highest: gram, c, distinct n-grams of the highest order with their counts.
    """
    counts = {order: highest}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct bytes before the suffix
        counts[k] = cut(counts[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count("*").alias("c")), f"kn-count-{k}")
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        of = {r["c"]: r["n"] for r in counts[k].where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
        d = discounts([of.get(i, 0) for i in (1, 2, 3, 4)])
        cut_by = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        grams = counts[k].withColumns({"history": F.shiftright("gram", 8), "d": cut_by})
        histories = grams.groupBy("history").agg(F.sum("c").alias("total"), F.sum("d").alias("mass")).withColumn("weight", F.col("mass") / F.col("total"))
        histories = cut(histories.select("history", "total", "weight"), f"kn-history-{k}")
        p = grams.join(histories, "history").withColumn("own", (F.col("c") - F.col("d")) / F.col("total"))
        if k == 1:
            p = p.withColumn("below", F.lit(1 / 256))
        else:
            below = out[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = p.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
        p = cut(p.select("gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"), "c"), f"kn-p-{k}")
        out.append((p, histories.select("history", "weight", F.col("total").alias("c"))))
    return out


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted once to four times; 0.5, 0.75, 0.9 where these are missing."""
    if min(n) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


class Model:
    """Tables per order: (gram, p) of n-grams and (history, weight) of back-off weights, whole."""

    def __init__(self, tables: list[tuple[DataFrame, DataFrame]]):
        self.tables = tables

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """The rows of grams (gram, distinct) and p. Each order is asked for distinct suffixes, so that a key meets at most 256 rows."""
        order = len(self.tables)
        asked = {order: grams}
        for k in range(order - 1, 0, -1):
            asked[k] = asked[k + 1].select(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).distinct()
        below = None
        for k, (p, h) in enumerate(self.tables, 1):
            mine = asked[k].withColumn("history", F.shiftright("gram", 8)).join(h.select("history", "weight"), "history", "left").join(p.select("gram", F.col("p").alias("known")), "gram", "left")
            if below is None:
                mine = mine.withColumn("below", F.lit(1 / 256))
            else:
                mine = mine.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "suffix")
            p = F.coalesce("known", F.coalesce("weight", F.lit(1.0)) * F.col("below"))
            below = mine.select(F.col("gram").alias("suffix"), p.alias("below")) if k < order else mine.select(*grams.columns, p.alias("p"))
        return below

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        """Of few n-grams, for a look at the model."""
        spark = self.tables[0][0].sparkSession
        got = {r["gram"]: r["p"] for r in self.probabilities(spark.createDataFrame([(g,) for g in np.unique(gram).tolist()], "gram long")).collect()}
        return np.log(np.maximum([got[g] for g in gram.tolist()], 1e-12))


def train(trusted: DataFrame, shards: int | None = None) -> Model | None:
    """trusted: text."""
    highest = cut(counted(trusted, shards or bucket_count(trusted, SHARD_BYTES)).select("gram", "c"), "kn-highest")
    if highest.limit(1).count() == 0:
        return None
    return Model(interpolate(highest))


def _distinct(group: pa.Table) -> np.ndarray:
    """Distinct n-grams of a slice's texts."""
    found = [np.unique(own) for _, buf, offsets, _ in T.slices(group.to_batches(), size=SLICE) for _, own, _ in _parts(buf, offsets)]
    return np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]))


def _scored(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, gram: np.ndarray, log_p: np.ndarray, keep: int) -> list[pa.Array]:
    """The first `keep` columns of rows, n_bytes, perplexity; gram: sorted, holds every n-gram of the texts."""
    n, total = np.diff(offsets), np.zeros(rows.num_rows)
    for at, own, edges in _parts(buf, offsets):
        value, where = np.unique(own, return_inverse=True)
        full = np.flatnonzero(np.diff(edges))
        if len(full):
            said = log_p[np.searchsorted(gram, value)][where]
            total[at + full] += np.add.reduceat(said, edges[:-1][full])
    return [*[rows.column(i) for i in range(keep)], pa.array(n), pa.array(np.exp(-total / np.maximum(n, 1)), mask=n == 0)]


def perplexities(docs: DataFrame, model: Model | None, *keep: str, held_grams: int | None = None) -> DataFrame:
    """keep columns, n_bytes, perplexity."""
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("perplexity", "double")
    names = [*keep, "n_bytes", "perplexity"]
    if model is None:
        return docs.select(*keep, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"))
    shards = bucket_count(docs, SHARD_BYTES)
    known = cut(model.probabilities(cut(counted(docs, shards).select("shard", "gram"), "kn-asked")), "kn-answers")
    inner = docs.select(*keep, "text")
    if known.count() <= (HELD_GRAMS if held_grams is None else held_grams):
        table = known.select("gram", "p").toArrow()
        order = np.argsort(np.asarray(table["gram"]))
        held = docs.sparkSession.sparkContext.broadcast((np.asarray(table["gram"])[order].astype(np.uint64), np.log(np.maximum(np.asarray(table["p"])[order], 1e-12))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
                yield pa.RecordBatch.from_arrays(_scored(rows, buf, offsets, *held.value, len(keep)), names)

        return inner.mapInArrow(run, schema)

    slices = bucket_count(docs, SCORE_BYTES)
    dealt = inner.withColumn("slice", F.pmod(F.xxhash64(*keep, "text"), F.lit(slices)).cast("int"))

    def ask(group: pa.Table) -> pa.Table:
        gram = _distinct(group)
        order, full, edges = _shards(gram, shards)
        gram = gram[order]
        return pa.table([pa.array(full, pa.int32()), pa.array([group["slice"][0].as_py()] * len(full), pa.int32()), pa.array([_pack(gram[a:b]) for a, b in pairwise(edges)], pa.binary())], names=["shard", "slice", "grams"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        gram, p = np.asarray(table["gram"]).astype(np.uint64), np.asarray(table["p"])
        order = np.argsort(gram)
        gram, log_p = gram[order], np.log(np.maximum(p[order], 1e-12))
        values = [log_p[np.searchsorted(gram, _unpack(b))].astype("<f8").tobytes() for b in asked["grams"].to_pylist()]
        return pa.table([asked["slice"], asked["grams"], pa.array(values, pa.binary())], names=["slice", "grams", "values"])

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        gram, log_p = _unpack(b"".join(answers["grams"].to_pylist())), np.frombuffer(b"".join(answers["values"].to_pylist()), "<f8")
        order = np.argsort(gram)
        gram, log_p = gram[order], log_p[order]
        out = [pa.RecordBatch.from_arrays(_scored(rows, buf, offsets, gram, log_p, len(keep)), names) for rows, buf, offsets, _ in T.slices(group.to_batches(), size=SLICE)]
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], t) for t in [*[group.schema.field(k).type for k in keep], pa.int64(), pa.float64()]], names=names)

    asked = dealt.groupBy("slice").applyInArrow(T.releasing(ask), "shard int, slice int, grams binary")
    answers = asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "slice int, grams binary, values binary")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, low, high, keep. Trusted text: the documents labelled of quality 1 (never of 0)."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    good = cut(good, "kn-trusted")
    side = F.broadcast(good) if good.count() <= TRUSTED_IDS else good
    d = docs.select("doc_id", "lang", "text")
    model = train(d.join(side, "doc_id", "left_semi"), bucket_count(d, SHARD_BYTES))
    scored = perplexities(d, model, "doc_id", "lang").join(side.withColumn("trusted", F.lit(True)), "doc_id", "left")
    scored = cut(scored.withColumn("trusted", F.coalesce("trusted", F.lit(False))), "kn-scored")
    known = scored.where("trusted and perplexity is not null")
    pick = lambda: [F.percentile_approx("perplexity", q, 10_000) for q in quantiles]
    low, high = pick()
    whole = known.agg(low.alias("low"), high.alias("high")).first()
    by_lang = known.groupBy("lang").agg(low.alias("low"), high.alias("high"), F.count("*").alias("n")).where(F.col("n") >= LEAST).select(F.col("lang").alias("of"), "low", "high")
    limits = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    limits = limits.withColumns({"low": F.coalesce("low", F.lit(whole["low"]).cast("double")), "high": F.coalesce("high", F.lit(whole["high"]).cast("double"))})
    return limits.select("doc_id", "lang", "n_bytes", "perplexity", "low", "high", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False)).alias("keep"))
