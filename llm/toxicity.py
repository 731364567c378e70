"""Toxicity by class-conditional Kneser-Ney models.

A word is read as a chain of expressions: its prefixes of 4, 5, 6 and 7 bytes, as far as it is longer, and the word itself. The
history of an expression is the one before it, so an inflected form nobody labelled still meets its stem. Counts are Kneser-Ney
counts: not tokens but distinct contexts, here the documents of the class that hold the expression. Of an expression x
with history h, with N_c(x) such documents of class c, H_c(h) the sum over all expressions of that history and T_c(h) their number,

    P_c(x | h) = (max(N_c(x) - D, 0) + (D * T_c(h) + K) * P_shared(x | h)) / (H_c(h) + K)

interpolates with the shared backoff counts of both classes, P_shared(x | h) = N(x) / H(h). What the classes' own counts say
is trusted as far as they tell the classes apart: with the likelihood ratio L of two rates against one and odds of
e ** (-PRIOR / 2) before any count, the weight is w = L / (L + e ** (PRIOR / 2)), and each model uses
w * P_c + (1 - w) * P_shared. So rare expressions take the shared backoff, smoothly and whatever the size of the corpus; weights
under LEAST_WEIGHT are 0, in which case an expression says nothing and need not be stored.

log P_toxic(text) - log P_ordinary(text), normalised by length, is what is compared. A logistic
curve over the normalised differences (by n, by the root of n) gives the score;
it is fitted on training documents with their own counts left out (a document
counts once per expression, so leaving it out is subtracting one).

All labelled documents are counted, by slices that send each bucket one block of packed counts. Histories are summed and joined
as tables; those of many expressions are joined apart, so that none is one task's. Expressions that say something are the model.
Up to HELD_ROWS of them are broadcast (16 MB); a larger model stays in its table: slices of documents ask its shards
for their expressions. Only the curve of four weights is fitted on a bounded sample, the CURVE_ROWS labelled documents of least hash.

Defined results: null and empty texts have the score of a text without expressions; null labels and ids whose labels
disagree do not train; without both classes every score is 0; rows that repeat are scored
alike; labels, lang, source and ids never enter a score; texts longer than a slice are read in parts;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import bucket_count, cut, small
from .ngram_join import pack48, unpack48

PREFIXES = (4, 5, 6, 7)
DISCOUNT, SHARED, PRIOR, LEAST_WEIGHT = 0.75, 1.0, 15.0, 0.01
#: Labelled documents that the logistic curve is fitted on.
CURVE_ROWS = 1 << 15
#: Labels of which a broadcast is asked for, expressions of a model that is broadcast, expressions that make a history's join one apart.
LABEL_ROWS, HELD_ROWS, HOT_HISTORY = 1 << 21, 1 << 20, 1 << 12
CUTOFF = 0.7
SLICE = (2 << 20) - 64
#: Input bytes of one slice of documents that asks a model in shards.
ASK_BYTES = 6 << 20
ROOT = np.uint64(0)


class Expressions:
    """Distinct words of a slice and their chains.

    word: index of each word among the distinct ones; chain: (expression, history, which words have it) of each level, by distinct
    word, shortest first; 48-bit fingerprints, lower-cased, tagged by level.
    """

    def __init__(self, words: T.Words):
        total = words.sums(lower=True)
        whole = T.span_hashes(total, words.start, words.end) >> np.uint64(16)
        value, first, self.word = np.unique(whole, return_index=True, return_inverse=True)
        start, size = words.start[first], (words.end - words.start)[first]
        self.chain: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        history = np.full(len(value), ROOT)
        for k in PREFIXES:
            has = size > k
            item = T.mix(T.span_hashes(total, start, start + np.minimum(k, size)) ^ np.uint64(k)) >> np.uint64(16)
            self.chain.append((item, history, has))
            history = np.where(has, item, history)
        self.chain.append((value, history, np.ones(len(value), bool)))


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
            toxic = T.ints(rows.column(rows.schema.get_field_index("toxic"))) == 1
            # Pairs of text and expression count once, also where a long text is read in parts.
            seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for at, _, part, edges in T.pieces(buf, offsets, T.ALNUM_CLASS, SLICE):
                words = T.Words(part, edges, T.ALNUM_CLASS)
                x = Expressions(words)
                pair = np.unique(x.word * rows.num_rows + words.doc + at)
                word, doc = pair // rows.num_rows, pair % rows.num_rows
                for item, history, has in x.chain:
                    mine = has[word]
                    seen.append((item[word[mine]], history[word[mine]], doc[mine]))
            item, history, doc = (np.concatenate([s[i] for s in seen]) for i in range(3))
            if not len(item):
                continue
            value, first, at = np.unique(item, return_index=True, return_inverse=True)
            pair = np.unique(at * rows.num_rows + doc)
            at, label = pair // rows.num_rows, toxic[pair % rows.num_rows]
            n = np.stack([np.bincount(at, weights=label == c, minlength=len(value)) for c in (False, True)], 1).astype("<u4")
            history = history[first]
            bucket = _bucket(value, buckets)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))  # values are in order, and so are their buckets
            full = np.flatnonzero(np.diff(ends)).tolist()
            spans = [(ends[f], ends[f + 1]) for f in full]
            columns = [
                pa.array(full, pa.int32()),
                pa.array([pack48(value[a:b]) for a, b in spans], pa.binary()),
                pa.array([pack48(history[a:b]) for a, b in spans], pa.binary()),
                pa.array([_narrow(n[a:b]) for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "items", "histories", "counts"])

    return run


def _bucket(item: np.ndarray, buckets: int) -> np.ndarray:
    return ((item >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _narrow(n: np.ndarray) -> bytes:
    """Counts as one byte each where they fit: 255 marks those that follow whole."""
    small = np.minimum(n, 255).astype(np.uint8).ravel()
    return small.tobytes() + n.ravel()[small == 255].astype("<u4").tobytes()


def _widen(b: bytes, items: int) -> np.ndarray:
    n = np.frombuffer(b, np.uint8, 2 * items).astype(np.int64)
    n[n == 255] = np.frombuffer(b, "<u4", offset=2 * items)
    return n.reshape(-1, 2)


def _add_up(group: pa.Table) -> pa.Table:
    blobs = group["items"].to_pylist()
    item, history = unpack48(b"".join(blobs)), unpack48(b"".join(group["histories"].to_pylist()))
    n = np.concatenate([_widen(c, len(b) // 6) for b, c in zip(blobs, group["counts"].to_pylist(), strict=True)])
    value, first, at = np.unique(item, return_index=True, return_inverse=True)
    sums = [pa.array(np.bincount(at, weights=n[:, c], minlength=len(value)).astype(np.int64)) for c in (0, 1)]
    return pa.table([pa.array(value.astype(np.int64)), pa.array(history[first].astype(np.int64)), *sums], names=["item", "history", "n0", "n1"])


def log_ratio(n: np.ndarray, h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log P_toxic(x | h) - log P_ordinary(x | h); columns of n, h, t: counts of the expression, sums and numbers of its history, by class."""
    n, h, t = (np.asarray(x, float) for x in (n, h, t))
    both, whole = n.sum(1), h.sum(1)
    known = (both > 0) & (whole > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.where(known, both / whole, 1.0)
        expected = both[:, None] * h / whole[:, None]
        own = np.where(n > 0, n * np.log(n / expected), 0.0) + np.where(h > n, (h - n) * np.log((h - n) / (h - expected)), 0.0)
        told = np.where(known & (h.min(1) > 0), 2 * own.sum(1), 0.0)
        weight = 1 / (1 + np.exp(np.clip((PRIOR - told) / 2, -60, 60)))
        weight = np.where(known & (weight >= LEAST_WEIGHT), weight, 0.0)
        mine = (np.maximum(n - DISCOUNT, 0) + (DISCOUNT * t + SHARED) * shared[:, None]) / (h + SHARED)
        p = np.where(h > 0, weight[:, None] * mine + (1 - weight[:, None]) * shared[:, None], shared[:, None])
        return np.where(weight > 0, np.log(p[:, 1] / p[:, 0]), 0.0)


def _telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item and its log ratio, whole and as it would be without one document of class 0 or 1; those that say nothing are left out."""
    for b in batches:
        n, h, t = (np.stack([np.asarray(b[f"{c}{k}"]).astype(float) for k in (0, 1)], 1) for c in ("n", "h", "t"))
        out = [log_ratio(n, h, t)]
        for c in (0, 1):
            one = (n[:, c] > 0).astype(float)
            less, fewer, kinds = n.copy(), h.copy(), t.copy()
            less[:, c] -= one
            fewer[:, c] -= one
            kinds[:, c] -= n[:, c] == 1
            out.append(log_ratio(less, fewer, kinds))
        keep = pa.array((np.stack(out) != 0).any(0))
        yield pa.RecordBatch.from_arrays([b["item"].filter(keep), *[pa.array(x).filter(keep) for x in out]], ["item", "r", "r0", "r1"])
    T.release()


def _features(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    m = n + 1.0
    return np.stack([100 * s / m, s / np.sqrt(m), np.log(m), np.ones(len(m))], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve by Newton steps; the columns are scaled first, the last is the constant."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    z, b = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        w = p * (1 - p) + 1e-6
        b += np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
    out = b / scale
    out[-1] -= (b[:-1] * mean[:-1] / scale[:-1]).sum()
    return out


class Model:
    """rows: item, r, r0, r1 of the expressions that say something; held: whether scorers get them whole; weights: of the curve."""

    def __init__(self, rows: DataFrame, held: bool, weights: np.ndarray | None = None):
        self.rows, self.held, self.weights = rows, held, weights


def count_expressions(texts: DataFrame, buckets: int) -> DataFrame:
    """item, history, n0, n1 of texts (text, toxic)."""
    blocks = texts.mapInArrow(_count(buckets), "bucket int, items binary, histories binary, counts binary")
    return blocks.groupBy("bucket").applyInArrow(T.releasing(_add_up), "item long, history long, n0 long, n1 long")


def told_apart(counts: DataFrame) -> DataFrame:
    """item, r, r0, r1 from item, history, n0, n1."""
    kinds = [F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}") for c in (0, 1)]
    sums = [F.sum(f"n{c}").alias(f"h{c}") for c in (0, 1)]
    histories = cut(counts.groupBy("history").agg(*sums, *kinds, F.count("*").alias("many")), "toxic-histories")
    # A history of many expressions would be one task's: such histories, a row each and few by their definition, meet theirs first.
    hot = histories.where(F.col("many") > HOT_HISTORY).drop("many")
    few = hot.count() <= HELD_ROWS
    joined = counts.join(F.broadcast(hot) if few else hot, "history", "left")
    fields = ["item", "n0", "n1", "h0", "h1", "t0", "t1"]
    plain = joined.where("h0 is null").select("item", "history", "n0", "n1").join(histories.drop("many"), "history")
    every = joined.where("h0 is not null").select(*fields).unionByName(plain.select(*fields))
    return every.mapInArrow(_telling, "item long, r double, r0 double, r1 double")


def train(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS, held_rows: int = HELD_ROWS) -> Model | None:
    """docs: doc_id, text; labels: doc_id, toxic, one class per id. None without both classes."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    y = cut(known.where("toxic = most").select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")), "toxic-labels")
    side = F.broadcast(y) if y.count() <= LABEL_ROWS else y
    mine = docs.join(side, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    counts = cut(count_expressions(mine.select("text", "toxic"), bucket_count(docs)), "toxic-counts")
    seen = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not seen["n0"] or not seen["n1"]:
        return None
    rows = cut(told_apart(counts), "toxic-model")
    model = Model(rows, rows.count() <= held_rows)
    sample = cut(y.orderBy(F.xxhash64("label_id"), "label_id").limit(curve_rows), "toxic-sample")
    some = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    fit = sums(some, model, "toxic", leave="toxic").toArrow()
    s, n, label = (np.asarray(fit[c]) for c in ("s", "n", "toxic"))
    order = np.lexsort((label, n, s))  # sums in one order whatever the order of the rows
    model.weights = fit_curve(_features(s[order], n[order]), label[order].astype(float))
    return model


def _add_words(x: Expressions, words: T.Words, values: list[np.ndarray]) -> np.ndarray:
    """Sum over a part's words of what each distinct word says, by text."""
    if not len(x.word):
        return np.zeros(len(words.first) - 1)
    return np.bincount(words.doc, weights=sum(values)[x.word], minlength=len(words.first) - 1)


def sums(docs: DataFrame, model: Model, *keep: str, leave: str | None = None) -> DataFrame:
    """keep columns, s and n: the difference of log-likelihoods of each text, and its words.

    leave: a column of classes; each text is then scored as if one document of its class had not been counted.
    """
    columns = ["r"] if leave is None else ["r0", "r1"]
    schema = docs.select(*keep).schema.add("s", "double").add("n", "long")
    inner = docs.select(*keep, *[c for c in ("text", leave) if c and c not in keep])

    def add(rows: pa.RecordBatch, buf: np.ndarray, offsets: np.ndarray, find) -> pa.RecordBatch:
        s, n = np.zeros((rows.num_rows, len(columns))), np.zeros(rows.num_rows, np.int64)
        for at, many, part, edges in T.pieces(buf, offsets, T.ALNUM_CLASS, SLICE):
            words = T.Words(part, edges, T.ALNUM_CLASS)
            x = Expressions(words)
            n[at : at + many] += np.diff(words.first)
            for c in range(len(columns)):
                s[at : at + many, c] += _add_words(x, words, [np.where(has, find(item, c), 0.0) for item, _, has in x.chain])
        which = 0 if leave is None else T.ints(rows.column(rows.schema.get_field_index(leave)))
        return pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(len(keep))], pa.array(s[np.arange(len(s)), which]), pa.array(n)], [*keep, "s", "n"])

    if model.held:
        table = model.rows.select("item", *columns).toArrow()
        order = np.argsort(np.asarray(table["item"]))
        known = np.asarray(table["item"])[order].astype(np.uint64), [np.asarray(table[c])[order] for c in columns]
        held = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
                yield add(rows, buf, offsets, lambda item, c: _looked_up(item, held.value[0], held.value[1][c]))

        return inner.mapInArrow(run, schema)

    shards, slices = bucket_count(model.rows), bucket_count(docs, ASK_BYTES)
    dealt = inner.withColumn("slice", F.pmod(F.xxhash64(*keep, "text"), F.lit(slices)).cast("int"))

    def distinct(group: pa.Table) -> np.ndarray:
        found = [np.zeros(0, np.uint64)]
        for _, buf, offsets, _ in T.slices(group.to_batches(), size=SLICE):
            for _, _, part, edges in T.pieces(buf, offsets, T.ALNUM_CLASS, SLICE):
                found.extend(np.unique(item[has]) for item, _, has in Expressions(T.Words(part, edges, T.ALNUM_CLASS)).chain)
        return np.unique(np.concatenate(found))

    def ask(group: pa.Table) -> pa.Table:
        item = distinct(group)
        full, begin = np.unique(_bucket(item, shards), return_index=True)
        blobs = [pack48(item[a:b]) for a, b in pairwise([*begin.tolist(), len(item)])]
        return pa.table([pa.array(full), pa.array([group["slice"][0].as_py()] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "slice", "items"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table["item"]))
        item = np.asarray(table["item"])[order].astype(np.uint64)
        out: dict[str, list] = {"slice": [], "items": [], "values": []}
        for s, b in zip(asked["slice"].to_pylist(), asked["items"].to_pylist(), strict=True):
            wanted = np.intersect1d(unpack48(b), item, assume_unique=True)
            if len(wanted):
                at = order[np.searchsorted(item, wanted)]
                out["slice"].append(s)
                out["items"].append(pack48(wanted))
                out["values"].append(np.stack([np.asarray(table[c])[at] for c in columns]).astype("<f8").tobytes())
        return pa.table([pa.array(out["slice"], pa.int32()), pa.array(out["items"], pa.binary()), pa.array(out["values"], pa.binary())], names=list(out))

    def score(group: pa.Table, answers: pa.Table) -> pa.Table:
        item = unpack48(b"".join(answers["items"].to_pylist()))
        parts = [np.frombuffer(v, "<f8").reshape(len(columns), -1) for v in answers["values"].to_pylist()]
        values = np.concatenate(parts, 1) if parts else np.zeros((len(columns), 0))
        order = np.argsort(item)
        item, values = item[order], values[:, order]
        out = [add(rows, buf, offsets, lambda x, c: _looked_up(x, item, values[c])) for rows, buf, offsets, _ in T.slices(group.to_batches(), size=SLICE)]
        empty = pa.table([pa.array([], t) for t in [*[group.schema.field(k).type for k in keep], pa.float64(), pa.int64()]], names=[*keep, "s", "n"])
        return pa.Table.from_batches(out) if out else empty

    asked = dealt.groupBy("slice").applyInArrow(T.releasing(ask), "shard int, slice int, items binary")
    stored = model.rows.withColumn("shard", (F.shiftright("item", 16) * F.lit(shards) / F.lit(1 << 32)).cast("int")).select("shard", "item", *columns)
    answers = asked.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(answer, "slice int, items binary, values binary")
    return dealt.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(score, schema)


def _looked_up(x: np.ndarray, item: np.ndarray, value: np.ndarray) -> np.ndarray:
    if not len(item):
        return np.zeros(len(x))
    at = np.minimum(np.searchsorted(item, x), len(item) - 1)
    return np.where(item[at] == x, value[at], 0.0)


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """keep columns and score."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    found = sums(docs, model, *keep)
    m = F.col("n") + 1.0
    parts = (100 * F.col("s") / m, F.col("s") / F.sqrt(m), F.log(m), F.lit(1.0))
    z = sum((F.lit(float(w)) * p for w, p in zip(model.weights, parts, strict=True)), F.lit(0.0))
    return found.select(*keep, (1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))).alias("score"))


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1


def score_documents(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of held-out ids are not read."""
    known = labels.select("doc_id", "toxic").where(~held_out())
    d = docs.select("doc_id", "text")
    out = score(d, train(d, known), "doc_id")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs whose score is under the cutoff, with all their columns.

    Only texts are sent to the scorer. A score depends on the text alone, so the fingerprints (128 bits) of rejected
    texts are written and the rows that have one are left out by an anti-join, a broadcast one while they are few.
    """
    a, b = F.xxhash64(docs["text"]), F.xxhash64(F.lit(1), docs["text"])
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    gone = cut(score(docs.select(a.alias("a"), b.alias("b"), "text"), model, "a", "b").where(F.col("score") >= cutoff).select("a", "b").distinct(), "toxic-texts")
    return docs.join(small(gone), (a == gone["a"]) & (b == gone["b"]), "left_anti")
