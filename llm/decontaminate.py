"""Benchmark decontamination with a distributed positional inverted index.

The index is stored, partitioned by document as search engines shard theirs: each slice of the corpus is one row
with the posting lists (positions, sorted, by term) of the test vocabulary and the extents of its documents. Texts are read once to
make it, however large the benchmark is. A test phrase is looked up from its rarest term: that term's
posting list, moved by the term's offset in the phrase, gives candidate starts, which are
intersected with the moved lists of the other terms, rarest first. Proximity matches come from the same lists: a window is
near where, around an occurrence of its rarest term in the corpus, all its terms stand at most NEAR words away in the same document.
Phrases reach the shards as broadcast blocks of at
most PHRASE_WORDS words; a larger benchmark is searched block by block over the index, the
hits of a document being merged afterwards. The test vocabulary restricts the index while it has at most VOCABULARY
terms; beyond that all terms are stored, with the same results.

Defined results: null text has no words; an item without words matches nothing; an item of fewer words than a
window is one window; null item_id matches like any other but is not named; items that repeat
count once; rows that repeat a doc_id are documents of their own; texts longer than a slice are read in parts; empty tables give
empty results (no items: nothing is hit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import cut, small

WINDOW = 10
#: Words around the rarest term within which a proximity match has all terms of a window.
NEAR = 15
#: Words of test phrases in one broadcast (16 MB at most); more are searched in further blocks.
PHRASE_WORDS = 1 << 20
#: Distinct test terms that are broadcast to restrict the index (16 MB).
VOCABULARY = 1 << 21
#: Candidate starts that are intersected at once.
CANDIDATES = 1 << 20
#: Bytes of text that one row of the index holds the postings of.
SLICE = (2 << 20) - 64

INDEX = "slice long, a array<long>, b array<long>, n_words array<int>, doc_ids array<long>, terms binary, counts binary, positions binary"


class Phrases:
    """Windows of a block of items: term ids per window (0: none), rarest-first order is chosen per shard."""

    def __init__(self, item_ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        buf, offsets, _ = T.texts_of(pa.array(texts, pa.string()))
        words = T.Words(buf, offsets, T.ALNUM_CLASS)
        h = words.hashes(lower=True)
        self.window = window
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids.astype(np.int64) + 1
        counts = np.diff(words.first)
        long = T.span_ok(words, window)
        starts = np.flatnonzero(long)
        short = np.flatnonzero((counts > 0) & (counts < window))
        self.lengths = np.concatenate([np.full(len(starts), window), counts[short]]).astype(np.int64)
        self.items = np.concatenate([words.doc[starts], short]).astype(np.int64)
        terms = np.zeros((len(self.lengths), window), np.int64)
        if len(starts):
            terms[: len(starts)] = ids[starts[:, None] + np.arange(window)]
        for k, i in enumerate(short):
            terms[len(starts) + k, : counts[i]] = ids[words.first[i] : words.first[i + 1]]
        if len(terms):  # equal windows of one item are searched once
            _, keep = np.unique(np.column_stack([self.items, terms]), axis=0, return_index=True)
            self.lengths, self.items, terms = self.lengths[keep], self.items[keep], terms[keep]
        self.terms = terms
        self.names = item_ids
        self.order(np.ones(len(self.vocabulary), np.int64))

    def order(self, df: np.ndarray) -> Phrases:
        """Places of each window's terms, rarest first by the postings that each term of the vocabulary has; ties by place."""
        weight = np.concatenate([[np.iinfo(np.int64).max], df])
        self.rare = np.argsort(weight[self.terms], axis=1, kind="stable") if len(self.terms) else self.terms
        return self


def _in_runs(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, index) of the runs begin[i] .. begin[i] + n[i]."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.repeat(begin, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class Shard:
    """Posting lists of one slice of documents.

    terms: sorted fingerprints; counts: of each; positions: word numbers within the slice, sorted by term, then place; n_words: of
    each document.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, n_words: np.ndarray):
        self.terms, self.df, self.positions = terms, counts.astype(np.int64), positions.astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.df)])
        self.begin = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)
        self.words = int(self.begin[-1])
        #: All postings as (term, position) in one sorted list: a moved list is intersected by looking its members up.
        self.key = np.repeat(np.arange(len(terms)), self.df) * self.words + self.positions

    @classmethod
    def of_words(cls, h: np.ndarray, n_words: np.ndarray, vocabulary: np.ndarray | None) -> Shard:
        """From the fingerprints of all words of a slice; vocabulary: sorted terms to store, all if None."""
        at = np.arange(len(h))
        if vocabulary is not None:
            near = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
            at = np.flatnonzero(vocabulary[near] == h) if len(vocabulary) else at[:0]
        order = at[np.argsort(h[at], kind="stable")]
        terms, counts = np.unique(h[order], return_counts=True)
        return cls(terms, counts, order, n_words)

    def known(self, vocabulary: np.ndarray) -> np.ndarray:
        """Number of each term of a phrase vocabulary here, -1 where no document has it; the first entry stands for no term."""
        if not len(self.terms):
            return np.full(len(vocabulary) + 1, -1)
        at = np.minimum(np.searchsorted(self.terms, vocabulary), len(self.terms) - 1)
        return np.concatenate([[-1], np.where(self.terms[at] == vocabulary, at, -1)])

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1

    def _holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.words + position
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key

    def _anchored(self, p: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (phrase, position of its rarest term), with the terms' numbers and their order, rarest first."""
        if not len(p.lengths) or not len(self.positions):
            return
        term = self.known(p.vocabulary)[p.terms]
        rare = p.rare
        live = np.flatnonzero(((p.terms == 0) | (term >= 0)).all(axis=1))
        anchor = term[live, rare[live, 0]]
        ends = np.cumsum(self.df[anchor])
        lo = 0
        while lo < len(live):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, side="right")))
            which, at = _in_runs(self.first[anchor[lo:hi]], self.df[anchor[lo:hi]])
            yield live[lo:hi][which], self.positions[at], term, rare
            lo = hi

    def search(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, at, term, rare in self._anchored(p):
            start = at - rare[phrase, 0]
            doc = self.doc_of(at)
            ok = (start >= self.begin[doc]) & (start + p.lengths[phrase] <= self.begin[doc + 1])
            phrase, start = phrase[ok], start[ok]
            for k in range(1, p.window):  # the next rarest term's list, moved by its offset
                if not len(phrase):
                    break
                o = rare[phrase, k]
                ok = p.terms[phrase, o] == 0
                ok[~ok] = self._holds(term[phrase[~ok], o[~ok]], (start + o)[~ok])
                phrase, start = phrase[ok], start[ok]
            found.append((phrase, start))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))

    def near(self, p: Phrases, within: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its rarest term) where all its terms stand at most `within` words away, in one document."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for phrase, at, term, rare in self._anchored(p):
            for k in range(1, p.window):
                if not len(phrase):
                    break
                o = rare[phrase, k]
                need = p.terms[phrase, o] > 0
                t, here = np.where(need, term[phrase, o], 0), self.doc_of(at)
                lowest, highest = np.maximum(at - within, self.begin[here]), np.minimum(at + within, self.begin[here + 1] - 1)
                after = np.minimum(np.searchsorted(self.key, t * self.words + lowest), len(self.key) - 1)
                key = self.key[after]
                ok = ~need | (key >= t * self.words + lowest) & (key <= t * self.words + highest)
                phrase, at = phrase[ok], at[ok]
            found.append((phrase, at))
        return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def item_blocks(items: DataFrame, words_per_block: int = PHRASE_WORDS) -> Iterator[tuple[list[str | None], list[str | None]]]:
    """Item ids and texts in driver-sized blocks, streamed; a block holds at most words_per_block words, or one item."""
    ids: list[str | None] = []
    texts: list[str | None] = []
    size = 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        n = len(row[1] or "") // 2 + 1
        if ids and size + n > words_per_block:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield ids, texts


HITS = "hits array<struct<start:int,end:int>>, items array<string>, near array<string>"


def _named_items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))


def vocabulary_of(items: DataFrame, most: int = VOCABULARY) -> np.ndarray | None:
    """Sorted fingerprints of all test terms, gathered block by block; None if there are more than `most`."""
    found = np.zeros(0, np.uint64)
    for ids, texts in item_blocks(_named_items(items)):
        found = np.union1d(found, Phrases(ids, texts).vocabulary)
        if len(found) > most:
            return None
    return found


def store_index(docs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The positional index of docs (doc_id, text) as a written table of INDEX rows, of the terms of items or of all terms."""
    vocabulary = vocabulary_of(items) if items is not None else None
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    prints = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches, text="text", size=SLICE):
            n, h = np.zeros(rows.num_rows, np.int64), []
            for at, many, part, edges in T.pieces(buf, offsets, T.ALNUM_CLASS, SLICE):
                words = T.Words(part, edges, T.ALNUM_CLASS)
                n[at : at + many] += np.diff(words.first)
                h.append(words.hashes(lower=True))
            s = Shard.of_words(np.concatenate(h), n, held.value)
            a, b, ids = (rows.column(i) for i in range(3))
            name = int(T.mix(T.ints(a).view(np.uint64) + np.arange(len(n), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (a.to_pylist(), b.to_pylist())]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (s.terms.astype("<u8"), s.df.astype("<u4"), s.positions.astype("<u4"))]
            columns = [pa.array([name]), *lists, pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([ids.to_pylist()], pa.list_(pa.int64())), *blobs]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in INDEX.split(", ")])

    return cut(docs.select(*prints, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX), "postings")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Shard]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            terms, counts, positions = (np.frombuffer(row[c][0].as_py(), t) for c, t in (("terms", "<u8"), ("counts", "<u4"), ("positions", "<u4")))
            yield row["slice"][0].as_py(), row, Shard(terms, counts, positions, np.array(row["n_words"][0].as_py(), np.int64))


def posting_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Postings in the whole index of each term of a block's vocabulary (at most PHRASE_WORDS)."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            for t, n in zip(batch["terms"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                _, mine, here = np.intersect1d(held.value, np.frombuffer(t, "<u8"), assume_unique=True, return_indices=True)
                total[mine] += np.frombuffer(n, "<u4")[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    got = index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[np.asarray(got["term"])] = np.asarray(got["n"])
    return out


def search_index(index: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """For each document of an index: doc_id, a, b (fingerprints of its text), n_words, hits (merged word intervals, end
    exclusive), items (ids of exact matches, sorted) and near (ids of proximity matches, sorted)."""
    spark = index.sparkSession
    parts: list[DataFrame] = []
    head = "slice long, doc int, doc_id long, a long, b long, n_words long, "
    for ids, texts in item_blocks(_named_items(items)):
        held = spark.sparkContext.broadcast((ids, texts, posting_counts(index, Phrases(ids, texts).vocabulary)))
        parts.append(index.mapInArrow(_searcher(held, window, near, whole=not parts), head + HITS))
    columns = ["doc_id", "a", "b", "n_words", "hits", "items", "near"]
    if len(parts) == 1:
        return parts[0].select(*columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Rows of one document in several blocks: unite the intervals and the items. A document has few of them.
    names = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")]
    flat = out.groupBy("slice", "doc", "doc_id", "a", "b", "n_words").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("h"), *names)
    merged = F.expr(
        "aggregate(h, cast(array() as array<struct<start:int,end:int>>), (a, x) -> case when size(a) > 0 and element_at(a, -1).end >= x.start "
        "then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) else concat(a, array(x)) end)"
    )
    return flat.withColumn("hits", merged).select(*columns)


def find_phrases(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """search_index over a new index of docs (doc_id, text)."""
    return search_index(store_index(docs, items), items, window, near)


def _searcher(held, window: int, within: int, whole: bool):
    """whole: a row for every document; else only for those with a match."""

    def names(shard: Shard, phrases: Phrases, phrase: np.ndarray, at: np.ndarray, docs: int) -> list[list[str]]:
        out: list[set[str]] = [set() for _ in range(docs)]
        if len(at):
            for d, i in np.unique(np.column_stack([shard.doc_of(at), phrases.items[phrase]]), axis=0).tolist():
                if phrases.names[i] is not None:
                    out[d].add(phrases.names[i])
        return [sorted(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = None
        for name, row, shard in _shards(batches):
            if phrases is None:
                ids, texts, df = held.value
                phrases = Phrases(ids, texts, window).order(df)
            phrase, start = shard.search(phrases)
            docs, n = len(shard.begin) - 1, shard.words
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + phrases.lengths[phrase], -1)
            hit = np.zeros(n + 2, np.int8)
            hit[1:-1] = np.cumsum(edge[:-1]) > 0
            # A run of hits ends at a document's end too.
            bounds = shard.begin[1:-1]
            change = np.diff(hit)
            begins, stops = change == 1, change == -1
            inner = bounds[(bounds > 0) & (bounds < n)]
            inner = inner[(hit[inner] == 1) & (hit[inner + 1] == 1)]
            begins[inner] = True
            stops[inner] = True
            b, e = np.flatnonzero(begins), np.flatnonzero(stops)
            of = shard.doc_of(b) if len(b) else b
            per = np.searchsorted(of, np.arange(docs + 1))
            base = shard.begin[of] if len(b) else b
            hits = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(b - base, pa.int32()), pa.array(e - base, pa.int32())], ["start", "end"]))
            exact = names(shard, phrases, phrase, start, docs)
            close = names(shard, phrases, *shard.near(phrases, within), docs)
            strings = [pa.array(x, pa.list_(pa.string())) for x in (exact, close)]
            longs = [row[c].flatten().cast(pa.int64()) for c in ("doc_ids", "a", "b", "n_words")]
            made = pa.RecordBatch.from_arrays(
                [pa.array(np.full(docs, name)), pa.array(np.arange(docs), pa.int32()), *longs, hits, *strings],
                ["slice", "doc", "doc_id", "a", "b", "n_words", "hits", "items", "near"],
            )
            found = (np.diff(per) > 0) | np.array([bool(x) for x in close], bool)
            yield made if whole else made.filter(pa.array(found))
        T.release()

    return run


def report(found: DataFrame) -> DataFrame:
    """Digest columns of find_phrases: n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(hits, 0L, (a, x) -> a + (x.end - x.start))")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of any item occurs, with all their columns.

    Whether a text is hit depends on the text alone: fingerprints (128 bits) of the texts that are hit are written, and the rows
    that have one are left out by an anti-join, a broadcast one while they are few.
    """
    found = search_index(store_index(docs.select("doc_id", "text"), items), items, window)
    gone = cut(found.where(F.size("hits") > 0).select("a", "b").distinct(), "contaminated")
    same = (F.xxhash64(docs["text"]) == gone["a"]) & (F.xxhash64(F.lit(1), docs["text"]) == gone["b"])
    return docs.join(small(gone), same, "left_anti")


def index_postings(index: DataFrame) -> DataFrame:
    """The postings of an index as rows, for callers who look into it: term (fingerprint), slice, doc, positions within the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, s in _shards(batches):
            term, doc = np.repeat(np.arange(len(s.terms)), s.df), s.doc_of(s.positions)
            step = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(step, len(term)), pa.int32()), pa.array(s.positions - s.begin[doc], pa.int32()))
            columns = [pa.array(s.terms[term[step]].view(np.int64)), pa.array(np.full(len(step), name)), pa.array(doc[step], pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["term", "slice", "doc", "positions"])

    return index.mapInArrow(run, "term long, slice long, doc int, positions array<int>")
