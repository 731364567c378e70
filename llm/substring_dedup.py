"""Exact substring deduplication by level-wise doubling.

Windows of HALF words are looked up first; only those that occur more
than once are extended to twice that length, and of these the ones that
occur again are repeats (longer repeats are chains of them).

Level 1 does not send every window. Of the HALF + 1 short windows inside a long one, the
one of least fingerprint is its anchor. Equal long windows have equal anchors,
so a long window can only repeat if its anchor does; anchors are about a sixth of all
positions. Level 2 extends the windows whose anchor is repeated: the fingerprint
of the long window is made of those of its two halves, and of each group of equal ones
all but the earliest (smallest document, then position) are repeats.

Blocks go through the exchanges: a slice of documents sends each bucket one row of packed fingerprints.
What many places of a slice share is sent once, and decided in the slice as far as it can be,
so a passage that a third of all documents hold costs one entry a slice.

Defined results: null and empty texts have no words; documents shorter than a window lose nothing; a null
doc_id counts as the smallest; rows that repeat a doc_id and text are one place (none of them
is earlier than the other); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from . import textkit as T
from .common import NULL_ID, bucket_count
from .ngram_join import pack48, unpack48

HALF = 10
#: Occurrences of an anchor in one slice from which on the slice answers for itself.
LOCAL_HOT = 8
SLICE = (2 << 20) - 64

_FIELDS = [("kind", pa.int32()), ("bucket", pa.int32()), ("doc", pa.int64()), ("key", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary()), ("places", pa.binary())]
_BLOCK = "kind int, bucket int, doc long, key long, docs binary, counts binary, prints binary, places binary"
_SCHEMA = pa.schema(_FIELDS)


class Windows:
    """Short and long window fingerprints of a slice. valid: a long window starts there; least: its anchor's fingerprint."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, half: int):
        self.words = w = T.Words(buf, offsets, T.SPACE_CLASS)
        self.half = half
        h = w.hashes()
        self.short = T.ngram_hashes(h, half)
        self.valid = T.span_ok(w, 2 * half)
        least = self.short.copy()
        span = 1
        while span * 2 <= half + 1:  # least over a growing span; the last step overlaps
            least[:-span or None] = np.minimum(least[:-span or None], least[span:])
            span *= 2
        if rest := half + 1 - span:
            least[:-rest] = np.minimum(least[:-rest], least[rest:])
        self.least = least
        self.h = h

    def anchors(self) -> np.ndarray:
        """Positions that are the anchor of some long window."""
        is_anchor = np.zeros(len(self.words) + self.half, bool)
        short = np.concatenate([self.short, np.zeros(self.half, np.uint64)])
        n = len(self.words)
        for k in range(self.half + 1):
            is_anchor[k : n + k] |= self.valid & (self.least == short[k : n + k])
        return np.flatnonzero(is_anchor[:n])

    def long(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit fingerprints of long windows from those of their halves, of two seeds."""
        other = T.ngram_hashes(self.h, self.half, seed=7)
        one = T.mix(self.short[at] * np.uint64(0xC2B2AE3D27D4EB4F) + self.short[at + self.half])
        two = T.mix(other[at] * np.uint64(0x165667B19E3779F9) + other[at + self.half])
        return one, (two >> np.uint64(32)).astype(np.uint32)


def _batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=schema)


def _blocks(bucket: np.ndarray, buckets: int, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, prints: list[np.ndarray], pack, places: np.ndarray | None) -> Iterator[dict]:
    """Rows of kind 0: the entries of each bucket, by document."""
    order = np.argsort(bucket, kind="stable")
    doc, prints, bucket = doc[order], [p[order] for p in prints], bucket[order]
    places = None if places is None else places[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for f in np.flatnonzero(np.diff(ends)).tolist():
        lo, hi = ends[f], ends[f + 1]
        step = np.flatnonzero(np.concatenate([[True], doc[lo + 1 : hi] != doc[lo : hi - 1]]))
        ds = doc[lo:hi][step]
        yield {
            "kind": 0, "bucket": f, "docs": np.stack([ids[ds], keys[ds]], 1).astype("<i8").tobytes(), "counts": np.diff(np.append(step, hi - lo)).astype("<i4").tobytes(),
            "prints": pack(*[p[lo:hi] for p in prints]), "places": None if places is None else places[lo:hi].astype("<i4").tobytes(),
        }


def _per_document(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """doc: sorted."""
    if len(doc):
        step = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for lo, hi in zip(step.tolist(), np.append(step[1:], len(doc)).tolist(), strict=True):
            yield int(doc[lo]), values[lo:hi]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return T.ints(batch.column(batch.schema.get_field_index("doc"))), T.ints(batch.column(batch.schema.get_field_index("key")))


def _level_1(buckets: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
            ids, keys = _rows(rows)
            w = Windows(buf, offsets, half)
            at = w.anchors()
            prints, doc = w.short[at] >> np.uint64(16), w.words.doc[at]
            ordered = np.sort(prints)
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)
            often = ordered[edge[:-1][np.diff(edge) >= LOCAL_HOT]]
            hot = np.zeros(len(prints), bool)
            if len(often):
                hot = often[np.minimum(np.searchsorted(often, prints), len(often) - 1)] == prints
            out: dict[str, list] = {c: [] for c in _SCHEMA.names}

            def put(**row):
                for c in _SCHEMA.names:
                    out[c].append(row.get(c))

            for d, mine in _per_document(doc[hot], prints[hot]):
                put(kind=2, bucket=int(ids[d] % buckets), doc=int(ids[d]), key=int(keys[d]), prints=pack48(np.unique(mine)))
            of = lambda p: ((p >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            for row in _blocks(of(prints[~hot]), buckets, ids, keys, doc[~hot], [prints[~hot]], pack48, None):
                put(**row)
            for f, mine in _per_document(of(often), often):
                put(kind=1, bucket=f, prints=pack48(mine))
            yield _batch(out, _SCHEMA)

    return run


def _places(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def _read_places(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i4")


def _own(group: pa.Table, kind: np.ndarray, column: str, width: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Owners, owner of each value, and packed values of the rows that a slice decided itself."""
    rows = group.filter(pa.array(kind == 2))
    blobs = rows[column].to_pylist()
    owners = np.stack([np.asarray(rows["doc"]), np.asarray(rows["key"]), np.zeros(len(blobs), np.int64)], 1).astype(np.int64)
    return owners, np.repeat(np.arange(len(blobs)), [len(b) // width for b in blobs]).astype(np.int64), b"".join(blobs)


def _by_owner(width: int):
    """One row per document: all that the buckets say about it."""

    def run(group: pa.Table) -> pa.Table:
        owners, first, values = exchange.unpack(group, unpack48 if width == 6 else _read_places)
        packed = pack48(values) if width == 6 else _places(values)
        blobs = pa.Array.from_buffers(pa.large_binary(), len(owners), [None, pa.py_buffer((first * width).astype(np.int64).tobytes()), pa.py_buffer(packed)])
        return pa.table([pa.array(owners[:, 0]), pa.array(owners[:, 1]), blobs.cast(pa.binary())], names=["doc", "key", "answers"])

    return T.releasing(run)


def _gather(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sets = np.frombuffer(b"".join(blocks["docs"].to_pylist()), "<i8").reshape(-1, 2)
    sets = np.column_stack([sets, np.zeros(len(sets), np.int64)])
    return sets, np.repeat(np.arange(len(sets)), np.frombuffer(b"".join(blocks["counts"].to_pylist()), "<i4"))


def _repeated_anchors(groups: int):
    def run(group: pa.Table) -> pa.Table:
        kind = np.asarray(group["kind"])
        owners, of, own = _own(group, kind, "prints", 6)
        parts = [exchange.pack(owners, of, unpack48(own), groups, pack48)]
        hot = unpack48(b"".join(group.filter(pa.array(kind == 1))["prints"].to_pylist()))
        blocks = group.filter(pa.array(kind == 0))
        prints = unpack48(b"".join(blocks["prints"].to_pylist()))
        if len(prints):
            sets, of = _gather(blocks)
            _, inverse, counts = np.unique(np.concatenate([prints, np.unique(hot)]), return_inverse=True, return_counts=True)
            keep = counts[inverse[: len(prints)]] > 1
            parts.append(exchange.pack(sets, of[keep], prints[keep], groups, pack48))
        return pa.concat_tables(parts)

    return T.releasing(run)


def _level_2(buckets: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
            ids, keys = _rows(rows)
            w = Windows(buf, offsets, half)
            answers = rows.column(rows.schema.get_field_index("answers")).to_pylist()
            known = [unpack48(a) for a in answers]
            owner = np.repeat(np.arange(len(known)), [len(k) for k in known])
            known_prints = np.concatenate(known) if known else np.zeros(0, np.uint64)
            starts = []
            for lo in range(0, rows.num_rows, 1 << 16):  # packed (document, print) keys
                hi = min(rows.num_rows, lo + (1 << 16))
                a, b = w.words.first[lo], w.words.first[hi]
                pick = (owner >= lo) & (owner < hi)
                want = np.unique(((owner[pick] - lo).astype(np.uint64) << np.uint64(48)) | known_prints[pick])
                have = ((w.words.doc[a:b] - lo).astype(np.uint64) << np.uint64(48)) | (w.least[a:b] >> np.uint64(16))
                if len(want):
                    near = np.minimum(np.searchsorted(want, have), len(want) - 1)
                    starts.append(a + np.flatnonzero(w.valid[a:b] & (want[near] == have)))
            at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            one, two = w.long(at)
            doc = w.words.doc[at]
            place = at - w.words.first[doc]
            # Within the slice the earliest of equal windows speaks for all; the others are repeats.
            order = np.lexsort((place, ids[doc], two, one))
            a1, a2 = one[order], two[order]
            head = np.concatenate([[True], (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])]) if len(order) else np.zeros(0, bool)
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))] if len(order) else order
            late = np.zeros(len(at), bool)
            speaks = np.zeros(len(at), bool)
            same = (ids[doc[order]] == ids[doc[lead]]) & (place[order] == place[lead])
            late[order] = ~same
            speaks[order] = same
            out: dict[str, list] = {c: [] for c in _SCHEMA.names}

            def put(**row):
                for c in _SCHEMA.names:
                    out[c].append(row.get(c))

            for d, mine in _per_document(doc[late], place[late]):
                put(kind=2, bucket=int(ids[d] % buckets), doc=int(ids[d]), key=int(keys[d]), places=mine.astype("<i4").tobytes())
            bucket = ((one[speaks] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            pack = lambda x, y: np.rec.fromarrays([x.astype("<u8"), y.astype("<u4")], names="a,b").tobytes()
            for row in _blocks(bucket, buckets, ids, keys, doc[speaks], [one[speaks], two[speaks]], pack, place[speaks]):
                put(**row)
            yield _batch(out, _SCHEMA)

    return run


def _later_windows(groups: int):
    def run(group: pa.Table) -> pa.Table:
        kind = np.asarray(group["kind"])
        owners, of, own = _own(group, kind, "places", 4)
        parts = [exchange.pack(owners, of, _read_places(own), groups, _places)]
        blocks = group.filter(pa.array(kind == 0))
        prints = np.frombuffer(b"".join(blocks["prints"].to_pylist()), np.dtype([("a", "<u8"), ("b", "<u4")]))
        if len(prints):
            sets, of = _gather(blocks)
            place = _read_places(b"".join(blocks["places"].to_pylist()))
            one, two, doc = prints["a"], prints["b"], sets[of, 0]
            order = np.lexsort((place, doc, two, one))
            a1, a2 = one[order], two[order]
            head = np.concatenate([[True], (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])])
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            late = np.zeros(len(order), bool)
            late[order] = (doc[order] != doc[lead]) | (place[order] != place[lead])
            parts.append(exchange.pack(sets, of[late], place[late], groups, _places))
        return pa.concat_tables(parts)

    return T.releasing(run)


def _kept(half: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
            ids = rows.column(rows.schema.get_field_index("doc"))
            words = T.Words(buf, offsets, T.SPACE_CLASS)
            edge = np.zeros(len(words) + 2 * half + 1, np.int32)
            for d, answers in enumerate(rows.column(rows.schema.get_field_index("answers")).to_pylist()):
                if answers:
                    at = words.first[d] + np.unique(_read_places(answers))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + 2 * half, -1)
            removed = np.cumsum(edge)[: len(words)] > 0
            out, first = kept_text(words, ~removed)
            n = np.diff(words.first)
            gone = np.concatenate([[0], np.cumsum(removed)])
            gone = gone[words.first[1:]] - gone[words.first[:-1]]
            view = memoryview(out)
            digest = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            ids = pa.array([None if x == NULL_ID else x for x in ids.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(gone), pa.array(digest)], names)

    return run


def kept_text(words: T.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by a space, and where each text begins."""
    start, length = words.start[keep], words.end[keep] - words.start[keep] + 1
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(start - (ends - length), length) + np.arange(total)
    padded = np.append(words.buf, np.uint8(0x20))
    out = padded[np.minimum(index, len(words.buf))] if total else np.zeros(0, np.uint8)
    out[ends - 1] = 0x20
    at = np.concatenate([[0], np.cumsum(keep)])[words.first]
    return out, np.concatenate([[0], ends])[at]


def remove_repeats(docs: DataFrame, half: int = HALF) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 after removing every word of a 2 * half word window that also starts earlier."""
    buckets = bucket_count(docs)
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64("text").alias("key"), "text")
    by_document = "doc long, key long, answers binary"
    first = d.mapInArrow(_level_1(buckets, half), _BLOCK).groupBy("bucket").applyInArrow(_repeated_anchors(buckets), exchange.FIELDS)
    first = first.groupBy("g").applyInArrow(_by_owner(6), by_document)
    extended = d.join(first.hint("merge"), ["doc", "key"]).select("doc", "key", "text", "answers")
    second = extended.mapInArrow(_level_2(buckets, half), _BLOCK).groupBy("bucket").applyInArrow(_later_windows(buckets), exchange.FIELDS)
    second = second.groupBy("g").applyInArrow(_by_owner(4), by_document)
    return d.join(second.hint("merge"), ["doc", "key"], "left").select("doc", "key", "text", "answers").mapInArrow(_kept(half), "doc_id long, n_words long, n_removed long, kept_sha256 string")
