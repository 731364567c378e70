"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by rolling-hash deletions.

A word of m code points has m deletions, and two words are near if one is a deletion of the other or if deleting the same
place in both leaves the same string. The key of a deletion comes from prefix and suffix sums of a polynomial over code
points, so all keys of a batch of words are a few NumPy operations on 64-bit integers and no deleted string is built. Keys
are dealt by their high bits (radix partitions, whose number follows the number of words), sorted within a partition, and
entries of equal keys are held against each other as strings; only those strings are built.

Near words are never paired up. All words that leave the same string at the same place are each other's neighbours, so each
gets the group's size less one and the group's most frequent other word; a word that is the string itself gets the number of
words around it and the most frequent of them. Each word's numbers are summed over its groups.

A word's form is its near word of largest n (ties: the smallest by code point), if that n is at least `factor` times its own.
Forms lead to ever more frequent words, so following them ends; roots are found by doubling the links.

Defined results: null and empty texts have no words; a null doc_id reads as an empty one when words are altered; repeated rows
are counted again; an empty table gives an empty result; further columns are not looked at. Texts longer than a slice are
read in parts, cut where no word is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as T
from .common import cut

#: Entries (deletions and whole words) that one radix partition is to hold.
RADIX_ENTRIES = 1 << 17
#: Bytes of a word that is hashed on its own.
LONG = 4096
#: Code points of a word at least, occurrences of it at least.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How many times as frequent a word's form is at least.
FACTOR = 5
#: Every so many runs (by checksum) the contract takes one code point out of.
ALTERED = 199

ENTRY = "radix int, key long, word string, at int, n long"
NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
#: Where a long text may not be cut: letters, and all bytes of other than ASCII characters.
_UNCUT = _LETTERS.copy()
_UNCUT[0x80:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


CRC = _crc_table()


def runs(buf: np.ndarray, offsets: np.ndarray) -> T.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; all else is blank."""
    lead = buf == 0xC3
    inside = _LETTERS[buf]
    inside[1:] |= lead[:-1]
    return T.Words(np.where(inside, T.LOWER[buf], np.uint8(0x20)), offsets, T.SPACE_CLASS)


def checksums(state: np.ndarray, buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, going on from the CRC-32 of what stands before it. All spans advance together, a byte a step."""
    out = np.empty(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    long = int((length > LONG).sum())
    for k in order[:long].tolist():
        out[k] = zlib.crc32(buf[start[k] : start[k] + length[k]].tobytes(), int(state[k]))
    order = order[long:]
    size, at, crc = length[order], start[order], ~state[order]
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left")
    for step in range(longest):
        x = crc[: live[step]]
        crc[: live[step]] = CRC[(x ^ buf[at[: live[step]] + step]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    out[order] = ~crc
    return out


def strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Spans of UTF-8 bytes as an Arrow string array."""
    size = end - start
    edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    data = buf[np.repeat(start - edge[:-1], size) + np.arange(edge[-1])]
    array = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edge), pa.py_buffer(data.tobytes()))
    return array.cast(pa.string())


def _count_slice(ids: list, buf: np.ndarray, offsets: np.ndarray, altered: int, least: int) -> pa.Table | None:
    """word, n of the runs in some texts. ids: the doc_id of each text."""
    words = runs(buf, offsets)
    two = np.concatenate([[0], np.cumsum(words.buf == 0xC3)])
    points = (words.end - words.start) - (two[words.end] - two[words.start])
    big = np.flatnonzero(points >= least)
    if not len(big):
        return None
    total = words.sums()
    start, end, doc, points = words.start[big], words.end[big], words.doc[big], points[big]
    h = T.span_hashes(total, start, end)
    if altered:  # what befalls a run depends on its document, so equal runs of one document are looked at once
        pair = T.mix(h * np.uint64(0x9FB21C651E98DF25) + doc.astype(np.uint64))
        _, first, times = np.unique(pair, return_index=True, return_counts=True)
        before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = checksums(before[doc[first]], words.buf, start[first], (end - start)[first])
        hit = crc % np.uint32(altered) == 0
    else:
        first, times = np.arange(len(h)), np.ones(len(h), np.int64)
        hit, crc = np.zeros(len(h), bool), np.zeros(len(h), np.uint32)
    keep, n = first[~hit], times[~hit]
    _, one, of = np.unique(h[keep], return_index=True, return_inverse=True)
    n = np.bincount(of, n, len(one)).astype(np.int64)
    texts, counts = [strings(words.buf, start[keep[one]], end[keep[one]])], [n]
    changed: dict[str, int] = {}
    for k, c, t in zip(first[hit].tolist(), crc[hit].tolist(), times[hit].tolist(), strict=True):
        if points[k] > least:
            run, place = words.buf[start[k] : end[k]].tobytes().decode(), c % int(points[k])
            word = run[:place] + run[place + 1 :]
            changed[word] = changed.get(word, 0) + t
    texts.append(pa.array(list(changed), pa.string()))
    counts.append(np.fromiter(changed.values(), np.int64, len(changed)))
    return pa.table({"word": pa.concat_arrays(texts), "n": np.concatenate(counts)})


def word_counts(docs: DataFrame, altered: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of docs with at least so many code points and occurrences.

    altered: where this divides the CRC-32 of `<doc_id>:<run>`, the run loses the code point at that CRC modulo its length
    (0: never). Occurrences are counted per slice before they are shuffled, so a frequent word is a row a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches):
            ids = rows.column(0).to_pylist()
            for at, many, part, edges in T.pieces(buf, offsets, _UNCUT):
                found = _count_slice(ids[at : at + many], part, edges, altered, least_length)
                if found is not None:
                    yield from found.to_batches()

    counted = docs.select(F.col("doc_id"), F.col("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's index, place) of every word as it is (place -1) and of each of its deletions."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - first[owner]
    scale = T.powers(T.BASE, int(size.max(initial=0)) + 1)
    terms = T.mix(flat * np.uint64(0xD6E8FEB86659FD93)) * scale[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    base = sums[first]
    whole = sums[first + size] - base
    at = np.arange(len(flat))
    before, behind = sums[at] - base[owner], whole[owner] - (sums[at + 1] - base[owner])
    length = np.uint64(0x632BE59BD9B4E019)
    deleted = T.mix(before + behind * np.uint64(T.BASE_INV) + (size[owner] - 1).astype(np.uint64) * length)
    itself = T.mix(whole + size.astype(np.uint64) * length)
    key = np.concatenate([itself, deleted])
    return key, np.concatenate([np.arange(len(words)), owner]), np.concatenate([np.full(len(words), -1), place])


def near_in_partition(group: pa.Table) -> pa.Table:
    """word, near, best_n, best: what one radix partition (key, word, at, n) says of words and their neighbours."""
    key = np.asarray(group["key"])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    met = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    if not len(met):
        return NEAR.empty_table()
    words = group["word"].take(pa.array(met)).to_pylist()
    at, n = np.asarray(group["at"])[met].astype(np.int64), np.asarray(group["n"])[met]
    left = [w if k < 0 else w[:k] + w[k + 1 :] for w, k in zip(words, at.tolist(), strict=True)]
    string = _numbers(left, list(set(left)))  # equal keys count as equal only where the strings are
    ranked = sorted(set(words))
    word = _numbers(words, ranked)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    # Replacements: the words that leave one string at one place.
    k = np.flatnonzero(at >= 0)
    k = k[np.lexsort((word[k], -n[k], at[k], string[k]))]
    head = np.ones(len(k), bool)
    head[1:] = (string[k][1:] != string[k][:-1]) | (at[k][1:] != at[k][:-1])
    lo = np.flatnonzero(head)
    many = np.diff(np.append(lo, len(k)))
    top = np.repeat(lo, many)
    other = np.where(np.arange(len(k)) == top, np.minimum(top + 1, len(k) - 1), top)
    more = np.repeat(many, many) > 1
    out.append((word[k[more]], np.repeat(many, many)[more] - 1, n[k[other[more]]], word[k[other[more]]]))

    # Deletions: the words that leave a string which is itself a word, each counted once.
    itself = np.flatnonzero(at < 0)
    whole = np.full(int(string.max()) + 1, -1)
    whole[string[itself]] = itself
    k = k[whole[string[k]] >= 0]
    k = k[np.lexsort((word[k], -n[k], string[k]))]
    once = np.ones(len(k), bool)
    once[1:] = (string[k][1:] != string[k][:-1]) | (word[k][1:] != word[k][:-1])
    k = k[once]
    centre = whole[string[k]]
    out.append((word[k], np.ones(len(k), np.int64), n[centre], word[centre]))
    head = np.ones(len(k), bool)
    head[1:] = string[k][1:] != string[k][:-1]
    lo = np.flatnonzero(head)
    out.append((word[centre[lo]], np.diff(np.append(lo, len(k))), n[k[lo]], word[k[lo]]))

    who, near, best_n, best = (np.concatenate([o[i] for o in out]) for i in range(4))
    order = np.lexsort((best, -best_n, who))
    who, near, best_n, best = who[order], near[order], best_n[order], best[order]
    lo = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    names = pa.array(ranked, pa.string())
    near = np.add.reduceat(near, lo) if len(lo) else near
    columns = [names.take(pa.array(who[lo])), pa.array(near), pa.array(best_n[lo]), names.take(pa.array(best[lo]))]
    return pa.table(columns, schema=NEAR)


def _numbers(values: list[str], ranked: list[str]) -> np.ndarray:
    """Place of each value in the ranked list, which is sorted by code point."""
    place = dict(zip(ranked, range(len(ranked)), strict=True))
    return np.fromiter((place[v] for v in values), np.int64, len(values))


def neighbours(words: DataFrame, radix_entries: int = RADIX_ENTRIES) -> DataFrame:
    """word, n, n_near, best (near word of largest n, ties to the smallest), best_n; words: word, n, each word once."""
    entries = words.agg(F.coalesce(F.sum(F.length("word") + 1), F.lit(0)).alias("n")).first()["n"]
    bits = max(3, (int(entries) // radix_entries).bit_length())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            key, of, at = deletion_keys(rows.column(0).to_pylist())
            of = pa.array(of)
            radix = (key >> np.uint64(64 - bits)).astype(np.int32)
            columns = [pa.array(radix), pa.array(key.view(np.int64)), rows.column(0).take(of), pa.array(at.astype(np.int32)), rows.column(1).take(of)]
            yield pa.RecordBatch.from_arrays(columns, ["radix", "key", "word", "at", "n"])

    found = words.select("word", "n").mapInArrow(keyed, ENTRY).groupBy("radix")
    found = found.applyInArrow(T.releasing(near_in_partition), "word string, near long, best_n long, best string")
    # The words themselves join in the same grouping, so nothing is joined.
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))
    rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<less:bigint,best:string>").alias("b"))
    rows = rows.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", best.alias("b")))
    per = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("b").alias("b"))
    return per.select("word", "n", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form (word, form): forms followed to the last, each round twice as far."""
    links = cut(forms.select("word", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        further = links.join(on, links["root"] == on["_at"], "left")
        step = further.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        step = cut(step, "spelling-links")
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of words (word, n)."""
    near = neighbours(words)
    is_form = F.col("best_n") >= factor * F.col("n")
    near = near.withColumns({"form": F.when(is_form, F.col("best")), "form_n": F.when(is_form, F.col("best_n"))})
    near = cut(near.drop("best", "best_n"), "spelling-near")
    found = roots(near.where("form is not null"))
    out = near.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, altered: int = ALTERED) -> DataFrame:
    """The contract's rows for a table of documents."""
    return group_variants(cut(word_counts(docs, altered), "spelling-words"))
