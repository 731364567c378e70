"""Token ids in binary files: Simple-8b words, in blocks with offsets.

A 64-bit word holds a selector in its four high bits and in the rest as many ids as fit at that selector's width: 60 of one
bit, 30 of two, down to one of sixty, or 120 zeros without any bits. A value of over 60 bits is an escape: its word names a place
in a list of whole values at the file's end. Each document's ids are cut into blocks of at most BLOCK ids, a block begins with a
new word, and the file lists where, so blocks are decoded all at once, or one without the others: a word's ids lie at
the block's start and the sum of the counts before it.

A file, little-endian: magic, then documents, blocks, words, escapes (four 64-bit numbers); the documents' ids and numbers of
ids; the first word of each block; the words; the escapes; the CRC-32 of all that. Files are written on whatever Arrow can
write to, each under a name of its own; only those whose task succeeded are in the manifest, so a task may run twice.

Documents are dealt by ranges of their ids, so each task has its own stretch of the order, and files of at most FILE_IDS ids
(or one document) follow each other. Ids come from the `tokenizers` library, which is asked once a distinct segment: texts are
cut where its pattern must end a token (behind ASCII letters, digits or marks, before white space or another class of
characters), equal segments are found by 64-bit fingerprints, and a worker keeps the answers (at most KEPT segments).

Defined results: null and empty texts are the end id alone; null doc_ids come first, then ascending ids, equal ids by a
hash of the text; repeated rows are documents of their own; an empty table gives an empty result; further columns are not looked at.
Strings of special tokens in a text become those tokens, as the library has it by default. Texts longer than a slice are read in parts; a
segment (a word of one class of characters) longer than that is handed over whole.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T
from .common import NULL_ID, bucket_count, checkpoint_root, cut, input_bytes, note

#: Where the public vocabularies lie; a parameter of every caller.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
END_ID = 0
#: Ids of a block, ids of a file (a document of more has a file of its own).
BLOCK = 128
FILE_IDS = 1 << 22
#: Blocks that are decoded at once.
AT_ONCE = 1 << 11
#: Segments whose ids a worker keeps; segments that the library is asked for at once, and those of a line.
KEPT, ASKED, LINE = 1 << 20, 1 << 14, 1 << 10

#: An estimate of so many bytes is Spark's word for not knowing.
UNKNOWN = 1 << 60

MAGIC = b"TOKENS8B"
#: Selector -> ids of a word and bits of an id, most ids first. Selector 0 is the escape.
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([1, 120, *(60 // WIDTHS[2:])])
PAYLOAD = np.uint64((1 << 60) - 1)


# -- coding -----------------------------------------------------------------------------------------


def blocks_of(sizes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Starts of the blocks of documents of some sizes, and the end of the last."""
    many = -(-sizes // block)
    first = np.cumsum(many) - many
    inside = np.arange(many.sum()) - np.repeat(first, many)
    return np.append(np.repeat(np.cumsum(sizes) - sizes, many) + inside * block, sizes.sum()).astype(np.int64)


_LENGTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _lengths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return _LENGTHS[values] if values.max() < len(_LENGTHS) else np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def encode(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words, first word of each block, escapes. edges: starts of the blocks (at most BLOCK values each) and the end of the last.

    The best selector of every place comes from the widest value of windows, one byte a value: windows of 2, 4, 8, ... values
    are maxima of two of half the length, others of two that overlap. Then blocks are walked side by side, a word a step.
    """
    values = values.astype(np.uint64)
    n, size = len(values), np.diff(edges)
    many, longest = len(size), int(size.max(initial=0))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(many, np.int64), np.zeros(0, np.uint64)
    wide = longest + int(COUNTS.max())
    bits = np.zeros((many, wide), np.uint8)  # what is beyond a block's end fits anywhere
    bits.ravel()[np.arange(n) + np.repeat(np.arange(many) * wide - edges[:-1], size)] = _lengths(values)
    windows, span = [bits], 1
    while 2 * span <= COUNTS.max():
        half = windows[-1]
        windows.append(np.maximum(half[:, : half.shape[1] - span], half[:, span:]))
        span *= 2
    # Where a selector fits, those of fewer ids do too: the best is told by how many do not.
    best = np.ones((many, longest), np.uint8)
    for s in range(1, len(WIDTHS)):
        power = int(COUNTS[s]).bit_length() - 1
        half, rest = windows[power], int(COUNTS[s]) - (1 << power)
        widest = half[:, :longest] if not rest else np.maximum(half[:, :longest], half[:, rest : rest + longest])
        best += widest > int(WIDTHS[s])
    best[best == len(WIDTHS)] = 0
    flat, row = best.ravel(), np.arange(many)
    here = np.zeros(many, np.int64)
    rows, starts, selectors = [], [], []
    while len(row):
        chosen = flat[row * longest + here]
        rows.append(row)
        starts.append(edges[row] + here)
        selectors.append(chosen)
        here = here + COUNTS[chosen]
        open_ = here < size[row]
        row, here = row[open_], here[open_]
    of = np.concatenate(rows)
    words_of = np.bincount(of, minlength=many)
    first = np.cumsum(words_of) - words_of
    place = first[of] + np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    start, selector = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    start[place], selector[place] = np.concatenate(starts), np.concatenate(selectors)
    # Words follow each other without a gap, so each value's word and its place in it are known.
    held = np.diff(np.append(start, n))
    shift = (np.arange(n, dtype=np.int32) - np.repeat(start.astype(np.int32), held)) * np.repeat(WIDTHS.astype(np.int32)[selector], held)
    lost = np.flatnonzero(selector == 0)
    escapes = values[start[lost]]
    values[start[lost]] = np.arange(len(lost), dtype=np.uint64)
    words = np.add.reduceat(values << shift.astype(np.uint64), start) + (selector.astype(np.uint64) << np.uint64(60))
    return words, first, escapes


def decode(words: np.ndarray, first: np.ndarray, edges: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of blocks: first word of each, starts of the blocks and the end of the last."""
    out = np.empty(int(edges[-1]), np.uint64)
    bounds = np.append(first, len(words))
    for lo in range(0, len(first), AT_ONCE):
        hi = min(lo + AT_ONCE, len(first))
        some = words[bounds[lo] : bounds[hi]]
        out[edges[lo] : edges[hi]] = _decoded(some, bounds[lo:hi] - bounds[lo], edges[lo : hi + 1] - edges[lo], escapes)
    return out


def _decoded(words: np.ndarray, first: np.ndarray, edges: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    selector = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[selector])])
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    start = edges[block] + before[:-1] - before[first][block]
    held = np.minimum(COUNTS[selector], edges[block + 1] - start)
    of = np.repeat(np.arange(len(words)), held)
    shift = (np.arange(int(edges[-1])) - start[of]) * WIDTHS[selector][of]
    mask = (np.uint64(1) << WIDTHS[selector].astype(np.uint64)) - np.uint64(1)
    out = (words[of] >> shift.astype(np.uint64)) & mask[of]
    lost = selector == 0
    out[start[lost]] = escapes[(words[lost] & PAYLOAD).astype(np.int64)]
    return out


# -- files ------------------------------------------------------------------------------------------


def to_bytes(doc_ids: np.ndarray, sizes: np.ndarray, first: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> bytes:
    head = np.array([len(doc_ids), len(first), len(words), len(escapes)], "<u8")
    parts = [MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), first.astype("<u8").tobytes()]
    data = b"".join([*parts, words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()])
    return data + zlib.crc32(data).to_bytes(4, "little")


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, sizes, ids of a file; ValueError where it is not whole."""
    body = memoryview(data)[:-4]
    if bytes(body[:8]) != MAGIC or zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
        raise ValueError("not a whole token file")
    docs, blocks, words, escapes = np.frombuffer(body, "<u8", 4, 8).astype(np.int64).tolist()
    kinds, at, found = (("<i8", docs), ("<i8", docs), ("<u8", blocks), ("<u8", words), ("<u8", escapes)), 40, []
    for kind, n in kinds:
        found.append(np.frombuffer(body, kind, n, at))
        at += 8 * n
    doc_ids, sizes, first, packed, lost = found
    return doc_ids, sizes, decode(packed, first.astype(np.int64), blocks_of(sizes), lost)


def _place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder; Hadoop writes URIs of local files with one slash."""
    if folder.startswith("file:"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


# -- ids --------------------------------------------------------------------------------------------

_KIND = np.zeros(256, np.int8)  # 0: no ASCII letter or digit
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2
_SPACE = ~T.SPACE_CLASS
_MARK = np.zeros(256, bool)  # visible ASCII
_MARK[0x21:0x7F] = True


class Answers:
    """Ids of segments by their fingerprints."""

    def __init__(self, key=(), at=(), many=(), ids=()):
        self.key, self.ids = np.asarray(key, np.uint64), np.asarray(ids, np.uint32)
        self.at, self.many = np.asarray(at, np.int64), np.asarray(many, np.int64)
        self._places = pd.Index(self.key)

    def find(self, key: np.ndarray) -> np.ndarray:
        return self._places.get_indexer(key) if len(self.key) else np.full(len(key), -1)

    def with_(self, more: Answers) -> Answers:
        pairs = ((self.key, more.key), (self.at, more.at + len(self.ids)), (self.many, more.many), (self.ids, more.ids))
        return Answers(*map(np.concatenate, pairs))


class Segments:
    """Ids of texts by the library, which is asked once for each distinct segment."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.longest = max(map(len, self.special), default=0)
        made = json.loads(self.tokenizer.to_str())
        pattern = made.get("pre_tokenizer") or {}
        known = pattern.get("type") == "ByteLevel" and pattern.get("use_regex") and not pattern.get("add_prefix_space")
        #: Whether this is the pattern that cuts() knows; texts of other vocabularies are segments as they are.
        self.by_bytes = bool(known and made["model"]["type"] == "BPE" and not made.get("normalizer"))
        #: Bytes that each id stands for: one a character of its name.
        self.widths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.widths[i] = len(name)
        self.stored, self.recent = Answers(), Answers()

    def cuts(self, buf: np.ndarray) -> np.ndarray:
        """True at bytes before which the library's pattern always ends a token.

        It never joins white space to what is before it, nor an ASCII letter or digit to a following ASCII character of another
        kind. What precedes a cut is visible ASCII or a letter of U+00C0 to U+00FF, so never white space.
        """
        out = np.zeros(len(buf), bool)
        if len(buf) < 2 or not self.by_bytes:
            return out
        a, b = buf[:-1], buf[1:]
        seen = _MARK[a]
        seen[1:] |= buf[:-2] == 0xC3
        kind = _KIND[a]
        out[1:] = (seen & _SPACE[b]) | ((kind > 0) & (b < 0x80) & (_KIND[b] != kind))
        text = None
        for token in self.special:  # a special token stays in one segment
            text = buf.tobytes() if text is None else text
            at = text.find(token)
            while at >= 0:
                out[at + 1 : at + len(token)] = False
                at = text.find(token, at + 1)
        return out

    def _ask(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each segment's begin, how many they are).

        Segments that begin with a blank and end visibly are asked for in lines: between them is a cut, so a line's ids are
        theirs one after the other, told apart by the bytes that each id stands for. Others are asked for alone.
        """
        text = buf.tobytes()
        joint = (buf[starts] == 0x20) & (ends - starts < 256) & (_MARK[buf[ends - 1]] | (buf[np.maximum(ends - 2, 0)] == 0xC3))
        if not self.by_bytes or any(token in text for token in self.special):
            joint[:] = False
        at, many, ids, base = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64), [], 0
        alone = [np.flatnonzero(~joint)]
        lined = np.flatnonzero(joint)
        for lo in range(0, len(lined), LINE):
            of = lined[lo : lo + LINE]
            line = b"".join([text[a:b] for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)]).decode()
            found = np.array(self.tokenizer.encode(line, add_special_tokens=False).ids, np.uint32)
            reached, stop = np.cumsum(self.widths[found]), np.cumsum(ends[of] - starts[of])
            last = np.searchsorted(reached, stop)
            if len(last) and (last[-1] != len(found) - 1 or (reached[last] != stop).any()):
                alone.append(of)  # an id across a cut: this vocabulary is not what it seems
                continue
            many[of] = np.diff(last, prepend=-1)
            at[of] = base + last + 1 - many[of]
            ids.append(found)
            base += len(found)
        rest = np.concatenate(alone)
        for lo in range(0, len(rest), ASKED):
            of = rest[lo : lo + ASKED]
            texts = [text[a:b].decode() for a, b in zip(starts[of].tolist(), ends[of].tolist(), strict=True)]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            many[of] = np.fromiter(map(len, found), np.int64, len(found))
            at[of] = base + np.cumsum(many[of]) - many[of]
            ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(many[of].sum())))
            base += len(ids[-1])
        return np.concatenate(ids), at, many

    def encode(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each segment) of the segments of a buffer that begin at `starts`."""
        ends = np.append(starts[1:], len(buf))
        terms = T.BYTE_CODES[buf]
        terms *= T.powers(T.BASE, len(buf))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        key = T.span_hashes(total, starts, ends)
        at, many = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        open_, pools, base = np.arange(len(key)), [], 0
        for held in (self.stored, self.recent):
            place = held.find(key[open_])
            hit = place >= 0
            at[open_[hit]], many[open_[hit]] = base + held.at[place[hit]], held.many[place[hit]]
            pools.append(held.ids)
            base += len(held.ids)
            open_ = open_[~hit]
        if len(open_):
            of, new = pd.factorize(key[open_])
            one = np.empty(len(new), np.int64)
            one[of[::-1]] = open_[::-1]
            ids, first, sizes = self._ask(buf, starts[one], ends[one])
            at[open_], many[open_] = base + first[of], sizes[of]
            pools.append(ids)
            self._keep(Answers(new, first, sizes, ids))
        begin = np.cumsum(many) - many
        index = np.repeat(at - begin, many) + np.arange(many.sum())
        return np.concatenate(pools)[index], many

    def _keep(self, new: Answers) -> None:
        """New answers join the recent ones, and those the stored ones when they are many, so that look-up tables are seldom made anew."""
        if sum(len(a.key) for a in (self.stored, self.recent, new)) > KEPT or len(self.stored.ids) + len(self.recent.ids) + len(new.ids) > 8 * KEPT:
            return
        self.recent = self.recent.with_(new)
        if len(self.recent.key) > len(self.stored.key) // 4:
            self.stored, self.recent = self.stored.with_(self.recent), Answers()


_BUILT: dict[str, Segments] = {}


def segments_of(path: str) -> Segments:
    """The worker's one for a vocabulary. A function of the module, so that it is the module's and outlives a task."""
    if path not in _BUILT:
        _BUILT.clear()
        _BUILT[path] = Segments(path)
    return _BUILT[path]


def _ids(made: Segments, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each text) of the texts of a slice; a long one is read in parts that end at a cut."""
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    if len(buf) <= T.SLICE_BYTES:
        begins = made.cuts(buf)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ids, many = made.encode(buf, starts)
        total = np.concatenate([[0], np.cumsum(many)])
        return ids, np.diff(total[np.searchsorted(starts, offsets)])
    out, sizes = [], np.zeros(n, np.int64)
    for k in range(n):
        lo, stop = int(offsets[k]), int(offsets[k + 1])
        size = T.SLICE_BYTES
        while lo < stop:
            hi = min(stop, lo + size)
            begins = made.cuts(buf[lo:hi])
            if hi < stop:  # the last segment may go on, and a special token may begin shortly before the part's end
                last = np.flatnonzero(begins[: max(0, hi - lo - made.longest)])
                if not len(last):
                    size *= 2
                    continue
                hi = lo + int(last[-1])
                begins = begins[: hi - lo]
            begins[0] = True
            ids, many = made.encode(buf[lo:hi], np.flatnonzero(begins))
            out.append(ids)
            sizes[k] += len(ids)
            lo, size = hi, T.SLICE_BYTES
    return np.concatenate(out), sizes


MANIFEST = "part int, nth int, file string, docs long, ids long, bytes long"


def write_tokens(docs: DataFrame, folder: str, path: str = VOCABULARY, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts below a folder, in ascending order of doc_id; the manifest: part, nth, file, docs, ids, bytes.

    The folder's file system is one that Arrow can write to and all executors reach.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, nth = segments_of(path), 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth
            doc_ids, sizes, firsts, words, escapes = zip(*held, strict=True)
            shift, lost, first, packed = 0, 0, [], []
            for f, w, e in zip(firsts, words, escapes, strict=True):
                if lost and len(e):  # places of escapes are those of the file
                    w = np.where(w >> np.uint64(60) == 0, w + np.uint64(lost), w)
                first.append(f + shift)
                packed.append(w)
                shift, lost = shift + len(w), lost + len(e)
            join = np.concatenate
            size = join(sizes)
            data = to_bytes(join(doc_ids), size, join(first), join(packed), join(escapes))
            name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.tok"
            system, where = _place(folder)
            system.create_dir(where, recursive=True)
            with system.open_output_stream(f"{where}/{name}") as out:
                out.write(data)
            row = {"part": part, "nth": nth, "file": name, "docs": len(size), "ids": int(size.sum()), "bytes": len(data)}
            nth += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        part, waiting = 0, 0
        for rows, buf, offsets, _ in T.slices(batches, size=min(T.SLICE_BYTES, file_ids)):  # a byte is an id at most
            part = rows.column(2)[0].as_py()
            ids, sizes = _ids(made, buf, offsets)
            if end_id is not None:
                ends = np.cumsum(sizes)
                ids, sizes = np.insert(ids, ends, np.uint32(end_id)), sizes + 1
            edges = blocks_of(sizes)
            if waiting and waiting + len(ids) > file_ids:
                yield flush()
                waiting = 0
            words, first, escapes = encode(ids, edges)
            held.append((T.ints(rows.column(0)), sizes, first, words, escapes))
            waiting += len(ids)
        if held:
            yield flush()

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    d = docs.select(key.alias("doc_id"), F.col("text"))
    d = d.withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    keys = ["doc_id", "_hash", "_tie"]
    # Parts follow the input's size; where Spark knows none, they are as many as its shuffles have.
    parts = [bucket_count(docs)] if input_bytes(docs) < UNKNOWN else []
    dealt = d.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
    return cut(dealt.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, MANIFEST), "token-manifest")


_MANIFEST = pa.schema([
    ("part", pa.int32()), ("nth", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()),
])


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with start: the ids of all files before. Files are summed within their part, parts (a row a task) in order."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("_ids"))
    before = F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("_before"))
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("_inside", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    return files.join(parts, "part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest, decoded from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = _place(folder)
        for rows in batches:
            for file, start in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{where}/{file}") as f:
                    doc_ids, sizes, ids = from_bytes(f.read())
                data = memoryview(ids.astype("<u4").tobytes())
                edges = np.concatenate([[0], np.cumsum(sizes)])
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                known = pa.array(doc_ids, mask=doc_ids == NULL_ID)
                columns = [known, pa.array(start + edges[:-1]), pa.array(sizes), pa.array(sums, pa.int64())]
                del data, ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])
                T.release()

    files = located(manifest).select("file", "start")
    tasks = max(1, min(1 << 14, files.count()))
    return files.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """The contract's rows: the table's ids are written below a folder and read back from there."""
    spark = docs.sparkSession
    if folder is None:
        folder = f"{checkpoint_root(spark)}/tokens-{uuid.uuid4().hex}"
        note(folder)
    return read_tokens(write_tokens(docs, folder, path), folder)
