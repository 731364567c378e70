"""N-gram Jaccard self-join by vertical partitioning.

A document's set is its distinct word 5-grams. The global n-gram order is cut
into fragments (ranges of n-gram fingerprints); every document's set is cut with it, and each
fragment is treated apart:

1. In its fragment an n-gram that occurs in one distinct set only is dropped: it can
   match nothing. Exact copies are one set from the start. What is left of a set is
   gathered; sets that keep under 80 % of their n-grams link with nothing.
2. The order of the rest is: fingerprints, then the most frequent n-grams
   (a list of bounded size) by frequency. Two sets that link share an n-gram of
   their prefixes in that order, n-grams of step 1 counted first.
3. Candidate pairs are counted per fragment, and the partial overlaps summed per pair.
   First each set meets one leader (the set of a prefix n-gram that has fewest n-grams of its own), so a
   large group of near copies costs one pair a set; then only sets of still
   different components that share a prefix n-gram are compared, where the n-grams that they share
   with any other set, and parity maps of these n-grams, allow the similarity at all.

Blocks, not rows, go through the exchange of step 1: a slice of documents sends each
fragment one row of packed 48-bit fingerprints, by places within the slice. N-grams that many documents of a slice
share are sent once with a count. A false match of two fingerprints within one pair of sets has
probability under 1e-8 for sets of a thousand n-grams.

Defined results: null or empty texts have empty sets and link with nothing; fewer words than n: the
whole sequence is the one n-gram; a null doc_id takes part, sorts first and is given back as null;
rows that repeat are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange
from . import textkit as T
from .common import NULL_ID, bucket_count, cut, small

N = 5
SIMILAR, OF = 80, 100
#: N-grams that so many sets of a slice share go out once for the slice.
LOCAL_HOT = 12
#: Frequent n-grams that come last in the order: at most so many (a 2 MB broadcast), each in at least so many sets.
HEAVY, HEAVY_DF = 1 << 17, 32
#: Ranges of the n-gram order in which the overlaps of a pair are counted apart.
FRAGMENTS = 4
SLICE = (2 << 20) - 64
#: Input bytes of one fragment; its packed n-grams and their sorted copies must fit a worker's memory.
FRAGMENT_BYTES = 7 << 20
#: Bits of a set's parity map: the least number of n-grams in which two sets differ is the number of bits in which their maps do.
MAP_BITS = 512
#: Parts in which a fragment is worked off, one after the other; bounds a worker's memory.
PARTS = 8

#: kind 0: n-grams of one fragment in one slice; 1: the slice's sets (ids, two fingerprints of the texts, a and b of the sets, sizes); 2: its hot n-grams by set.
_BLOCK_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("slice", pa.int64()), *[(c, pa.binary()) for c in ("ids", "prints", "sets", "sizes", "which", "counts", "tokens", "hot", "hot_counts")]])
_BLOCK = "kind int, bucket int, slice long, ids binary, prints binary, sets binary, sizes binary, which binary, counts binary, tokens binary, hot binary, hot_counts binary"
#: kind 0: packed answers; 1: as above; 3: a frequent n-gram (slice: the n-gram, times: its sets).
_PIECE_SCHEMA = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("times", pa.int64()), ("ids", pa.binary()), ("prints", pa.binary()), ("sets", pa.binary()), ("sizes", pa.binary()), *exchange.SCHEMA])
_PIECE = "kind int, slice long, times long, ids binary, prints binary, sets binary, sizes binary, " + exchange.FIELDS
_LOW48 = np.uint64((1 << 48) - 1)


def pack48(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(b: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(document index, 48-bit n-gram fingerprint), distinct and sorted."""
    words = T.Words(buf, offsets, T.SPACE_CLASS)
    h = words.hashes(lower=True)
    counts = np.diff(words.first)
    ok = T.span_ok(words, n)
    doc, gram = [words.doc[ok]], [T.ngram_hashes(h, n)[ok]]
    for k in range(1, n):
        few = np.flatnonzero(counts == k)
        if len(few):
            doc.append(few)
            gram.append(T.ngram_hashes(h, k, seed=k)[words.first[few]])
    key = np.sort((np.concatenate(doc).astype(np.uint64) << np.uint64(48)) | (np.concatenate(gram) >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(48)).astype(np.int64), key & _LOW48


def _small_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of at most 65,536 rows, which the packed keys allow."""
    for rows, buf, offsets, _ in T.slices(batches, size=SLICE):
        for lo in range(0, rows.num_rows, 1 << 16):
            part = rows.slice(lo, 1 << 16)
            o = offsets[lo : lo + part.num_rows + 1]
            yield part, buf[o[0] : o[-1]], o - o[0]


def _fragments(buckets: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets in _small_slices(batches):
            doc, token = shingle_sets(buf, offsets, n)
            size = np.bincount(doc, minlength=rows.num_rows)
            first = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(token ^ np.uint64(s)))]) for s in (0x51AB3C5D9E7F1021, 0x1F83D9ABFB41BD6B)]
            a, b = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
            ids = np.asarray(rows.column(0).cast(pa.int64()).fill_null(NULL_ID))
            places = np.arange(len(ids), dtype=np.uint64)
            name = int((T.mix(a.view(np.uint64) + places) ^ T.mix(b.view(np.uint64) + ids.view(np.uint64) * np.uint64(3))).sum(dtype=np.uint64).view(np.int64))
            home = name % buckets
            out: dict[str, list] = {c: [] for c in _BLOCK_SCHEMA.names}

            def row(**values):
                for c in _BLOCK_SCHEMA.names:
                    out[c].append(values.get(c))

            prints = np.stack([np.asarray(rows.column(c)) for c in (1, 2)], 1)
            row(kind=1, bucket=home, slice=name, ids=ids.astype("<i8").tobytes(), prints=prints.astype("<i8").tobytes(), sets=np.stack([a, b], 1).astype("<i8").tobytes(), sizes=size.astype("<i4").tobytes())
            # One of the slice's equal sets speaks for all.
            _, one = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
            speaks = np.zeros(len(ids), bool)
            speaks[one] = True
            keep = speaks[doc]
            doc, token = doc[keep], token[keep]
            ordered = np.sort(token)
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)
            runs = np.diff(edge)
            often, often_n = ordered[edge[:-1][runs >= LOCAL_HOT]], runs[runs >= LOCAL_HOT]
            del ordered
            is_hot = np.zeros(len(token), bool)
            if len(often):
                is_hot = often[np.minimum(np.searchsorted(often, token), len(often) - 1)] == token
                which, counts = np.unique(doc[is_hot], return_counts=True)
                row(kind=2, bucket=home, slice=name, which=which.astype("<u2").tobytes(), counts=counts.astype("<u4").tobytes(), tokens=pack48(token[is_hot]))
            doc, token = doc[~is_hot], token[~is_hot]
            bucket = _fragment_of(token, buckets)
            order = np.argsort(bucket, kind="stable")
            doc, token = doc[order], token[order]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            often_ends = np.searchsorted(_fragment_of(often, buckets), np.arange(buckets + 1))
            for f in np.flatnonzero((np.diff(ends) > 0) | (np.diff(often_ends) > 0)).tolist():
                lo, hi = ends[f], ends[f + 1]
                step = np.flatnonzero(np.concatenate([[True], doc[lo + 1 : hi] != doc[lo : hi - 1]])) if hi > lo else np.zeros(0, np.int64)
                x, y = often_ends[f], often_ends[f + 1]
                row(kind=0, bucket=f, slice=name, which=doc[lo:hi][step].astype("<u2").tobytes(), counts=np.diff(np.append(step, hi - lo)).astype("<u4").tobytes(), tokens=pack48(token[lo:hi]), hot=pack48(often[x:y]), hot_counts=often_n[x:y].astype("<i4").tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=_BLOCK_SCHEMA)

    return run


def _fragment_of(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _piece(kind: int, rows: int, **columns) -> pa.Table:
    """rows of one kind; columns that are not given are null."""
    columns["kind"] = pa.array(np.full(rows, kind, np.int32))
    return pa.table([columns.get(f.name, pa.nulls(rows, f.type)) for f in _PIECE_SCHEMA], schema=_PIECE_SCHEMA)


def _in_fragment(groups: int):
    """N-grams of one fragment that at least two sets hold, packed for the sets' slices; slices' own rows go through; frequent n-grams."""

    def answers(rows: pa.Table, keep: np.ndarray | None, token: np.ndarray) -> pa.Table:
        """Packed entries of rows with slice, which and counts; keep: of the tokens."""
        which = [np.frombuffer(x, "<u2") for x in rows["which"].to_pylist()]
        slice_ = np.repeat(np.asarray(rows["slice"]), [len(x) for x in which])
        of = np.repeat(np.arange(len(slice_)), np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4"))
        if keep is not None:
            of, token = of[keep], token[keep]
        owners = np.stack([slice_, np.concatenate(which).astype(np.int64) if which else np.zeros(0, np.int64), np.zeros(len(slice_), np.int64)], 1)
        t = exchange.pack(owners, of, token, groups, pack48, by_first=True)
        return _piece(0, len(t), **{c: t[c] for c in t.column_names})

    def run(group: pa.Table) -> pa.Table:
        kind = np.asarray(group["kind"])
        own = group.filter(pa.array(kind == 1))
        g = exchange.group_of(np.stack([np.asarray(own["slice"]), np.zeros(len(own), np.int64)], 1), groups)
        parts = [_piece(1, len(own), slice=own["slice"], ids=own["ids"], prints=own["prints"], sets=own["sets"], sizes=own["sizes"], g=pa.array(g.astype(np.int32)))]
        hot_rows = group.filter(pa.array(kind == 2))
        parts.append(answers(hot_rows, None, unpack48(b"".join(hot_rows["tokens"].to_pylist()))))
        blocks = group.filter(pa.array(kind == 0))
        del group
        token, hot = unpack48(b"".join(blocks["tokens"].to_pylist())), unpack48(b"".join(blocks["hot"].to_pylist()))
        hot_n = np.frombuffer(b"".join(blocks["hot_counts"].to_pylist()), "<i4").astype(np.int64)
        hot_u, at = np.unique(hot, return_inverse=True)
        hot_df = np.bincount(at, weights=hot_n, minlength=len(hot_u)).astype(np.int64)
        shared = np.zeros(len(token), bool)
        part = (token & np.uint64(PARTS - 1)).astype(np.uint8)
        frequent, times = [hot_u], [hot_df]
        for k in range(PARTS):
            at = np.flatnonzero(part == k)
            value, inverse, df = np.unique(token[at], return_inverse=True, return_counts=True)
            if not len(value):
                continue
            many = df > 1
            if len(hot_u):
                near = np.minimum(np.searchsorted(hot_u, value), len(hot_u) - 1)
                many |= hot_u[near] == value
            shared[at] = many[inverse]
            frequent.append(value[df >= HEAVY_DF])
            times.append(df[df >= HEAVY_DF])
        parts.append(answers(blocks, shared, token))
        value, inverse = np.unique(np.concatenate(frequent), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(value)).astype(np.int64)
        parts.append(_piece(3, len(value), slice=pa.array(value.astype(np.int64)), times=pa.array(total)))
        return pa.concat_tables(parts)

    return T.releasing(run)


def _assemble(heavy, similar: int, of: int):
    """Whole sets of a group of slices from their fragments: order, prefix; sets that cannot link are left out."""

    def run(group: pa.Table) -> pa.Table:
        h_token, h_df = heavy.value
        kind = np.asarray(group["kind"])
        own = group.filter(pa.array(kind == 1))
        sets = {s: (np.frombuffer(x, "<i8").reshape(-1, 2), np.frombuffer(y, "<i4")) for s, x, y in zip(own["slice"].to_pylist(), own["sets"].to_pylist(), own["sizes"].to_pylist(), strict=True)}
        owners, first, values = exchange.unpack(group.filter(pa.array(kind == 0)), unpack48)
        out: dict[str, list] = {"a": [], "b": [], "n": [], "tokens": [], "prefix": [], "bits": []}
        for (name, k, _), lo, hi in zip(owners.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            (a, b), n = sets[name][0][k].tolist(), int(sets[name][1][k])
            need = -(-similar * n // of)
            if hi - lo < need:
                continue
            t = np.unique(values[lo:hi])
            if len(t) < need:
                continue
            if len(h_token):
                at = np.minimum(np.searchsorted(h_token, t), len(h_token) - 1)
                t = t[np.argsort(np.where(h_token[at] == t, h_df[at], 0), kind="stable")]
            out["a"].append(a)
            out["b"].append(b)
            out["n"].append(n)
            out["tokens"].append(t.astype(np.int64))
            out["prefix"].append(t[: n - need + 1 - (n - len(t))].astype(np.int64))
            parity = np.bincount((t & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1
            out["bits"].append(np.packbits(parity.astype(np.uint8)).view(np.int64))
        longs = pa.list_(pa.int64())
        return pa.table([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["n"], pa.int32()), *[pa.array(out[c], longs) for c in ("tokens", "prefix", "bits")]], names=list(out))

    return T.releasing(run)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's documents: id, size, set and fingerprints of the text."""
    for batch in batches:
        for ids, prints, sets, sizes in zip(*(batch.column(c).to_pylist() for c in ("ids", "prints", "sets", "sizes")), strict=True):
            s, p = (np.frombuffer(x, "<i8").reshape(-1, 2) for x in (sets, prints))
            columns = [np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4"), s[:, 0], s[:, 1], p[:, 0], p[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc", "n", "a", "b", "p", "q"])


def _links(pairs: DataFrame, sets: DataFrame, similar: int, of: int) -> DataFrame:
    """Of the pairs (u, nu, v, nv), those whose overlaps, counted per fragment and summed, reach the similarity."""
    fragment = F.expr(f"transform(sequence(0, {FRAGMENTS - 1}), f -> struct(f, filter(tokens, x -> shiftright(x * {FRAGMENTS}, 48) = f) as part))")
    parts = sets.select("u", F.explode(fragment).alias("x")).select("u", "x.f", "x.part").where("size(part) > 0")
    mine, other = parts.select("u", "f", F.col("part").alias("pu")), parts.select(F.col("u").alias("v"), "f", F.col("part").alias("pv"))
    partial = pairs.join(mine, "u").join(other, ["v", "f"]).select("u", "v", "nu", "nv", F.size(F.array_intersect("pu", "pv")).alias("common"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("common").alias("common"))
    return total.where(f"{of} * common >= {similar} * (nu + nv - common)").select("u", "v")


def components(links: DataFrame, what: str = "labels", most_rounds: int = 200) -> DataFrame:
    """(u, root) for every node of the links: smallest node reachable, by least labels and pointer jumping; each round is cut.

    Labels, a row a node, are broadcast while they are few, so that a node of very many links is not one task's; beyond that the
    planner splits what is skewed.
    """
    edges = cut(links.select("u", "v").union(links.select("v", "u")).distinct(), f"{what}-edges")
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), what)
    for _ in range(most_rounds):
        held = small(labels)
        near = edges.join(held.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("seen"))
        step = cut(labels.join(near, "u").select("u", F.col("root").alias("old"), F.least("root", "seen").alias("root")), what)
        jump = small(step).select(F.col("u").alias("root"), F.col("root").alias("next"))
        new = cut(step.join(jump, "root").select("u", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("moved")), what)
        labels = new.select("u", "root")
        if new.where("moved").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")


def _fits(similar: int, of: int, u: str = "u", v: str = "v") -> Column:
    """Whether sets of sizes nu and nv can link: they share at most the n-grams that mu and mv of them share with any other set."""
    shared = f"least(m{u}, m{v})"
    return F.expr(f"{of} * {shared} >= {similar} * (n{u} + n{v} - {shared})")


def _may_link(similar: int, of: int) -> Column:
    """As _fits, with the parity maps: n-grams that differ at least leave fewer to share."""
    apart = "aggregate(zip_with(bitsu, bitsv, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    shared = f"least(mu, mv, (mu + mv - {apart}) div 2)"
    return F.expr(f"{of} * {shared} >= {similar} * (nu + nv - {shared})")


def text_prints() -> list[Column]:
    """p and q: 128 bits that name a row's text."""
    return [F.xxhash64("text").alias("p"), F.xxhash64(F.lit(1), "text").alias("q")]


def similar_sets(docs: DataFrame, n: int = N, similar: int = SIMILAR, of: int = OF) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc (NULL_ID for null), n, u, the set's identity, and p and q, fingerprints of the text; links has pairs of linked sets
    that span all components (every component of the link graph is connected by them)."""
    spark = docs.sparkSession
    buckets = bucket_count(docs, FRAGMENT_BYTES)
    blocks = docs.select("doc_id", *text_prints(), "text").mapInArrow(_fragments(buckets, n), _BLOCK)
    pieces = cut(blocks.groupBy("bucket").applyInArrow(_in_fragment(buckets), _PIECE), "join-pieces")
    members = pieces.where("kind = 1").select("ids", "prints", "sets", "sizes").mapInArrow(_members, "doc long, n int, a long, b long, p long, q long")
    members = members.select("doc", "n", F.struct("a", "b").alias("u"), "p", "q")
    heavy = pieces.where("kind = 3").select(F.col("slice").alias("token"), F.col("times").alias("df")).orderBy(F.col("df").desc(), "token").limit(HEAVY).toArrow()
    t = np.asarray(heavy["token"]).astype(np.uint64)
    order = np.argsort(t)
    held = spark.sparkContext.broadcast((t[order], np.asarray(heavy["df"])[order]))
    whole = pieces.where("kind in (0, 1)").groupBy("g").applyInArrow(_assemble(held, similar, of), "a long, b long, n int, tokens array<long>, prefix array<long>, bits array<long>")
    # Equal sets of several slices are one set.
    whole = whole.groupBy(F.struct("a", "b").alias("u")).agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("tokens", "prefix", "bits")])
    sets = cut(whole, "join-sets")
    # Of two sets, the smaller needs only its first n-grams, up to `short`, to meet the larger one's prefix (sizes in n, then identity).
    short = F.expr(f"n - cast(ceil(2 * {similar} * n / ({similar} + {of})) as int) + 1 - (n - size(tokens))")
    prefix = sets.select(F.posexplode("prefix").alias("at", "token"), "u", "n", F.size("tokens").alias("m"), short.alias("short")).select("token", "u", "n", "m", (F.col("at") < F.col("short")).alias("early"))
    # A token's leader: the set with fewest n-grams of its own, as an original has among its copies. Each set is held against the leader it meets most often.
    leaders = prefix.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "u", "n", "m")).alias("l"), F.count("*").alias("c")).where("c > 1").select("token", F.col("l.u").alias("u"), F.col("l.n").alias("nu"), F.col("l.m").alias("mu"))
    met = prefix.select("token", F.col("u").alias("v"), F.col("n").alias("nv"), F.col("m").alias("mv")).join(leaders, "token").where("u <> v").where(_fits(similar, of))
    met = met.groupBy("u", "nu", "v", "nv").count()
    pairs = met.groupBy("v").agg(F.max(F.struct("count", "u", "nu", "nv")).alias("x")).select(F.col("x.u").alias("u"), F.col("x.nu").alias("nu"), "v", F.col("x.nv").alias("nv"))
    pairs = cut(pairs, "join-pairs")
    links = cut(_links(pairs, sets, similar, of), "join-links")
    roots = components(links, "join-roots")
    # Sets of different components that share a prefix n-gram.
    placed = cut(prefix.join(roots, "u", "left").select("token", "u", "n", "m", "early", F.coalesce("root", "u").alias("root")), "join-placed")
    # Each n-gram's most frequent component is left; its other sets are held against all.
    sizes = placed.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("token", "most")
    here = cut(placed.join(sizes, "token").join(sets.select("u", "bits"), "u").select("token", "u", "n", "m", "early", "root", "bits", (F.col("root") != F.col("most")).alias("apart")), "join-mixed")
    side = lambda x: [F.col("token"), *[F.col(c).alias(f"{c}{x}" if c != "u" else x) for c in ("root", "early", "apart", "u", "n", "m", "bits")]]
    more = here.where("apart").select(*side("u")).join(here.select(*side("v")), "token").where("rootu <> rootv and (not apartv or u < v)")
    more = more.where("case when nu < nv or (nu = nv and u < v) then earlyu else earlyv end").where(_fits(similar, of)).where(_may_link(similar, of))
    tried = pairs.select("u", "v").union(pairs.select("v", "u"))
    more = cut(more.select("u", "nu", "v", "nv").distinct().join(tried, ["u", "v"], "left_anti"), "join-more")
    late = cut(_links(more, sets, similar, of), "join-late")
    return members, links.unionByName(late)


def join_components(docs: DataFrame, n: int = N, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    members, links = similar_sets(docs, n, similar, of)
    back = lambda c: F.when(F.col(c) != F.lit(NULL_ID), F.col(c))
    per_set = members.where("n > 0").groupBy("u").agg(F.min("doc").alias("least"))
    placed = cut(per_set.join(components(links, "join-final"), "u", "left").withColumn("root", F.coalesce("root", "u")), "join-placed-sets")
    # Sets of a component of their own need no join; a component's least id is broadcast while components are few.
    shared = cut(placed.where("u <> root").select("root").distinct(), "join-shared")
    least = cut(placed.join(small(shared), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component")), "join-least")
    per_set = placed.join(small(least), "root", "left").select("u", F.coalesce("component", "least").alias("least"))
    out = members.join(per_set, "u", "left")
    return out.select(back("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, back("doc")).otherwise(back("least")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, similar: int = SIMILAR, of: int = OF) -> DataFrame:
    """docs with one row of each component of linked texts: that of the smallest doc_id, null last, and of the smallest text
    fingerprint among rows of one doc_id; of rows that repeat it entirely in both, one stays.

    Rows without words stay as they are. Only ids and fingerprints are joined and counted; the rows themselves meet the list of
    those to leave out once, by a broadcast while it is short.
    """
    members, links = similar_sets(docs, n, similar, of)
    members = cut(members.where("n > 0").drop("n").withColumn("doc", F.when(F.col("doc") != F.lit(NULL_ID), F.col("doc"))), "join-members")
    roots = components(links, "join-final")
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "p", "q")
    per_set = members.groupBy("u").agg(F.min(row).alias("first")).join(small(roots), "u", "left").withColumn("root", F.coalesce("root", "u"))
    per_set = cut(per_set, "join-sets-roots")
    # Sets whose component's first row is another set's lose all their rows; the others all but the first.
    linked = per_set.join(small(cut(roots.select("root").distinct(), "join-root")), "root", "left_semi")
    least = cut(linked.groupBy("root").agg(F.min("first").alias("least")), "join-least")
    behind = linked.join(small(least), "root").where("first > least").select("u")
    behind = cut(behind, "join-behind")
    lost = members.join(small(behind), "u", "left_semi").select("doc", "p", "q")
    firsts = per_set.join(small(behind), "u", "left_anti").select("u", "first")
    copies = members.groupBy("u").count().where("count > 1").select("u")
    others = members.join(small(cut(copies, "join-copies")), "u", "left_semi").join(firsts, "u").where(~row.eqNullSafe(F.col("first"))).select("doc", "p", "q")
    gone = cut(lost.unionByName(others).distinct(), "join-gone")
    twice = members.groupBy("doc", "p", "q").count().where("count > 1").select("doc", "p", "q")
    stays = twice["doc"].eqNullSafe(gone["doc"]) & (twice["p"] == gone["p"]) & (twice["q"] == gone["q"])
    again = cut(twice.join(small(gone), stays, "left_anti"), "join-again")
    doc, p, q = F.col("_doc"), F.col("_p"), F.col("_q")
    same = lambda t: doc.eqNullSafe(t["doc"]) & (p == t["p"]) & (q == t["q"])
    # The row travels as one struct, so no column of the caller can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), *[c.alias(f"_{x}") for c, x in zip(text_prints(), "pq", strict=True)])
    left = whole.join(small(gone), same(gone), "left_anti")
    if again.limit(1).count():
        copies = left.join(small(again), same(again), "left_semi")
        nth = F.row_number().over(Window.partitionBy("_doc", "_p", "_q").orderBy(F.xxhash64("_row")))
        once = copies.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
        left = left.join(small(again), same(again), "left_anti").unionByName(once)
    return left.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def prefix_length(size: int, similar: int = SIMILAR, of: int = OF) -> int:
    return size - math.ceil(similar * size / of) + 1
