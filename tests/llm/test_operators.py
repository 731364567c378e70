"""The corpus operators against brute force, on small tables with nulls, ties, repeats, long texts and extra columns."""

import hashlib
import json
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import ann, chat_format, common, decontaminate, ngram_join, pii, quality, substring_dedup, textkit, token_counts, token_mix, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def make_docs(seed=1, n=120):
    """Documents with copies, near copies, shared passages, odd white space, nulls and long words."""
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdeéßö😀XY") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = [r.choice(lexicon) for _ in range(30)]
    texts = []
    for k in range(n):
        if k > 10 and r.random() < 0.15:
            texts.append(r.choice(texts))
            continue
        if k > 10 and r.random() < 0.3 and len(w := words(r.choice(texts))) > 5:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(lexicon)
        else:
            w = [r.choice(lexicon) for _ in range(r.choice([0, 1, 3, 4, 5, 19, 20, 21, 60, 150]))]
        if r.random() < 0.4:
            at = r.randint(0, len(w))
            w[at:at] = passage
        if r.random() < 0.05:
            w += ["again"] * 45
        texts.append(r.choice(["", " ", "\n"]) + r.choice([" ", "\n", " \t"]).join(w))
    texts += [None, "", "   ", "z" * 70_000, "q " * 9_000]
    return [(i, t, None if i % 17 == 3 else r.choice(["en", "de"]), None if i % 11 == 5 else f"s{i % 3}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # An extra column whose name the operators use inside.
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")).withColumn("bucket", F.lit(1)).repartition(5)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# -- kernels ------------------------------------------------------------------------------------


def test_words_and_hashes(rows):
    texts = [r[1] for r in rows]
    buf, offsets, valid = textkit.texts_of(pa.array(texts, pa.string()))
    w = textkit.Words(buf, offsets, textkit.SPACE_CLASS)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi], strict=True)] for lo, hi in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [words(t) for t in texts] and valid.tolist() == [t is not None for t in texts]
    flat = [x for t in got for x in t]
    h = w.hashes()
    assert len({x for x in flat}) == len(np.unique(h)) and all(len({v}) == 1 for v in h[[i for i, x in enumerate(flat) if x == "again"]][:1].tolist())
    lower = w.hashes(lower=True)
    by = {}
    for x, v in zip(flat, lower.tolist(), strict=True):
        assert by.setdefault(x.translate(FOLD), v) == v


def test_words_do_not_cross_texts():
    buf, offsets, _ = textkit.texts_of(pa.array(["ab", "cd", None, "e f"], pa.string()))
    assert np.diff(textkit.Words(buf, offsets, textkit.SPACE_CLASS).first).tolist() == [1, 1, 0, 2]


# -- op1 ----------------------------------------------------------------------------------------


def toxic_corpus(spark):
    r = random.Random(5)
    lexicon = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(lexicon) for _ in range(r.randint(20, 200))]
        bad = i % 5 == 0
        for _ in range(r.randint(2, 5) if bad else 0):
            w[r.randrange(len(w))] = r.choice(["zzidiot", "zzmoron", "vexq" + r.choice(["a", "an", "ib", "os", "ut"])])
        docs.append((i, " ".join(w)))
        if i < 700:
            labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i in range(900) if i % 5 == 0}


def test_toxicity_held_out(spark):
    docs, labels, bad = toxic_corpus(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(900)}
    told = {r["doc_id"] for r in got if r["predicted"]}
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert len(told & bad & held) >= 0.95 * len(bad & held) and not told & held - bad
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = {r["doc_id"] for r in toxicity.reject(docs, labels).collect()}
    assert set(range(900)) - bad <= kept and len(kept & bad) <= 0.05 * len(bad)


def test_toxicity_edges(spark):
    docs, labels, _ = toxic_corpus(spark)
    odd = docs.unionByName(spark.createDataFrame([(None, "zzidiot zzmoron"), (5000, None), (5001, ""), (0, "again")], "doc_id long, text string"))
    more = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (2, 1)], "doc_id long, toxic int"))
    got = toxicity.score_documents(odd, more).collect()
    assert len(got) == 904 and len({r["score"] for r in got if r["doc_id"] in (5000, 5001)}) == 1
    assert toxicity.score_documents(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0 and toxicity.score_documents(docs, labels.limit(0)).count() == 900


def plain_model(rows, leave=None):
    """A word's difference of log-likelihoods by plain loops; rows: (text, class); leave: class of which one document is left out."""
    count, history = Counter(), {}
    for text, y in rows:
        seen = set()
        for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD)):
            b, h = w.encode(), b""
            for k in (4, 5, 6, 7, None):
                if k is None or len(b) > k:
                    x = (k, b[:k])
                    seen.add((h, x))
                    h = x
        count.update((s, y) for s in seen)
        history.update({s: s[0] for s in seen})
    by = {}
    for (h, x), y in count:
        by.setdefault(h, []).append((x, y))

    def ratio(h, x):
        n = [count[(h, x), c] for c in (0, 1)]
        H = [sum(count[(h, z), c] for z, y in by[h] if y == c) for c in (0, 1)]
        t = [sum(y == c for _, y in by[h]) for c in (0, 1)]
        if leave is not None and n[leave]:
            t[leave] -= n[leave] == 1
            n[leave], H[leave] = n[leave] - 1, H[leave] - 1
        if not sum(n):
            return 0.0
        shared, g = sum(n) / sum(H), 0.0
        if min(H):
            for c in (0, 1):
                e = sum(n) * H[c] / sum(H)
                g += 2 * (n[c] * np.log(n[c] / e) if n[c] else 0) + 2 * ((H[c] - n[c]) * np.log((H[c] - n[c]) / (H[c] - e)) if H[c] > n[c] else 0)
        w = 1 / (1 + np.exp((toxicity.PRIOR - g) / 2))
        if w < toxicity.LEAST_WEIGHT:
            return 0.0
        p = [w * (max(n[c] - 0.75, 0) + (0.75 * t[c] + 1) * shared) / (H[c] + 1) + (1 - w) * shared if H[c] else shared for c in (0, 1)]
        return np.log(p[1] / p[0])

    known = {}

    def word(w):
        if w not in known:
            b, h, total = w.encode(), b"", 0.0
            for k in (4, 5, 6, 7, None):
                if k is None or len(b) > k:
                    x = (k, b[:k])
                    total += ratio(h, x) if (h, x) in history else 0.0
                    h = x
            known[w] = total
        return known[w]

    return lambda text: sum(word(w) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (text or "").translate(FOLD)))


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_toxicity_equals_plain_model(spark, monkeypatch, held):
    """Counts, log ratios and sums by the operator, broadcast and in shards, against plain loops over the same documents."""
    monkeypatch.setattr(toxicity, "ASK_BYTES", 1 << 12)
    r = random.Random(21)
    stems = ["achlich", "réeux", "bomente", "idio", "moro", "x", "ab", "trashy"]
    rows = []
    for i in range(260):
        bad = i % 6 == 0
        w = [r.choice(stems) + "".join(r.choice("abcß") for _ in range(r.randint(0, 4))) for _ in range(r.randint(0, 40))]
        w += r.sample(["idiot", "moronic", "Trash"], r.randint(1, 3)) if bad else []
        rows.append((i, " ".join(w), int(bad)))
    rows += [(300, None, 0), (301, "", 1), (302, "idiot " * 9000, 1), (303, "same idiot text", 0)]
    docs = spark.createDataFrame([*rows, (303, "a second row of one id: moronic", 1)], "doc_id long, text string, toxic int").select("doc_id", "text").withColumn("item", F.lit("x")).withColumn("s", F.lit(1))
    docs = docs.repartition(6)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, held_rows=held)
    trained = [(t, y) for _, t, y in rows] + [("a second row of one id: moronic", 0)]
    plain = plain_model(trained)
    for row in toxicity.sums(docs, model, "text").collect():
        assert row["s"] == pytest.approx(plain(row["text"]), abs=1e-8), row["text"]
    y = docs.join(labels, "doc_id").select("text", "toxic")
    without = [plain_model(trained, leave) for leave in (0, 1)]
    for row in toxicity.sums(y, model, "text", "toxic", leave="toxic").collect():
        assert row["s"] == pytest.approx(without[row["toxic"]](row["text"]), abs=1e-8)
    assert len(model.weights) == 4


def test_long_text_is_read_in_parts(spark, monkeypatch):
    docs, labels, _ = toxic_corpus(spark)
    model = toxicity.train(docs, labels)
    long = " ".join(r["text"] for r in docs.limit(300).collect()) + " " + "y" * 70_000 + " zzidiot"
    d = spark.createDataFrame([(1, "short zzmoron"), (2, long), (3, None), (4, "z" * 9000)], "doc_id long, text string").coalesce(1)
    whole = {r["doc_id"]: (round(r["s"], 9), r["n"]) for r in toxicity.sums(d, model, "doc_id").collect()}
    monkeypatch.setattr(toxicity, "SLICE", 5000)
    assert whole == {r["doc_id"]: (round(r["s"], 9), r["n"]) for r in toxicity.sums(d, model, "doc_id").collect()}
    parts = list(textkit.pieces(*textkit.texts_of(pa.array(["ab cd " * 9, "x" * 50, ""]))[:2], textkit.SPACE_CLASS, 16))
    assert b"".join(bytes(p[2]) for p in parts) == ("ab cd " * 9 + "x" * 50).encode() and max(len(p[2]) for p in parts) == 50


# -- op2 ----------------------------------------------------------------------------------------


def greedy(word, pieces, marker=b""):
    """Longest piece first; a word with a byte that no piece covers is one token. Pieces carry the marker at a word's start."""
    rest, n = marker + word, 0
    while rest:
        k = next((k for k in range(len(rest), 0, -1) if rest[:k] in pieces), 0)
        if not k:
            return 1
        n, rest = n + 1, rest[k:]
    return n


@pytest.mark.parametrize("table_bytes", [1 << 30, 0])
def test_longest_match_automaton(monkeypatch, table_bytes):
    """The closed table and followed links; words of over 8 bytes go alone."""
    monkeypatch.setattr(token_counts, "LONG", 8)
    r = random.Random(3)
    for _ in range(40):
        pieces = {bytes(r.choices(b"abc", k=r.randint(1, 5))) for _ in range(12)} | ({b"a", b"b", b"c"} if r.random() < 0.7 else set())
        auto = token_counts.LongestMatch(sorted(pieces), b"", table_bytes)
        ws = ["".join(r.choices("abcd" if r.random() < 0.2 else "abc", k=r.randint(1, 14))) for _ in range(60)]
        buf, offsets, _ = textkit.texts_of(pa.array([" ".join(ws)]))
        assert auto.count(textkit.Words(buf, offsets, textkit.SPACE_CLASS)).tolist() == [greedy(w.encode(), pieces) for w in ws]


def test_token_counts(spark, docs, rows):
    pieces = set(token_counts.read_pieces())
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs).collect()}
    for i, t, *_ in rows[:40] + rows[-5:-2]:
        assert got[i] == (len(words(t)), sum(greedy(w.encode(), pieces, b" ") for w in words(t)))
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_tokens_of_a_very_long_word_and_text(spark):
    """A word of 5 MB and a text of 20 MB: the counts of their repeated parts add up."""
    pieces = set(token_counts.read_pieces())
    word, line = "zq9 " .strip() * (5 << 20 >> 2), "some plain words of text 12345\n"
    d = spark.createDataFrame([(1, word), (2, line * ((20 << 20) // len(line)))], "doc_id long, text string").repartition(2)
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(d).collect()}
    assert time.time() - began < 90
    n = (20 << 20) // len(line)
    assert got[2] == (6 * n, n * sum(greedy(w.encode(), pieces, b" ") for w in words(line)))
    short = [greedy(("zq9" * k).encode(), pieces, b" ") for k in (20, 21)]
    assert got[1] == (1, short[0] + (len(word) // 3 - 20) * (short[1] - short[0]))


# -- op3 ----------------------------------------------------------------------------------------


def repeats(rows):
    """n_words, n_removed, digest by row order; ids with one place in common are not earlier than each other."""
    ordered = sorted(((i if i is not None else -1, t) for i, t in rows), key=lambda x: x[0])
    first, out = {}, []
    for i, t in ordered:
        w = words(t)
        for k in range(len(w) - 19):
            first.setdefault(tuple(w[k : k + 20]), (i, k))
    for i, t in ordered:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone[k : k + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((None if i == -1 else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, docs, rows):
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == repeats([(r[0], r[1]) for r in rows])
    assert sum(r[2] for r in got) > 1000


def test_substring_dedup_many_seeds(spark):
    for seed in range(3):
        rows = [(r[0], r[1]) for r in make_docs(seed + 20, 60)]
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted((tuple(r) for r in substring_dedup.remove_repeats(d).collect()), key=str) == repeats(rows)


def test_substring_dedup_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (3, text), (3, text), (4, "x " + text)]
    got = sorted((tuple(r)[:3] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(3, 30, 30), (3, 30, 30), (4, 31, 30), (None, 30, 0)]
    same = substring_dedup.remove_repeats(spark.createDataFrame([(3, text), (3, text)], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in same] == [0, 0]
    hot = [(i, text) for i in range(300)]  # one group of copies over many partitions
    assert sum(r["n_removed"] for r in substring_dedup.remove_repeats(spark.createDataFrame(hot, "doc_id long, text string").repartition(20)).collect()) == 299 * 30
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


# -- op4 ----------------------------------------------------------------------------------------


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 32))
    v[500:1500] = v[500]  # a third of all vectors are one
    rows = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]
    odd = [(3000, None, 0), (3001, [0.0] * 32, 0), (3002, [float("nan")] + [1.0] * 31, 0), (3003, [None] + [1.0] * 31, 0), (3004, [1.0] * 8, 0), (None, [1.0] * 32, 0), (3100, [float("inf")] + [1.0] * 31, 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").repartition(7)
    got = {}
    for r in ann.search(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in range(0, 3000, 100):
        s = np.sqrt(((v - v[q]) ** 2).sum(1))
        s[q] = np.inf
        best = np.lexsort((np.arange(3000), s))[:10]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 11)) and [x[2] for x in mine] == pytest.approx([s[x[1]] for x in mine])
        assert all(a[2:] + a[1:2] <= b[2:] + b[1:2] for a, b in zip(mine, mine[1:], strict=False))
        found += len({x[1] for x in mine} & set(best.tolist()))
    assert set(got) == set(range(0, 3000, 100)) and found >= 0.9 * 300


def test_ann_tasks_without_candidates():
    """A task that met only a query's own row hands on nothing."""
    have = ann._Gathered(4)
    have.add(np.array([7]), np.full((1, 1), np.inf, np.float32), np.array([7]))
    assert [len(x) for x in have.settle()] == [0, 0, 0]
    have.add(np.array([7, 9]), np.array([[1, 2, 0, 5, 3, 1]] * 2, np.float32), np.arange(6))
    ask, distance, ids = have.settle()
    assert ask.tolist() == [7] * 4 + [9] * 4 and ids.tolist() == [2, 0, 5, 1] * 2 and distance.tolist() == [0, 1, 1, 2] * 2


def test_ann_holds_one_slice_and_one_block_of_queries():
    """Two slices of one hot cell, and thousands of queries past each: what a task holds does not grow with the queries."""
    rng = np.random.default_rng(3)
    q = ann.Quantiser(rng.normal(size=(2000, 16)), 64)
    q.probes = len(q.coarse)
    x, asks = rng.normal(size=(3000, 16)), rng.normal(size=(6000, 16))

    class Held:
        value = q

    def rows(batch, slice_, kind, **columns):
        n = batch.num_rows
        given = {"slice": pa.array([slice_] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32())} | {c: batch.column(c) for c in batch.schema.names}
        types = {"slice": pa.int32(), "kind": pa.int32(), "vec_id": pa.int64(), "cell": pa.int32(), "code": pa.binary(), "v": pa.list_(pa.float64())}
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(n, t)) for c, t in types.items()], list(types))

    def stream():
        for k in range(2):
            ids = np.arange(k, 3000, 2)
            (coded,) = ann._index(Held)([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(x[ids].tolist())], ["vec_id", "v"])])
            yield rows(coded.take(pa.array(np.argsort(np.asarray(coded.column("cell")), kind="stable"))), k, 0)
            for a in range(0, 6000, 500):
                yield rows(pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 500) + 10_000), pa.array(asks[a : a + 500].tolist(), pa.list_(pa.float64()))], ["vec_id", "v"]), k, 1)

    tracemalloc.start()
    found, largest = {}, 0
    for out in ann._meet(Held, 8)(stream()):
        largest = max(largest, out.num_rows)
        for ask, ids in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
            found.setdefault(ask, []).append(np.frombuffer(ids, "<i8"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert largest <= ann.ASK_BLOCK and len(found) == 6000 and all(len(v) == 2 for v in found.values()) and peak < 100 << 20
    cell = q.nearest(x, 1)[:, 0]
    codes = q.encode(x, cell)
    decoded = q.coarse[cell] + np.concatenate([b[codes[:, m]] for m, b in enumerate(q.books)], 1) * q.scale[cell][:, None]
    for k in (0, 1, 777, 5999):
        d = ((decoded - asks[k]) ** 2).sum(1)
        for half, ids in enumerate(found[10_000 + k]):
            own = np.arange(half, 3000, 2)
            assert d[ids] == pytest.approx(np.sort(d[own])[:8])


def test_ann_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 2.0], 0)], schema)
    assert [tuple(r)[:3] for r in ann.search(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


# -- op5 ----------------------------------------------------------------------------------------


def shingles(text):
    w = words((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    key = lambda i: -1 if i is None else i
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low.get(find(a), 1 << 60), key(i))
    return sorted(((i, len(s), None if (c := low[find(a)]) == -1 else c) for a, (i, s) in enumerate(sets)), key=str)


def test_ngram_join(docs, rows):
    got = sorted((tuple(r) for r in ngram_join.join_components(docs).collect()), key=str)
    assert got == linked([(r[0], r[1]) for r in rows])
    assert len({r[2] for r in got}) < len(got)


def near_copies(seed=2, n=160):
    """A large group of near copies that link in chains, one line that all share, and copies."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = r.choice(["x", "y", "z"]) + str(r.randint(0, 20))
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join([f"u{i}_{k}" for k in range(60)] + base[:40])) for i in range(40)]
    rows += [(1000 + i, rows[3][1].upper()) for i in range(30)]
    return rows


def test_ngram_join_near_copies(spark):
    rows = near_copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert sorted((tuple(r) for r in ngram_join.join_components(d).collect()), key=str) == linked(rows)


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f"), (7, "A B C D E F"), (7, "A B C D E F"), (8, "one two"), (9, "ONE  two"), (10, None), (11, " "), (12, "two one")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.join_components(d).collect()), key=str) == linked(rows)
    assert ngram_join.join_components(empty(spark)).count() == 0
    kept = sorted((r["doc_id"] for r in ngram_join.keep_one(d).collect()), key=str)
    assert kept == sorted([7, 8, 10, 11, 12], key=str)  # the row without id is a copy of one with


def test_keep_one_row_of_each_group(spark):
    """Distinct texts stay whatever their ids; of a group, and of rows that repeat, one stays; by plain loops."""
    r = random.Random(17)
    texts = [t for _, t, *_ in make_docs(seed=5, n=90)]
    rows = [(r.choice([None, *range(40)]), t) for t in texts]
    rows += [r.choice(rows) for _ in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p": F.lit(1), "_row": F.lit("x"), "u": F.lit(2)}).repartition(5)
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.keep_one(d).collect())
    group = {i: c for i, _, c in linked(list(enumerate(t for _, t in rows)))}
    prints = {x["text"]: (x["p"], x["q"]) for x in d.select("text", *ngram_join.text_prints()).collect()}
    want = Counter(row for row in rows if not words(row[1]))
    members = {}
    for i, (doc, text) in enumerate(rows):
        if words(text):
            members.setdefault(group[i], []).append(((doc is None, doc or 0, prints[text]), doc, text))
    want.update(min(m)[1:] for m in members.values())
    assert got == want


def test_components_of_a_chain(spark):
    d = spark.createDataFrame([(k, k + 1) for k in range(40) if k != 20], "u long, v long")
    got = {r["u"]: r["root"] for r in ngram_join.components(d).collect()}
    assert got == {k: 0 if k <= 20 else 21 for k in range(41)}


# -- op6 ----------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one(spark):
    texts = ["abab abba ab", "abcab cab", "bca abc"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    for history in (b"", b"a", b"ab", b"bcab", b"zzzz"):
        padded = history.rjust(4, b"\0")
        grams = np.array([int.from_bytes(padded + bytes([c]), "big") for c in range(256)], np.uint64)
        assert np.exp(model.log_p(grams)).sum() == pytest.approx(1, abs=1e-6)


def test_quality(spark):
    r = random.Random(4)
    syllables = {"en": ["the", "ing", "er", "an", "on"], "de": ["sch", "ein", "ung", "ver", "zu"]}
    docs, labels = [], []
    for i in range(400):
        lang = r.choice(["en", "de"])
        w = ["".join(r.choices(syllables[lang], k=r.randint(1, 3))) for _ in range(80)]
        bad = i % 6 == 0
        docs.append((i, " ".join("".join(r.choices("#$%&XQZ!", k=6)) if bad else x for x in w), lang))
        if i < 300:
            labels.append((i, int(not bad)))
    docs += [(900, None, "en"), (901, "", None), (902, docs[1][1], None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not any(got[i]["keep"] for i in range(0, 400, 6)) and not got[900]["keep"] and got[901]["perplexity"] is None
    good = [i for i in range(400) if i % 6]
    assert sum(got[i]["keep"] for i in good) >= 0.95 * len(good) and len(got) == 403
    none = quality.classify(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.where("keep or perplexity is not null").count() == 0 and quality.classify(d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 0])
def test_quality_equals_plain_kneser_ney(spark, monkeypatch, held):
    """Perplexities and quantiles against plain loops, with answers broadcast and in shards, and with texts read in parts."""
    for name, value in (("HELD_GRAMS", held), ("TRUSTED_IDS", held), ("SLICE", 300), ("SCORE_BYTES", 1000)):
        monkeypatch.setattr(quality, name, value)
    r = random.Random(9)
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(1, 90))) for _ in range(118)]
    texts += ["".join(r.choices("abcdefghé ", k=3000)), "x" * 1000]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")

    def grams(text, k):
        b = bytes(4) + text.encode()
        return [b[i - k + 1 : i + 1] for i in range(4, len(b))]

    counts = {5: Counter(g for t in texts[:100] for g in grams(t, 5))}
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    total, mass, cuts = {}, {}, {}
    for k, c in counts.items():
        of = Counter(c.values())
        cuts[k] = quality.discounts([of[i] for i in (1, 2, 3, 4)])
        total[k], mass[k] = Counter(), Counter()
        for g, n in c.items():
            total[k][g[:-1]] += n
            mass[k][g[:-1]] += cuts[k][min(n, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), g[:-1]
        if h not in total[k]:
            return p(g[1:])
        n = counts[k][g]
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total[k][h] + mass[k][h] / total[k][h] * p(g[1:])

    for row in quality.classify(d, labels).collect():
        own = [p(g) for g in grams(texts[row["doc_id"]], 5)]
        assert row["perplexity"] == pytest.approx(float(np.exp(-np.mean(np.log(own)))), rel=1e-6)


# -- op7 ----------------------------------------------------------------------------------------

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, named = [False] * len(w), set()
        for g, owners in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit[k : k + len(g)] = [True] * len(g)
                    named |= owners
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), sum(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha, beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (10, "short ITEM"), (3, None), (4, " ,; "), (None, "nameless thing here"), (5, "é ß 中文 x"), (1, "short item")]


def leak_rows():
    full = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    return [
        (1, "x " + full + " y"), (2, full.replace("epsilon", "EPSILON!! ")), (3, full.replace("epsilon", "other")), (4, "a short item, short item short"), (5, None), (6, ""), (None, "nameless-thing here"), (7, "É ß 中文 X"), (7, "é ß 中文 x"),
        (8, " ".join(full.split()[:10])), (9, " ".join(full.split()[:9])), (10, ("w " * 3000) + full + " mu" * 2000),
    ]


def test_decontamination(spark):
    d = spark.createDataFrame(leak_rows(), "doc_id long, text string").withColumn("items", F.lit(0)).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hits", F.lit(0))
    want = hits(leak_rows(), ITEMS)
    assert sorted((tuple(r) for r in decontaminate.report(decontaminate.find_phrases(d, items)).collect()), key=str) == want
    clean = decontaminate.drop_contaminated(d, items)
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in want if not r[5]), key=str) and clean.columns == d.columns
    for index in (decontaminate.store_index(d, items), decontaminate.store_index(d)):
        postings = decontaminate.index_postings(index)
        assert postings.where("size(positions) = 0").count() == 0 and postings.count() > 20
        found = decontaminate.report(decontaminate.search_index(index, items))
        assert sorted((tuple(r) for r in found.collect()), key=str) == want


def near_items(rows, items, within):
    """doc_id to ids of items one of whose windows has all its terms within so many words of a place of its rarest."""
    texts = {i: ALNUM.findall((t or "").translate(FOLD)) for i, t in rows}
    df = Counter(x for w in texts.values() for x in w)
    out = {i: set() for i in texts}
    for i, t in items:
        v = ALNUM.findall((t or "").translate(FOLD))
        for k in range(max(1, len(v) - 9) if v else 0):
            g = v[k : k + 10]
            rare = min(g, key=lambda x: df[x])
            for d, w in texts.items():
                if any(set(g) <= set(w[max(0, p - within) : p + within + 1]) for p, x in enumerate(w) if x == rare):
                    out[d].add(str(i))
    return out


def test_proximity(spark):
    r = random.Random(31)
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(120):
        w = base[:]
        r.shuffle(w)
        for _ in range(r.randint(0, 14)):
            w.insert(r.randrange(len(w) + 1), r.choice(["filler", "other", "alpha"]))
        if r.random() < 0.3:
            w.remove(r.choice(base[1:]))
        rows.append((i, " ".join(["pad"] * r.randint(0, 5) + w)))
    items = [(1, " ".join(base)), (2, "alpha beta beta"), (3, "kappa other")]
    d, i = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for parts in (1, 7):  # however the rows lie
        got = {r["doc_id"]: set(r["near"]) for r in decontaminate.find_phrases(d.repartition(parts), i, near=12).collect()}
        assert got == near_items(rows, items, 12) and sum(len(x) for x in got.values()) > 100


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 2000)  # the long text is read in parts
    monkeypatch.setattr(decontaminate, "item_blocks", lambda items, size=0, f=decontaminate.item_blocks: f(items, 5))
    d = spark.createDataFrame(leak_rows(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in decontaminate.report(decontaminate.find_phrases(d, items)).collect()), key=str) == hits(leak_rows(), ITEMS)


def test_decontamination_edges(spark):
    d, items = spark.createDataFrame(leak_rows(), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_phrases(d.limit(0), items).count() == 0
    assert decontaminate.report(decontaminate.find_phrases(d, items.limit(0))).where("contaminated").count() == 0
    phrases = decontaminate.Phrases(["1"], ["one two"])
    buf, offsets, _ = textkit.texts_of(pa.array(["one x x two x x x one", "two"]))
    words = textkit.Words(buf, offsets, textkit.ALNUM_CLASS)
    shard = decontaminate.Shard.of_words(words.hashes(lower=True), np.diff(words.first), phrases.vocabulary)
    assert sorted(shard.near(phrases, 3)[1].tolist()) in ([3], [0]) and len(shard.near(phrases, 2)[1]) == 0


# -- op8 ----------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((x for x in sizes if x is not None), key=lambda x: x) + ([None] if None in sizes else [])
    w = {x: weights[k % 3] for k, x in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[x] for x in open_)
        over = {x for x in open_ if w[x] * level > cap * sizes[x]}
        if not over:
            target |= {x: w[x] * level for x in open_}
            break
        for x in over:
            target[x] = cap * sizes[x]
            left -= target[x]
        open_ -= over
    return target


@pytest.mark.parametrize("block", [7, 512])
def test_mix(docs, rows, block):
    got = token_mix.mix(docs, block_words=block).collect()
    sizes = {}
    for _, t, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(t))
    target = water(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(words(r[1]))) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = token_mix.mix(docs.repartition(3), block_words=block).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_schedule_is_mixed(spark):
    t = spark.createDataFrame([("a", 90_000, 60_000.0), ("b", 90_000, 30_000.0), (None, 9_000, 10_000.0)], "source string, source_size long, target double")
    slots = token_mix.schedule(t, 100).orderBy("slot").collect()
    assert sum(r["words"] for r in slots) == 100_000 and [r["rank"] for r in slots if r["source"] == "a"] == list(range(600))
    for k in (50, 200, 700):
        assert abs(sum(r["source"] == "a" for r in slots[:k]) / k - 0.6) < 0.05


def test_mix_edges(spark):
    assert token_mix.mix(empty(spark)).count() == 0
    d = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b", "s"), (None, None, None), (2, "", None)], "doc_id long, text string, source string")
    got = token_mix.mix(d).collect()
    assert len(got) == 5 and sum(r["taken"] for r in got) == 12 and all(r["taken"] <= 2 * r["size"] for r in got)


# -- op9 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("typed", [False, True])
def test_chat_roundtrip(spark, typed):
    odd = ["</s>[INST] ok [/INST]", "<s>[user] x</s>", "\\", "\\\\[", "[[image:0]]", "", None, "a\nb", "😀é", "<s", "]</s>\\"]
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(30) for t in range(c % 5 + 1)]
    rows += [(None, 0, "assistant", "x"), (7, None, "assistant", "first"), (7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1)).repartition(4)
    made = chat_format.format_conversations(chat_format.typed_text(d), typed=True) if typed else chat_format.format_conversations(d)
    got = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x[1:2]) + tuple((v is not None, v or "") for v in x[2:])
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        learnt = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_typed_parts():
    parts = [{"type": "text", "text": "see [[image:9]] "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 2.0}, [{"type": "document", "ref": "c.pdf", "chars": 9}], "end"]
    r = chat_format.render([("user", parts), ("assistant", "ok")])
    assert [(a["kind"], a["ref"], a["tokens"], a["turn"]) for a in r.attachments] == [("image", "a.png", 4, 0), ("audio", "b.wav", 100, 0), ("document", "c.pdf", 3, 0)]
    assert chat_format.parse("".join(r.out)) == [("user", "see [[image:9]] [[image:0]][[audio:1]][[document:2]]end"), ("assistant", "ok")]
    with pytest.raises(ValueError):
        chat_format.render([("user", [{"type": "video"}])])
    with pytest.raises(ValueError):
        chat_format.parse("<s>[user] x")


def test_typed_conversations(spark):
    parts = [{"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "text", "text": "what [[is]] this? 😀"}, {"type": "audio", "ref": "b.wav", "seconds": 1.0}]
    rows = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", json.dumps([{"type": "text", "text": "a <s> cat"}])), (2, 0, "user", None), (2, 1, "assistant", json.dumps("plain"))]
    made = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), typed=True)
    got = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    said = "user\n[[image:0]]what [[is]] this? 😀[[audio:1]]\nassistant\na <s> cat\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1]["n_attachments"], got[1]["expanded_tokens"], got[1]["loss_chars"]) == (2, 54, 9)
    assert (got[2]["n_attachments"], got[2]["expanded_tokens"], got[2]["loss_chars"]) == (0, 0, 5)
    held = {r["conv_id"]: [(a["kind"], a["ref"], a["turn"], a["tokens"]) for a in r["attachments"]] for r in made.collect()}
    assert held == {1: [("image", "a.png", 0, 4), ("audio", "b.wav", 0, 50)], 2: []}


def test_chat_empty(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# -- op10 ---------------------------------------------------------------------------------------


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    t, out = text or "", []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.BASE[kind], t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def pii_texts():
    r = random.Random(9)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "a@b@c.de", "@x.y", "a@b.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "01.002.3.4", "4111 1111 1111 1111", "4111111111111112", "4111-1111-1111-1111", "+1 (555) 123-4567", "+12", "+49 30 123456 ", "+(0)", "12 34", "é", "😀", "word", ".", "%_", "-", "\n", "1", "  ", "4539578763621486", "call 555-123-4567", "a[at]b.com"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", ""]) for _ in range(r.randint(0, 12))) for _ in range(500)]
    return [None, "", "7" * 30_000, "a" * 30_000 + "@", "a.b" * 9_000, "+" * 500, "1 " * 9_000, *texts]


def test_pii_base(spark):
    rows = list(enumerate(pii_texts()))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).repartition(4)
    got = {r["doc_id"]: r for r in pii.report(pii.find_spans(d)).collect()}
    for i, t in rows:
        base = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert set(base.split(",")) - {""} <= set(got[i]["spans"].split(","))
        assert got[i]["n_email"] == base.count("email") and got[i]["n_card"] == base.count("card")


def test_pii_redaction_and_edges(spark):
    d = spark.createDataFrame([(1, "mail a@b.com now +1 (555) 123-4567", "en", "s", 3), (None, None, None, None, None), (2, "plain", "de", None, 5)], DOCS)
    out = {r["doc_id"]: r for r in pii.redact(d).collect()}
    assert out[1]["text"] == "mail <EMAIL> now <PHONE>" and out[1]["n_chars"] == 24 and out[None]["text"] is None and out[2]["text"] == "plain"
    assert pii.redact(empty(spark)).count() == 0 and pii.report(pii.find_spans(empty(spark))).count() == 0


def test_em_finds_reliable_labelers():
    counts = {"0 true 1 1 1 0 1 0 3 1 1 1": 80, "0 false 0 -1 0 0 -1 0 3 3 3 1": 60, "0 false 0 1 1 1 1 0 3 1 1 1": 20}
    p = pii.classifier(counts)
    assert p["0 true 1 1 1 0 1 0 3 1 1 1"] > 0.95 and p["0 false 0 -1 0 0 -1 0 3 3 3 1"] < 0.05


def plain_em(rows, rounds):
    """rows: (votes, known class or None), one per candidate of one kind."""
    q = [known if known is not None else 1 / (1 + np.exp(-sum(v))) for v, known in rows]
    for _ in range(rounds):
        odds = np.zeros(len(rows))
        unknown = [x for x, (_, known) in zip(q, rows, strict=True) if known is None]
        odds += np.log((1 + sum(unknown)) / (1 + sum(1 - x for x in unknown)))
        for place in range(len(rows[0][0])):
            cast = {v[place] for v, _ in rows} - {0}
            if not cast:
                continue
            seen = {value: [1 + sum(1 - x for x, (v, _) in zip(q, rows, strict=True) if v[place] == value), 1 + sum(x for x, (v, _) in zip(q, rows, strict=True) if v[place] == value)] for value in (-1, 1)}
            for k, (v, _) in enumerate(rows):
                if v[place]:
                    no, yes = ([seen[value][y] for value in (-1, 1)] for y in (0, 1))
                    at = (-1, 1).index(v[place])
                    odds[k] += np.log(yes[at] / sum(yes)) - np.log(no[at] / sum(no))
        q = [known if known is not None else 1 / (1 + np.exp(-x)) for x, (_, known) in zip(odds, rows, strict=True)]
    return q


def test_em_equals_plain_em():
    r = random.Random(3)
    rows = []
    for _ in range(400):
        true, strict = r.random() < 0.5, r.random() < 0.5
        votes = tuple([1 if strict else 0] + [r.choice([0, s, s, -s] if k % 2 else [0, s, s, s]) for k, s in enumerate([1 if true else -1] * 5)])
        rows.append((votes, (1.0 if true else 0.0) if strict else None))
    key = lambda v, known: " ".join(map(str, ["3", "true" if known == 1 else "false", *v, 1, 1, 1, 1]))
    counts = Counter(key(*x) for x in rows)
    got = pii.reliabilities(counts, 15)
    assert max(abs(got[key(*x)] - q) for x, q in zip(rows, plain_em(rows, 15), strict=True)) < 1e-9


def test_pii_added_spans(spark):
    """Planted wide forms are found, and look-alikes and failed checksums are not added."""
    r = random.Random(12)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    texts, good, bad = [], [], []
    for i in range(300):
        base = r.choice(["a@b.com", "+1 (555) 123-4567", "10.1.2.3", "4111111111111111", "no"])
        nanp = f"{r.choice('23456789')}{digits(2)}-{r.choice('23456789')}{digits(2)}-{digits(4)}"
        yes = r.choice([f"joe{i} [at] mail.example [dot] org", f"ann.{i}(at)host.de", f"2001:db8:{i % 10}:1:2:3:4:{i}", f"call {nanp}", nanp])
        no = r.choice([f"order {r.choice('01')}{digits(2)}-{digits(3)}-{digits(4)}", "4111111111111112", "999.1.2.3", f"see x{i} [at] 12 . 34", "+1 23"])
        texts.append(f"{base} words {yes} more words {no} end")
        good.append(yes.removeprefix("call "))
        bad.append(no.removeprefix("order ").removeprefix("see "))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_spans(d).collect()}
    added = [(i, texts[i][s["start"] : s["end"]]) for i, row in found.items() for s in row["spans"] if s not in row["base"]]
    right = sum(t in good[i] for i, t in added)
    assert right >= 0.95 * len(added) and right >= 0.9 * len(texts)
    assert not [t for _, t in added if t in ("4111111111111112", "999.1.2.3")]


@pytest.mark.parametrize("piece", ["{}12, ", "1.2.3.{} ", "x{}@y.com ", "212-555-0{:03} | "])
def test_pii_many_matches_in_one_text(spark, piece):
    n = 100_000 if piece.startswith("{") else 30_000
    text = "".join(piece.format(k % 250) for k in range(n))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    row = pii.report(pii.find_spans(d)).first()
    assert time.time() - began < 60
    assert row["base_sha256"] == hashlib.sha256(base_spans(text).encode()).hexdigest()
    out = pii.redact(d).first()["text"]
    for k in range(3):
        text = re.sub(pii.BASE[pii.KINDS[k]], lambda m, k=k: f"<{pii.KINDS[k].upper()}>" if base_spans(m[0]) else m[0], text) if k != 2 else text
    assert out == text or piece.startswith("212")


def test_pii_redaction_of_overlaps_and_control_characters(spark):
    texts = ["\x01a@b.com\x01 x\x02" * 30, "é" * 3000 + "1.2.3.4" + "😀" * 2000 + "c@d.org", "+1.2.3.4 5551 23", "a@b.com" + "y " * 600 + "1.2.3.4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(d).collect()}
    for r in pii.redact(d).collect():
        at, out, t = 0, "", texts[r["doc_id"]]
        for s in sorted(spans[r["doc_id"]], key=tuple):
            if s["start"] >= at:
                out += t[at : s["start"]] + f"<{pii.KINDS[s['k']].upper()}>"
            at = max(at, s["end"])
        assert r["text"] == out + t[at:]


# -- pipeline -----------------------------------------------------------------------------------


def test_checkpoint_folder_is_the_sessions(spark):
    root = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert common.checkpoint_root(spark) == root
    kept = common.cut(spark.range(5), "probe")
    assert kept.count() == 5 and os.path.isdir(root.removeprefix("file://"))
    assert common.forget(spark) >= 1 and not [x for x in os.listdir(root.removeprefix("file://")) if x.startswith("probe-")]
