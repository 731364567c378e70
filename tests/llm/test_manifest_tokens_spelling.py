"""Spelling variants, token files and the Merkle manifest against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import merkle, spelling, token_file

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def varied(n=60, seed=5):
    """Rows with nulls in every column, empty and odd texts, ties and repeated rows."""
    r = random.Random(seed)
    stems = ["colour", "color", "colours", "grössere", "groessere", "theatre", "theater", "analyse", "analyze", "naïveté", "ÀÉÎÕÜß×÷", "aabbaabb"]
    rows = []
    for k in range(n):
        words = [r.choice(stems) for _ in range(r.randrange(0, 60))]
        words = [w[:i] + r.choice("xyzà") + w[i + 1 :] if r.random() < 0.1 else w for w in words for i in [r.randrange(len(w))]]
        text = " ".join(w.upper() if r.random() < 0.1 else w for w in words)
        rows.append((k if k % 17 else None, text, r.choice(["de", "en", None, "fr"]), r.choice(["a", None]), len(text) if k % 5 else None))
    odd = ["", None, "1st 2nd\t\n  x  y\n\n don't we'll 'sabc a1b2", "日本語 テキスト  x 😀", "<|endoftext|> a<|endoftext|>b", "x" * 5000, "café-" * 40]
    rows += [(1000 + k, t, "en", "z", k) for k, t in enumerate(odd)]
    return rows + rows[:3] + [rows[5]] * 4


# -- spelling variants ------------------------------------------------------------------------------


def plain_counts(rows, altered=199):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if altered and h % altered == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, factor=5):
    form, near = {}, {}
    for w in n:
        others = [v for v in n if is_near(v, w)]
        near[w] = len(others)
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def test_spelling_of_documents(spark):
    rows = varied()
    for altered in (199, 3):
        n = plain_counts(rows, altered)
        assert n and (altered == 199 or len(n) > 20)
        found = spelling.spelling_variants(spark.createDataFrame(rows, DOCS).repartition(3), altered)
        assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(map(tuple, found.collect())) == plain_variants(n)


def test_spelling_groups(spark):
    r = random.Random(1)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(3, 7))): r.choice([1, 1, 2, 5, 25, 130]) for _ in range(90)}
    words |= {f"{'q' * 6}{chr(c)}": 7 for c in range(0x400, 0x450)}  # one large group, all ties
    words |= dict.fromkeys(["ch" + "a" * k for k in range(5)], 3) | {"chaaaaa": 15, "chaaaaaa": 75, "chaaaaaaa": 375, "chaaaaaaaa": 1875, "chaaaaaaaaa": 9375}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    want = plain_variants(words)
    assert sorted(map(tuple, spelling.group_variants(frame).collect())) == want
    assert {w: root for w, _, root, *_ in want}["chaaaaa"] == "chaaaaaaaaa"
    split = spelling.neighbours(frame, radix_entries=8)  # many partitions
    assert sorted((x["word"], x["n_near"]) for x in split.collect()) == [(w, near) for w, _, _, _, near, _ in want]
    assert spelling.group_variants(frame.where("false")).count() == 0


def test_spelling_kernels():
    key, of, at = spelling.deletion_keys(["abcb", "acb", "abb", "xabcb"])
    entry = {}
    for k, w, p in zip(key.tolist(), of.tolist(), at.tolist(), strict=True):
        word = ["abcb", "acb", "abb", "xabcb"][w]
        entry.setdefault(word if p < 0 else word[:p] + word[p + 1 :], set()).add(k)
    assert all(len(v) == 1 for v in entry.values()) and len({*map(min, entry.values())}) == len(entry)
    texts = [b"", b"a", "né".encode(), b"x" * 5000]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    state = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    assert spelling.checksums(state, buf, np.cumsum(size) - size, size).tolist() == [zlib.crc32(b"7:" + t) for t in texts]


def test_spelling_reads_long_texts_in_parts(spark, monkeypatch):
    rows = varied(20)
    monkeypatch.setattr(spelling.T, "SLICE_BYTES", 64)
    ids = [r[0] for r in rows]
    import pyarrow as pa

    buf, offsets, _ = spelling.T.texts_of(pa.array([r[1] for r in rows]))
    total = Counter()
    for at, many, part, edges in spelling.T.pieces(buf, offsets, spelling._UNCUT, 64):
        found = spelling._count_slice(ids[at : at + many], part, edges, 199, 6)
        for row in found.to_pylist() if found else []:
            total[row["word"]] += row["n"]
    assert {w: n for w, n in total.items() if n >= 5} == plain_counts(rows)


# -- token files ------------------------------------------------------------------------------------


def test_simple8b_round_trip():
    r = np.random.default_rng(3)
    kinds = [np.zeros(0, np.uint64), np.zeros(700, np.uint64), r.integers(0, 50257, 5000), r.integers(0, 2, 1000), np.full(1, 2**64 - 1, np.uint64)]
    kinds += [(1 << r.integers(0, 64, 3000).astype(np.uint64)) - np.uint64(1), np.array([2**60 - 1, 2**60, 0, 0, 5], np.uint64)]
    for values in kinds:
        values = values.astype(np.uint64)
        for block in (1, 7, 128):
            edges = token_file.blocks_of(np.array([len(values) // 3, 0, len(values) - len(values) // 3]), block)
            words, first, escapes = token_file.encode(values, edges)
            assert (token_file.decode(words, first, edges, escapes) == values).all()
            assert len(escapes) <= (values >= 2**59).sum()
    small = r.integers(0, 16, 6000)
    words, _, _ = token_file.encode(small, token_file.blocks_of(np.array([6000])))
    assert len(words) <= 6000 / 15 + 6000 / 128
    for block in range(3):  # a block without the others
        edges = token_file.blocks_of(np.array([1500]))
        words, first, escapes = token_file.encode(small[:1500], edges)
        lo, hi = first[block], np.append(first, len(words))[block + 1]
        one = token_file.decode(words[lo:hi], np.array([0]), edges[block : block + 2] - edges[block], escapes)
        assert (one == small[edges[block] : edges[block + 1]]).all()


def test_token_file_is_whole_or_refused():
    sizes = np.array([3, 600])
    words, first, escapes = token_file.encode(np.arange(603), token_file.blocks_of(sizes))
    data = token_file.to_bytes(np.array([4, 9]), sizes, first, words, escapes)
    ids, found, values = token_file.from_bytes(data)
    assert ids.tolist() == [4, 9] and found.tolist() == [3, 600] and values.tolist() == list(range(603))
    for bad in (data[:-9], data[:50] + b"\1" + data[51:], b"other" + data[5:]):
        with pytest.raises(ValueError, match="whole"):
            token_file.from_bytes(bad)


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_token_files(spark, tmp_path):
    rows = varied()
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"source": "part", "lang": "file"}).repartition(5)
    for most in (1 << 22, 300):
        folder = f"file:{tmp_path}/{most}"
        manifest = token_file.write_tokens(docs, folder, BPE, file_ids=most)
        assert (manifest.count() > 20) == (most == 300)
        found = token_file.read_tokens(manifest, folder).collect()
        assert sorted((f["doc_id"] is not None, f["doc_id"] or 0) for f in found) == sorted((r[0] is not None, r[0] or 0) for r in rows)
        at = 0
        order = sorted(found, key=lambda f: f["start"])
        for f in order:  # without gaps, in order of the ids, nulls first
            assert f["start"] == at
            at += f["n_tokens"]
        ids = [f["doc_id"] for f in order]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
        want = Counter((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, plain_ids([r[1] for r in rows]), strict=True))
        assert Counter((f["doc_id"], f["n_tokens"], f["ids_crc32"]) for f in found) == want
    assert token_file.token_files(docs.where("false"), BPE).count() == 0


def test_segments_give_the_library_s_ids(monkeypatch):
    import pyarrow as pa

    r = random.Random(2)
    alphabet = ["a", "B", "é", "7", " ", " ", "\n", "\t", ".", "'s", "'ll", "'", "-", " ", "日", " ", "<|endoftext|>", "😀", "\x1c", "_", "×", "٣"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 80))) for _ in range(1500)] + ["ab " * 100, "ab" * 200]
    want = [i[:-1] for i in plain_ids(texts)]
    made = token_file.Segments(BPE)
    for size in (1 << 20, 40):
        monkeypatch.setattr(token_file.T, "SLICE_BYTES", size)
        buf, offsets, _ = token_file.T.texts_of(pa.array(texts))
        ids, many = token_file._ids(made, buf, offsets)
        edge = np.concatenate([[0], np.cumsum(many)])
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)] == want
    monkeypatch.setattr(token_file, "KEPT", 10)  # nothing more is kept
    again = token_file.Segments(BPE)
    ids, many = token_file._ids(again, buf, offsets)
    assert ids.tolist() == [i for w in want for i in w] and len(again.stored.key) + len(again.recent.key) <= 10


# -- Merkle manifest --------------------------------------------------------------------------------


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def plain_tree(leaves):
    """Levels of digests from the leaves to the one that is left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(at[k : k + 8]) for k in range(0, len(at), 8)])
    return levels


def siblings(levels, k):
    out = []
    for at in levels[:-1]:
        lo = k // 8 * 8
        out.append((k - lo, [d for j, d in enumerate(at[lo : lo + 8], lo) if j != k]))
        k //= 8
    return out


def plain_fold(leaf, path):
    for k, others in path:
        leaf = sha([*others[:k], leaf, *others[k:]])
    return leaf


def plain_manifest(rows):
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        low = text
        if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            low = ascii_lower(text)
        row = (doc_id, plain_leaf((doc_id, source, lang, n_chars, text)), plain_leaf((doc_id, source, lang, n_chars, low)))
        langs.setdefault(lang, []).append(row)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {name: plain_tree([x[1] for x in langs[name]]) for name in names}
    top = plain_tree([trees[name][-1][0] for name in names])
    root, out = top[-1][0], []
    for j, name in enumerate(names):
        for k, (doc_id, leaf, other) in enumerate(langs[name]):
            path = siblings(trees[name], k) + siblings(top, j)
            back = plain_fold(other, path)
            out.append((doc_id, leaf, trees[name][-1][0], root, sha(s for _, others in path for s in others), back, back == root))
    return out


@pytest.mark.parametrize("many", [1, 9, 200])
def test_manifest(spark, many):
    rows = varied(many) if many > 1 else [(3, "One", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumnsRenamed({"doc_id": "doc_id"}).repartition(4)
    found = merkle.manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = Counter(plain_manifest(rows))
    assert Counter(map(tuple, found.collect())) == want
    assert many == 1 or len({w[-1] for w in want}) == 2


def test_manifest_of_more_than_a_block(spark):
    """Trees of one leaf and of three walks' height, and more trees than a run or a block holds."""
    rows = [(k, f"T{k}", "en", "s", k) for k in range(4200)] + [(k, "t", f"l{k % 530}", None, 1) for k in range(530)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"place": spark_lit(1), "digest": spark_lit("x"), "tree": spark_lit("y")})
    assert Counter(map(tuple, merkle.manifest(docs).collect())) == Counter(plain_manifest(rows))


def spark_lit(value):
    from pyspark.sql import functions as F

    return F.lit(value)


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    assert merkle.manifest(spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS), tampered=0).where("verified").count() == 3


def test_walk():
    leaves = [f"{k:064x}".encode() for k in range(70)]
    paths = [[] for _ in leaves]
    root = merkle.walk(leaves, merkle.levels_of(70), paths)
    assert root.decode() == plain_tree([x.decode() for x in leaves])[-1][0]
    assert all(merkle.fold(leaf, b"".join(p)) == root for leaf, p in zip(leaves, paths, strict=True))
