"""Searches of many queries and of stored indexes against plain versions."""

import math
import random

import pytest

from corpusloom.operators import retrieval as R


def plain_nearest(vectors, query, k, metric):
    out = []
    for key, v in vectors:
        if v is None or len(v) != len(query):
            continue
        if metric == "l2":
            out.append((-math.sqrt(sum((a - b) ** 2 for a, b in zip(v, query, strict=True))), key))
        elif any(v) and any(query):
            out.append((sum(a * b for a, b in zip(v, query, strict=True)) / math.sqrt(sum(a * a for a in v) * sum(b * b for b in query)), key))
    out.sort(key=lambda x: (-round(x[0], 9), x[1]))
    return [key for _, key in out[:k]]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [4, 100])
def test_many_queries_at_once(spark, metric, block):
    r = random.Random(5)
    vectors = [(k, [r.randrange(-3, 4) / 2 for _ in range(4)]) for k in range(200)] + [(300, None), (301, [1.0, 2.0]), (302, [0.0] * 4), (303, [1.0] * 4)]
    queries = [(k, v) for k, v in vectors[::20]] + [(1000, [0.5, 1.0]), (1001, None), (1002, [1.0, 2.0, 3.0]), (1003, [0.0] * 4)]
    v = spark.createDataFrame(vectors, "chunk_id long, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, embedding array<float>")
    got = {}
    for row in R.search_vectors_batch(v, q, 7, metric, block=block).orderBy("query_id", "nth").collect():
        got.setdefault(row["query_id"], []).append(row["chunk_id"])
    want = {k: plain_nearest(vectors, x, 7, metric) for k, x in queries if x is not None}
    assert got == {k: x for k, x in want.items() if x}


def test_many_queries_of_nothing(spark):
    v = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert R.search_vectors_batch(v, q).count() == 0 and R.search_vectors_batch(q.withColumnRenamed("query_id", "chunk_id"), q.where("false")).count() == 0


def test_name_index(spark, tmp_path):
    r = random.Random(8)
    words = ["report", "Budget", "café", "x1", "notes", "2024", "a"]
    rows = [(k, f"{r.choice(words)}_{r.choice(words)}.txt", "/".join(r.choice(words) for _ in range(r.randrange(0, 3)))) for k in range(120)]
    files = spark.createDataFrame(rows, "file_id long, basename string, folder_path string").repartition(4)
    for cap in (5, 500):
        whole = R.NameIndex.build(spark, files, str(tmp_path / f"names{cap}"), 3, cap)
        assert whole.parts[0][0].agg({"df": "max"}).first()[0] == 120  # "txt", a row for each place
        parts = [(R.NameIndex.bucketed(R.name_rows(files.where(f"file_id % 2 = {k}")), 2 + k), 2 + k) for k in range(2)]
        for query in ("budget report", "CAFE", "txt", "nothing", "", "a a x1 2024 txt"):
            want = [(x["file_id"], round(x["score"], 9)) for x in R.search_filenames(files, query, 20, cap).collect()]
            for index in (whole, R.NameIndex(parts, 120, False, cap)):
                assert [(x["file_id"], round(x["score"], 9)) for x in index.search(query, 20).collect()] == want, (query, cap)
    assert R.NameIndex([], 0, False).search("a").count() == 0


def test_names_of_all_files_count(spark, tmp_path, monkeypatch):
    rows = [(k, f"doc_{k}.txt", "common/rare" if k > 590 else "common/doc") for k in range(600)]
    files = spark.createDataFrame(rows, "file_id long, basename string, folder_path string").repartition(4)
    monkeypatch.setattr(R, "NAME_SPAN", 64)
    whole = R.NameIndex.build(spark, files, str(tmp_path / "names"), 3)
    parts = [(R.NameIndex.bucketed(R.name_rows(files), 2), 2)]
    for index in (files, whole, R.NameIndex(parts, 600, False)):
        got = [(r["file_id"], round(r["score"], 9)) for r in R.search_filenames(index, "common rare", 20).collect()]
        both = math.log(1 + 600 / 600) + math.log(1 + 600 / 9)
        assert got == [(k, round(both, 9)) for k in range(591, 600)] + [(k, round(math.log(2), 9)) for k in range(11)]
        # "doc" is in every basename and in 591 folders; a file counts once.
        assert {round(r["score"], 9) for r in R.search_filenames(index, "doc", 600).collect()} == {round(math.log(2) * w, 9) for w in (3, 4)}
    largest = whole.parts[0][0].selectExpr("max(size(basename))", "max(size(folder_path))").first()
    assert tuple(largest) == (64, 64)


@pytest.mark.parametrize("kind", ["hybrid", "keyword"])
def test_names_beyond_the_first_500_of_a_token_are_found(spark, kind):
    # alpha is in files 0 to 549 and 1099, beta in 549 to 1099: those of both are among nobody's first 500.
    rows = [(k, f"/{k}", f"f{k}.txt", " ".join(["alpha"] * (k < 550 or k == 1099) + ["beta"] * (k >= 549))) for k in range(1100)]
    files = spark.createDataFrame(rows, "file_id long, path string, basename string, folder_path string")
    text = [(k << 24, k, 0, 1, "native", "words") for k in (3, 4)]
    chunks = spark.createDataFrame(text, "chunk_id long, file_id long, chunk_index int, page_number int, source_type string, text string")
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    found = R.keyword_search(chunks, files, "alpha beta", 2) if kind == "keyword" else R.hybrid_search(chunks, files, none, "alpha beta", [1.0], 2)
    assert sorted(r["file_id"] for r in found.collect()) == [549, 1099]


def test_pruned_search_finds_the_same(spark, tmp_path, monkeypatch):
    r = random.Random(4)
    words = [f"w{k}" for k in range(12)]
    rows = []
    for f in range(300):
        body = [w for k, w in enumerate(words) for _ in range(r.choice([0, 0, 1]) * r.randrange(1, 2 + 8 // (k + 1)))]
        rows.append((f << 24, f, 0, " ".join(["the", *body, *["the"] * (20 if f % 97 == 0 else 0)])))
    chunks = spark.createDataFrame(rows, "chunk_id long, file_id long, chunk_index int, text string")
    index = R.TextIndex.build(spark, chunks, str(tmp_path / "index"), 3, span=10)
    monkeypatch.setattr(R, "FIRST_RANGES", 4)
    read = {}
    for query in [*words[::3], "the", "the w1 w11", "w0 w0 w5", "nothing", "w3 nothing", ""]:
        want = [(x["chunk_id"], round(x["score"], 9)) for x in index.search(query, 4, pruned=False).collect()]
        assert [(x["chunk_id"], round(x["score"], 9)) for x in index.search(query, 4).collect()] == want, query
        read[query] = index.read
    assert read["the"][1] == 300 and read["the"][0] < 100  # the word of all chunks is read in part
    monkeypatch.setattr(R, "LISTED_RANGES", 0)
    assert index.search("the w1 w11", 5).collect() == index.search("the w1 w11", 5, pruned=False).collect()


def test_postings_are_made_where_their_chunks_are(spark, tmp_path):
    texts = ["b a b", "", None, "Caf\u00e9 cafe a", "...", "x " * 300]
    chunks = spark.createDataFrame([((k << 24) + 1, k, t) for k, t in enumerate(texts)], "chunk_id long, file_id long, text string")
    posted = R.TextIndex.posted(chunks, 3)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    want = [("a", 0, 1, 3), ("a", 3, 1, 3), ("b", 0, 2, 3), ("cafe", 3, 2, 3), ("x", 5, 300, 300)]
    assert sorted((r["token"], r["chunk_id"] >> 24, r["tf"], r["dl"]) for r in posted.collect()) == want
    index = R.TextIndex.build(spark, chunks, str(tmp_path / "index"), 3)
    assert sorted((r["token"], r["chunk_id"] >> 24, r["tf"], r["dl"]) for r in index.postings.collect()) == want
    assert tuple(index.total()) == (3, 306)
    assert sorted(r["chunk_id"] >> 24 for r in index.rows_of([0, 2, 5, 9]).collect()) == [0, 2, 5]
