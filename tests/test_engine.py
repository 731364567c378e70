import json
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import registry
from corpusloom.operators import retrieval as R
from corpusloom.operators import state as M
from corpusloom.operators import text as X
from corpusloom.sources import extract, sidecar
from corpusloom.streaming import events as T


def test_bm25_with_clipped_idf(spark):
    c = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a c c"), (4, "d")], "chunk_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in R.search_fts(c, "a").collect()}
    assert got == pytest.approx({1: 9.447852760736198e-07, 2: 1.2125984251968504e-06, 3: 7.738693467336684e-07})
    x = spark.createDataFrame([(1, "beta x"), (2, "y"), (3, "z")], "chunk_id long, text string")
    one, two = (R.search_fts(x, q).first()["score"] for q in ("beta", "beta beta"))
    assert two == pytest.approx(2 * one)
    assert R.query_tokens("café") == ["caf"] and R.query_tokens("café", unicode=True) == ["cafe"] and R.search_fts(x, "é").count() == 0
    accents = spark.createDataFrame([(1, "Café-Menü"), (2, "straße caf")], "chunk_id long, text string")
    assert [r["chunk_id"] for r in R.search_fts(accents, "café", unicode=True).collect()] == [1] and [r["chunk_id"] for r in R.search_fts(accents, "café").collect()] == [2]


def test_fusion(spark):
    h = lambda rows: spark.createDataFrame(rows, "file_id long, score double")
    got = {r["file_id"]: r["score"] for r in R.fuse_scores({"a": h([(1, 10.0), (2, 5.0), (3, 0.0)]), "b": h([(2, 4.0)])}).collect()}
    assert got == {1: 1.0, 2: 1.5, 3: 0.0}
    rank = R.fuse_ranks({"a": h([(1, 2.0), (2, 1.0)]), "b": h([(2, 2.0), (3, 1.0)])}).orderBy(F.col("score").desc()).collect()
    assert [r["file_id"] for r in rank] == [2, 1, 3] and rank[0]["score"] == pytest.approx(1 / 61 + 1 / 62)


def test_gate(spark):
    r = lambda *rows: spark.createDataFrame(list(rows), "run_id long, phase string, status string")
    R.require_ready(r((1, "index", "completed"), (2, "markdown", "paused")))
    R.require_ready(r((1, "markdown", "paused")))
    with pytest.raises(RuntimeError):
        R.require_ready(r((1, "index", "completed"), (2, "index", "paused")))
    for bad in (("", "fts", 1), ("x", "other", 1), ("x", "fts", 51)):
        with pytest.raises(ValueError):
            R.checked_query(*bad)


def test_filename_only_hit(spark):
    files = spark.createDataFrame([(7, "/a/report.txt", "report.txt", "a")], "file_id long, path string, basename string, folder_path string")
    chunks = spark.createDataFrame([], "chunk_id long, file_id long, page_number int, chunk_index int, source_type string, text string")
    row = R.keyword_search(chunks, files, "report").first()
    assert (row["chunk_id"], row["page_number"], row["chunk_index"], row["source_type"]) == (-7, 0, -1, "filename")


def test_folder_source(spark, tmp_path):
    for name in ("b.txt", ".hidden", "_kept.md", "sub/.git/x.txt", "sub/a.eml"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("Subject: s\n\nbody" if name.endswith("eml") else name)
    found = extract.scan_files(spark, str(tmp_path))
    assert sorted(r["relative_path"] for r in found.collect()) == ["_kept.md", "b.txt", "sub/.git/x.txt", "sub/a.eml"]
    pages = extract.extract_pages(extract.read_contents(spark, extract.classify(found)))
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in pages.collect()}
    assert texts["a.eml"] == "Subject: s\nFrom: \nTo: \nDate: \n\nbody" and texts["b.txt"] == "b.txt"


def test_sniff_and_html():
    assert extract.looks_like_text(b"") and extract.looks_like_text("é\n".encode()) and not extract.looks_like_text(b"a\0b") and not extract.looks_like_text(b"\xff\xfe")
    assert extract.html_to_text("a<script>x<b>y</b></script>b&amp;c") == "ab&c"


def test_office_files(tmp_path):
    docx = tmp_path / "a.docx"
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert extract.DocxExtractor().pages(docx.read_bytes()) == [("one\ntwo", False)]
    xlsx = tmp_path / "a.xlsx"
    with zipfile.ZipFile(xlsx, "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="w"><sheets><sheet name="S"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", '<s xmlns="s"><si><t>x</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="w"><row><c r="A1"><v>1</v></c><c r="C1" t="s"><v>0</v></c></row><row/></w>')
    assert extract.SheetExtractor().pages(xlsx.read_bytes()) == [("Sheet: S\n1 |  | x", False)]
    with pytest.raises(KeyError):
        extract.extractor_for("odt")


def test_embedding_failures_are_rows(spark):
    class Broken:
        dimensions = 4

        def embed_documents(self, texts):
            if "bad" in texts:
                raise OSError("connection refused")
            return [[0.0] * (4 if t != "short" else 3) for t in texts]

    d = spark.createDataFrame([("1", "ok"), ("2", "bad"), ("3", "short")], "input_hash string, text string").coalesce(1)
    got = {r["input_hash"]: (r["success"], r["error_message"]) for r in extract.embed(d, Broken(), batch=1).collect()}
    assert got["1"] == (True, None) and not got["2"][0] and "refused" in got["2"][1] and got["3"] == (False, "wrong dimension")
    v = extract.HashedEmbedding(20).embed_query("x")
    assert len(v) == 20 and sum(x * x for x in v) == pytest.approx(1) and v == extract.HashedEmbedding(20).embed_query("x")


def test_sidecar_roundtrip_and_tampering():
    pages = [{"number": 1, "text": "a --> b\n<!-- corpusloom:page-end {} -->", "meta": {"k": "x--y"}}, {"number": 2, "text": ""}]
    text = sidecar.render({"name": "d"}, pages)
    assert [(p["number"], p["text"], p["meta"]) for p in sidecar.parse(text)["pages"]] == [(1, pages[0]["text"], {"k": "x--y"}), (2, "", {})]
    with pytest.raises(sidecar.SidecarError, match="digest"):
        sidecar.parse(text.replace("a -->", "b -->"))
    for bad in ('{"a":1,"a":2}', '{"a":NaN}'):
        with pytest.raises(sidecar.SidecarError):
            sidecar.strict_json(bad)


def test_run_states_batch_and_stream(spark, tmp_path):
    rows = [(1, 1, "start"), (1, 2, "pause"), (1, 3, "complete"), (1, 4, "resume"), (2, 5, "start"), (2, 6, "complete"), (2, 7, "fail"), (3, 8, "fail")]
    d = spark.createDataFrame(rows, "run_id long, seq long, kind string")
    want = {1: "running", 2: "completed", 3: "queued"}
    assert {r["run_id"]: r["state"] for r in M.fold_runs(d).collect()} == want
    d.write.parquet(str(tmp_path / "in"))
    got = {}
    live = T.run_states(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("update").foreachBatch(lambda b, _: got.update({r["run_id"]: r["state"] for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == want


def test_stream_index(spark, tmp_path):
    listing = spark.createDataFrame([("/a", 1, 1, "h1"), ("/b", 2, 2, "h2")], "path string, size long, mtime_ns long, content_hash string")
    listing.write.parquet(str(tmp_path / "in"))
    known = listing.where("path = '/a'").withColumn("status", F.lit("indexed"))
    got = {}
    q = T.stream_index(spark, str(tmp_path / "in"), str(tmp_path / "c"), known, lambda plan, n: got.update({r["path"]: r["action"] for r in plan.collect()}))
    q.awaitTermination(120)
    assert got == {"/a": "skip_metadata", "/b": "new"}


def test_sql_functions(spark):
    registry.register(spark)
    assert tuple(spark.sql("select cl_basename('a/b'), cl_folder_path('a/b/c'), cl_under_root('/a/b', '/a'), round(cl_idf(4, 1), 4)").first()) == ("b", "a/b", True, 1.6094)


def test_table_functions(spark):
    registry.register(spark)
    got = spark.sql("select piece_no, piece from cl_flat_pieces('abcdefghij', 6, 2)").collect()
    assert [tuple(r) for r in got] == list(enumerate(X.flat_windows("abcdefghij", 6, 2)))
    blocks = spark.sql("select d.id, b.kind from (select 1 as id, '# a\n\ntext' as t) d, lateral cl_markdown_blocks(d.t) b order by b.block_no").collect()
    assert [r["kind"] for r in blocks] == [k for k, _ in X.markdown_blocks("# a\n\ntext")]


def test_entry_works_without_corpus_operators(spark, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "HAVE_LLM", False)
    monkeypatch.setattr(e, "HAVE_PIPELINE", False)
    assert not any(n.startswith("op") for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
