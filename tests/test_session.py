import io
import os
import zipfile

import pytest

from corpusloom.session import Corpus, Stopped
from corpusloom.settings import Settings, format_table, load_settings, log_tail
from corpusloom.sources import engines, extract


def fill(folder):
    (folder / "sub").mkdir(parents=True)
    (folder / "report.md").write_text("# Budget\n\nThe yearly budget grows.\n\n## Costs\n\nCosts of paper and ink.")
    (folder / "sub" / "note.txt").write_text("paper boats float")
    (folder / "bad.docx").write_bytes(b"not a zip")
    (folder / "raw.bin").write_bytes(b"\0\1\2")


def names(rows):
    return [r["path"].rsplit("/", 1)[1] for r in rows]


def test_index_search_update(spark, tmp_path):
    folder = tmp_path / "docs"
    fill(folder)
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16))
    assert corpus.index(str(folder)) == {"indexed": 4, "skipped": 0, "removed": 0, "failed": 1, "walk_errors": 0}
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in corpus.table("files").collect()} == {
        "report.md": "indexed", "note.txt": "indexed", "bad.docx": "failed", "raw.bin": "unsupported",
    }
    hits = corpus.search("paper", "fts").collect()
    assert set(names(hits)) == {"report.md", "note.txt"} and all("aper" in h["excerpt"] for h in hits)
    assert names(corpus.search("report", "fts").collect()) == ["report.md"]
    assert "report.md" in names(corpus.search("report", "hybrid", 3).collect())
    assert corpus.read_document(str(folder / "sub" / "note.txt")).first()["text"] == "paper boats float"
    assert corpus.index(str(folder))["skipped"] == 2  # what failed or was not supported is tried again
    (folder / "sub" / "note.txt").write_text("stone boats sink fast")
    (folder / "report.md").unlink()
    done = corpus.index(str(folder))
    assert done["removed"] == 1 and corpus.search("paper", "fts").count() == 0 and corpus.search("stone", "fts").count() == 1
    row = corpus.status().first()
    assert row["files"] == 3 and row["indexed"] == 1 and row["chunks"] == row["embedded"] == 1
    assert row["run_status"] == "completed" and row["run_started_at"] is not None
    assert [p for p in os.listdir(tmp_path / "home") if p.startswith("_staging")] == []
    assert corpus.remove(str(folder)) == 3 and corpus.status().first()["chunks"] == 0


def test_the_same_folder_elsewhere_ranks_alike(spark, tmp_path):
    found = []
    for place in ("one", "another/deep"):
        fill(tmp_path / place / "docs")
        corpus = Corpus(spark, str(tmp_path / place / "home"), Settings(dimensions=16))
        corpus.index(str(tmp_path / place / "docs"))
        found.append([(h["file_id"], h["chunk_id"], h["score"], h["excerpt"]) for h in corpus.search("report paper", "fts").collect()])
        ids = {r["relative_path"]: r["file_id"] for r in corpus.table("files").collect()}
        assert ids == {"bad.docx": 1, "raw.bin": 2, "report.md": 3, "sub/note.txt": 4}
    assert found[0] == found[1] and found[0]


def test_what_cannot_be_listed_is_counted_and_kept(spark, tmp_path, monkeypatch):
    folder = tmp_path / "docs"
    fill(folder)
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16))
    corpus.index(str(folder))
    (folder / "broken.txt").symlink_to(tmp_path / "nowhere")
    assert corpus.index(str(folder))["walk_errors"] == 1
    rows = [(str(folder / "sub"), "sub", None, None, "PermissionError: denied")]
    listing = corpus._listing
    hidden = lambda root: listing(root).where("relative_path not like 'sub/%'").unionByName(spark.createDataFrame(rows, extract.FILES))
    monkeypatch.setattr(corpus, "_listing", hidden)
    done = corpus.index(str(folder))
    assert done["removed"] == 0 and done["walk_errors"] == 2 and "note.txt" in names(corpus.table("files").collect())


def test_unchanged_files_are_not_read(spark, tmp_path):
    folder = tmp_path / "docs"
    fill(folder)
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16))
    corpus.index(str(folder))
    note = folder / "sub" / "note.txt"
    at = note.stat()
    note.write_text("paper boats FLOAT")  # same size; with the old time it counts as unchanged
    os.utime(note, ns=(at.st_atime_ns, at.st_mtime_ns))
    assert corpus.index(str(folder))["skipped"] == 2 and corpus.read_document(str(note)).first()["text"] == "paper boats float"
    assert corpus.index(str(folder), verify=True)["indexed"] == 3 and corpus.read_document(str(note)).first()["text"] == "paper boats FLOAT"
    os.utime(note, ns=(at.st_atime_ns, at.st_mtime_ns + 10**9))
    assert corpus.index(str(folder)) == {"indexed": 2, "skipped": 2, "removed": 0, "failed": 1, "walk_errors": 0}


def test_retry_remove_one_and_stop(spark, tmp_path):
    folder = tmp_path / "docs"
    fill(folder)
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16))
    corpus.index(str(folder))
    assert corpus.retry_failed(str(folder))["failed"] == 1
    (folder / "bad.docx").write_bytes(docx("mended"))
    assert corpus.retry_failed(str(folder)) == {"indexed": 1, "skipped": 0, "removed": 0, "failed": 0, "walk_errors": 0}
    assert names(corpus.search("mended", "fts").collect()) == ["bad.docx"]
    assert corpus.remove_file(str(folder / "bad.docx")) and corpus.search("mended", "fts").count() == 0
    corpus.index(str(folder))
    assert "bad.docx" not in names(corpus.table("files").collect())
    corpus.include_file(str(folder / "bad.docx"))
    assert corpus.index(str(folder))["indexed"] == 2
    stopped = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16), stop=lambda: True)
    with pytest.raises(Stopped):
        stopped.index(str(folder), verify=True)
    assert stopped.status().first()["files"] == 4


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_recognition_in_the_run(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "scan.png").write_bytes(b"words in a picture of text")
    (folder / "noise.jpg").write_bytes(b"\xff\xfe")
    weak, strong = engines.EchoEngine("weak", 0.5), engines.EchoEngine("strong", 0.9)
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16), engines=[weak, strong])
    assert corpus.index(str(folder))["indexed"] == 2
    hits = corpus.search("picture", "fts").collect()
    assert names(hits) == ["scan.png"] and hits[0]["source_type"] == "ocr"
    warned = {r["path"].rsplit("/", 1)[1]: r["warning"] for r in corpus.table("files").collect()}
    assert warned == {"scan.png": None, "noise.jpg": "1 of 1 pages could not be recognised"}
    assert {(r["engine"], r["success"]) for r in corpus.table("ocr").collect()} == {("weak:1", True), ("weak:1", False), ("strong:1", True), ("strong:1", False)}


def test_markdown_route(spark, tmp_path):
    folder = tmp_path / "docs"
    fill(folder)
    (folder / "mail.eml").write_text("Subject: s\n\nbody")
    corpus = Corpus(spark, str(tmp_path / "home"), Settings(dimensions=16))
    first = {"create": 2, "failed": 1, "unsupported": 1, "deferred": 1}
    assert corpus.generate_markdown(str(folder)) == first
    assert corpus.generate_markdown(str(folder)) == {"skip_unchanged": 2, "failed": 1, "unsupported": 1, "deferred": 1}
    assert corpus.index_sidecars(str(folder)) == {"indexed": 2, "skipped": 0, "removed": 0, "failed": 0}
    assert set(names(corpus.search("paper", "fts").collect())) == {"report.md", "note.txt"}
    assert corpus.index_sidecars(str(folder))["skipped"] == 2
    (folder / "sub" / "note.txt").write_text("another text")
    assert corpus.index_sidecars(str(folder))["failed"] == 1  # the sidecar no longer fits its source: nothing is published
    assert corpus.search("another", "fts", 1).count() == 0 if corpus.status().first()["run_status"] == "completed" else True
    assert corpus.generate_markdown(str(folder))["update"] == 1
    assert corpus.index_sidecars(str(folder)) == {"indexed": 1, "skipped": 1, "removed": 0, "failed": 0}
    assert names(corpus.search("another", "fts").collect()) == ["note.txt"]
    side = folder / "report.md.corpusloom.md"
    side.write_text(side.read_text().replace('"status":"generated"', '"status":"final"').replace('"if_source_changed"', '"never"'))
    assert corpus.generate_markdown(str(folder))["skip_final"] == 1
    (folder / "sub" / "note.txt.corpusloom.md").write_text("mine")
    assert corpus.generate_markdown(str(folder))["conflict"] == 1
    assert corpus.remove_file(str(folder / "report.md")) and side.exists()


def test_engines(spark):
    class Broken:
        name, version = "broken", "1"

        def recognise(self, image):
            raise TimeoutError("timed out")

    pages = spark.createDataFrame([("a", b"one"), ("b", b"two"), ("c", b"\xff")], "page_key string, image binary")
    weak, strong = engines.EchoEngine("weak", 0.6), engines.EchoEngine("strong", 0.9)
    assert {r["page_key"]: r["engine"] for r in engines.recognise_tiers(pages, [strong, weak]).collect()} == {"a": "strong", "b": "strong"}
    assert {r["page_key"]: r["engine"] for r in engines.recognise_tiers(pages, [weak, Broken()]).collect()} == {"a": "weak", "b": "weak"}
    failed = engines.recognise(pages, Broken()).cache()
    assert failed.where("success").count() == 0
    again = engines.recognise_cached(pages, engines.EchoEngine("broken"), failed)
    assert again.where("success").count() == 2
    todo = spark.createDataFrame([("a", "native text", "native"), ("b", "known words", "merge"), ("c", "", "page"), ("a", "x", "native_plus_page")], "page_key string, text string, action string")
    got = [(r["text_source"], r["ocr_error"]) for r in engines.resolve_pages(todo, again).orderBy("action", "page_key").collect()]
    assert got[0] == ("merged", None) and ("native", None) in got and got[-1][0] == "none" and got[-1][1]


def test_settings(tmp_path):
    p = tmp_path / "s.toml"
    p.write_text('chunk_size = 500\ntop_k = "many"\nroots = ["/a"]\nunknown = 1\n')
    s = load_settings(p)
    assert (s.chunk_size, s.top_k, s.roots) == (500, 10, ["/a"]) and load_settings(tmp_path / "none").chunk_size == 1000
    (tmp_path / "log").write_text("a\nb\nc\n")
    assert log_tail(tmp_path / "log", 2) == ["b", "c"] and log_tail(tmp_path / "no") == []
    assert format_table(["a", "bb"], [[1, None], ["xyz", 2]]) == "a    bb\n---  --\n1\nxyz  2"
