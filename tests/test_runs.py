"""Index runs: what an unchanged or hardly changed folder writes, runs side by side, stops and resumption, a change of provider."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ledger as L
from corpusloom.session import Corpus, Stopped
from corpusloom.settings import Settings
from corpusloom.sources import extract


def folder(tmp_path, name, n=6):
    at = tmp_path / name
    at.mkdir()
    for k in range(n):
        (at / f"f{k}.txt").write_text(f"words of {name} number {k} " + "more paper " * k)
    return at


def open_corpus(spark, tmp_path, **more):
    return Corpus(spark, str(tmp_path / "home"), Settings(dimensions=8), **more)


def paths(corpus):
    return sorted(r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1] for r in corpus.table("files").collect())


def consistent(corpus):
    """Each table's rows belong to files, and the counters are those of the rows."""
    files = corpus.table("files").where("status = 'indexed'").select("file_id")
    chunks, posts = corpus.table("chunks"), corpus.table("postings")
    for rows in (corpus.table("pages"), chunks, corpus.table("totals")):
        assert rows.join(files, "file_id", "left_anti").count() == 0 and rows.select("file_id").distinct().count() == files.count()
    at = corpus.store.manifest()["counters"]
    assert at["text_chunks"] == chunks.count() and at[f"vectors:{corpus.model_key}"] == corpus.vectors().count() == chunks.count()
    assert at["text_n"] == posts.select("chunk_id").distinct().count() and at["text_tokens"] == posts.agg(F.sum("tf")).first()[0]
    assert posts.join(chunks, "chunk_id", "left_anti").count() == 0
    every = corpus.table("files")
    named = corpus.table("names").select("file_id").distinct()
    assert at["files"] == every.count() == named.count() and named.join(every, "file_id", "left_anti").count() == 0


def test_what_is_unchanged_is_not_written(spark, tmp_path):
    one = folder(tmp_path, "one")
    corpus = open_corpus(spark, tmp_path)
    assert corpus.index(str(one))["indexed"] == 6
    before = corpus.store.manifest()
    assert corpus.index(str(one)) == {"indexed": 0, "skipped": 6, "removed": 0, "failed": 0, "walk_errors": 0}
    assert corpus.store.manifest() == before and corpus.table("runs").count() == 2
    (one / "f3.txt").write_text("other words")
    (one / "f4.txt").unlink()
    assert corpus.index(str(one)) == {"indexed": 1, "skipped": 4, "removed": 1, "failed": 0, "walk_errors": 0}
    after = corpus.store.manifest()["tables"]
    for name in ("files", "pages", "chunks", "postings", "vectors"):
        assert after[name]["segments"][:1] == before["tables"][name]["segments"] and len(after[name]["segments"]) == 2
    assert after["files"]["segments"][1]["rows"] == after["pages"]["segments"][1]["rows"] == 1
    assert [g["rows"] for g in after["postings"]["gone"]] == [2]
    consistent(corpus)
    assert [h["path"].rsplit("/", 1)[1] for h in corpus.search("f5", "fts").collect()] == ["f5.txt"] and corpus.search("f4", "fts").count() == 0
    assert corpus.search_many(["words", "more"], 2).count() == 4
    assert corpus.search("other", "fts").count() == 1 and corpus.search("paper", "fts").count() == 3
    ids = [r["chunk_id"] for r in corpus.search("words", "fts").collect()]
    corpus.store.merge(full=True)
    assert len(corpus.store.manifest()["tables"]["files"]["segments"]) == 1
    assert [r["chunk_id"] for r in corpus.search("words", "fts").collect()] == ids


def test_two_runs_keep_each_other_s_files(spark, tmp_path, monkeypatch):
    one, two = folder(tmp_path, "one", 2), folder(tmp_path, "two", 3)
    corpus, other = open_corpus(spark, tmp_path), open_corpus(spark, tmp_path)
    batch = Corpus._batch

    def late(self, run, k):
        if self is corpus:
            assert other.index(str(two))["indexed"] == 3
            with pytest.raises(L.Busy):
                other.index(str(one))
        return batch(self, run, k)

    monkeypatch.setattr(Corpus, "_batch", late)
    assert corpus.index(str(one))["indexed"] == 2
    assert paths(corpus) == ["one/f0.txt", "one/f1.txt", "two/f0.txt", "two/f1.txt", "two/f2.txt"]
    assert corpus.table("files").select("file_id").distinct().count() == 5
    consistent(corpus)
    assert [(r["status"], r["indexed"]) for r in corpus.table("runs").orderBy("run_id").collect()] == [("completed", 2), ("completed", 3), ("cancelled", 0)]


def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch):
    one = folder(tmp_path, "one", 8)
    corpus = open_corpus(spark, tmp_path, batch_bytes=150)
    batch, seen = Corpus._batch, []

    def dies(self, run, k):
        if len(seen) == 2:
            raise KeyboardInterrupt
        seen.append(k)
        batch(self, run, k)

    monkeypatch.setattr(Corpus, "_batch", dies)
    with pytest.raises(KeyboardInterrupt):
        corpus.index(str(one))
    published = corpus.table("files").count()
    assert 0 < published < 8 and corpus.resumable() == []  # its heart has not stopped for long
    later = open_corpus(spark, tmp_path)
    later.ledger.stale = 0
    (left,) = later.resumable()
    assert (left["status"], left["done"]) == ("paused", 2) and left["batches"] > 3
    with pytest.raises(RuntimeError, match="paused"):
        later.search("paper", "fts")
    later.ledger.stale = 300
    corpus.ledger.stale = later.ledger.stale = 0
    seen.clear()
    monkeypatch.setattr(Corpus, "_batch", lambda self, run, k: (seen.append(k), batch(self, run, k)))
    run = later.ledger.resume(left["run_id"])
    later.ledger.stale = 300
    assert later._go(run, lambda: later._listing(str(one)))["indexed"] == 8
    assert seen == list(range(2, left["batches"]))
    assert len(paths(later)) == 8 and later.resumable() == [] and later.search("paper", "fts").count() == 7
    consistent(later)


def test_a_run_pauses_when_asked(spark, tmp_path, monkeypatch):
    one = folder(tmp_path, "one", 4)
    corpus = open_corpus(spark, tmp_path, batch_bytes=60)
    batch = Corpus._batch

    def asked(self, run, k):
        batch(self, run, k)
        if k == 0:
            self.ledger.ask(run.run_id, "pause")

    monkeypatch.setattr(Corpus, "_batch", asked)
    with pytest.raises(Stopped):
        corpus.index(str(one))
    (left,) = corpus.resumable()
    assert left["status"] == "paused" and left["done"] == 1
    assert corpus.resume(left["run_id"])["indexed"] == 4 and len(paths(corpus)) == 4
    with pytest.raises(RuntimeError, match="completed"):
        corpus.resume(left["run_id"])


def test_another_provider_makes_its_own_vectors(spark, tmp_path):
    one = folder(tmp_path, "one", 3)
    corpus = open_corpus(spark, tmp_path)
    corpus.index(str(one))
    key = corpus.model_key
    other = open_corpus(spark, tmp_path, provider=extract.HashedEmbedding(16))
    assert other.model_key != key and other.search("words", "vector").count() == 0
    assert other.index(str(one))["skipped"] == 3
    assert {len(r["embedding"]) for r in other.vectors().collect()} == {16} and other.search("words", "vector").count() == 3
    assert [s["mark"] for s in other.store.manifest()["tables"]["vectors"]["segments"]] == [other.model_key]
    consistent(other)


class Flaky(extract.HashedEmbedding):
    """Fails for one text as long as a file is there."""

    def __init__(self, flag):
        super().__init__(8)
        self.flag = str(flag)

    def embed_documents(self, texts):
        import os

        if os.path.exists(self.flag) and any("f1" in t for t in texts):
            raise ConnectionError("refused")
        return super().embed_documents(texts)


def test_failed_embeddings_are_tried_again(spark, tmp_path):
    one, flag = folder(tmp_path, "one", 2), tmp_path / "flag"
    flag.write_text("")
    corpus = open_corpus(spark, tmp_path, provider=Flaky(flag))
    corpus.index(str(one))
    lost = corpus.table("embedding_errors").collect()
    assert lost and "refused" in lost[0]["error_message"] and corpus.status().first()["embedded"] < 2
    flag.unlink()
    assert corpus.index(str(one))["skipped"] == 2 and corpus.status().first()["embedded"] == 2
    consistent(corpus)
    assert corpus.remove(str(one)) == 2 and corpus.status().first()["embedded"] == 0


def test_texts_of_a_batch_are_not_kept_to_its_end(spark, tmp_path, monkeypatch):
    corpus = open_corpus(spark, tmp_path)
    derived, there = Corpus._derived, []

    def seen(self, *args):
        there.extend(n.rpartition("-")[0] for n in self._staging.names())
        return derived(self, *args)

    monkeypatch.setattr(Corpus, "_derived", seen)
    corpus.index(str(folder(tmp_path, "one", 3)))
    assert "resolved" in there and not {"read", "pages"} & set(there)
    consistent(corpus)
