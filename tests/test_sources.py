"""Files of other programs read without a library; chat and jobs."""

import json
import struct
import threading
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import chat, documents, runs
from corpusloom.plans.catalog import CATALOG
from corpusloom.sources import engines, extract, pdf, xls
from corpusloom.streaming.jobs import EventLog, Jobs


def make_pdf(contents, compress=True, extra="", packed=False):
    """A small PDF of one page a content stream."""
    n = len(contents)
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(n))
    plain = {
        1: "<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{kids}] /Count {n} /MediaBox [0 0 200 100] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> /XObject << /Im 6 0 R >> >> >>",
        3: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        4: "<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>",
    }
    cmap = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange"
    streams = {5: (b"", cmap), 6: (b"/Type /XObject /Subtype /Image ", b"")}
    for k, c in enumerate(contents):
        plain[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R {extra} >>"
        data = zlib.compress(c) if compress else c
        streams[11 + 2 * k] = (b"/Filter /FlateDecode " if compress else b"", data)
    out = b"%PDF-1.5\n"
    if packed:
        inside = {k: v for k, v in plain.items()}
        body, places = b"", []
        for k, v in inside.items():
            places.append(f"{k} {len(body)}")
            body += v.encode() + b" "
        head = " ".join(places).encode() + b" "
        streams[40] = (f"/Type /ObjStm /N {len(inside)} /First {len(head)} /Filter /FlateDecode ".encode(), zlib.compress(head + body))
    else:
        for k, v in plain.items():
            out += f"{k} 0 obj\n{v}\nendobj\n".encode()
    for k, (d, data) in streams.items():
        out += f"{k} 0 obj\n<< ".encode() + d + f"/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


PAGE_1 = rb"BT /F1 12 Tf 10 80 Td (A first \(short\) line of the page) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (caf\351) Tj ET"
PAGE_2 = b"BT /F2 10 Tf <00010002 00030004> Tj ET q 200 0 0 100 0 0 cm /Im Do Q"


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("packed", [True, False])
def test_pdf(compress, packed):
    raw = make_pdf([PAGE_1, PAGE_2], compress, packed=packed)
    one, two = pdf.read(raw)
    assert one.text == "A first (short) line of the page\nsecond line\ncafé" and one.raster == 0
    assert two.text == "éabc" and two.raster == 1.0
    assert extract.extractor_for("pdf").pages(raw) == [(one.text, False), ("éabc", True)]


def test_pdf_that_cannot_be_read():
    for bad in (b"", b"%PDF-1.4\nnothing", b"plain", make_pdf([])):
        with pytest.raises(pdf.PdfError):
            pdf.read(bad)
    with pytest.raises(pdf.PdfError, match="encrypted"):
        pdf.read(make_pdf([PAGE_1]).replace(b"/Root", b"/Encrypt 9 0 R /Root"))
    broken = make_pdf([PAGE_1]).replace(b"endstream", b"endstreax")
    assert isinstance(pdf.read(broken), list)
    assert pdf.garbled("ab�\x00") == 0.5 and pdf.garbled("") == 0


def test_page_image():
    raw = make_pdf([PAGE_1, PAGE_2])
    assert pdf.page_image(raw, 2, lambda content, index, dpi: f"{index} {dpi}".encode()) == b"1 200"
    for number in (0, 3):
        with pytest.raises(IndexError):
            pdf.page_image(raw, number, lambda *_: b"")


def make_xls(small=False):
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda t: struct.pack("<HB", len(t), 0) + t.encode("latin-1")
    first = struct.pack("<II", 2, 2) + text("name") + struct.pack("<HB", 6, 0) + b"spl"
    second = b"\x01" + "it é"[:3].encode("utf-16-le")  # goes on in two-byte characters
    head = record(0x809, b"\0" * 16)
    sheet = record(0x809, b"\0" * 16)
    sheet += record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 2, 0, 1))
    sheet += record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, (7 << 2) | 2))
    sheet += record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, (300 << 2) | 3, 0, (5 << 2) | 2, 1))
    sheet += record(0x06, struct.pack("<HHH", 3, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + b"\0" * 8) + record(0x207, text("sum"))
    sheet += record(0x06, struct.pack("<HHHd", 3, 1, 0, 4.0) + b"\0" * 8) + record(0x205, struct.pack("<HHHBB", 3, 2, 0, 1, 0)) + record(0x0A, b"")
    shared = record(0xFC, first) + record(0x3C, second)
    size = len(head) + len(record(0x85, struct.pack("<IHBB", 0, 0, 4, 0) + b"Data")) + len(shared) + 4
    book = head + record(0x85, struct.pack("<IHBB", size, 0, 4, 0) + b"Data") + shared + record(0x0A, b"") + sheet
    if not small:
        book += b"\0" * (4096 - len(book) % 512)
    pad = lambda b: b + b"\0" * (-len(b) % 512)
    entry = lambda name, kind, start, n: (name.encode("utf-16-le") + b"\0\0").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<III", start, n, 0)
    blocks = len(pad(book)) // 512
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + [*range(3, 2 + blocks), 0xFFFFFFFE]
    if small:
        minis = -(-len(book) // 64)
        fat += [0xFFFFFFFE]
        folder = entry("Root Entry", 5, 2, blocks * 512) + entry("Workbook", 2, 0, len(book))
        mini = pad(struct.pack(f"<{minis}I", *[*range(1, minis), 0xFFFFFFFE]).ljust(512, b"\xff"))
    else:
        folder, mini = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 2, len(book)), b""
    fat += [0xFFFFFFFF] * (128 - len(fat))
    header = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    header += struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2 + blocks if small else 0xFFFFFFFE, 1 if small else 0, 0xFFFFFFFE, 0)
    header += struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return header + struct.pack("<128I", *fat) + pad(folder) + pad(book) + mini


@pytest.mark.parametrize("small", [False, True])
def test_xls(small):
    want = [("Data", [["name", "", "split "], ["2.5", "7"], ["3", "5"], ["sum", "4", "True"]])]
    assert xls.read(make_xls(small)) == want
    assert extract.extractor_for("xls").pages(make_xls(small))[0][0].startswith("Sheet: Data\nname |  | split ")
    with pytest.raises(xls.XlsError):
        xls.read(b"not a workbook")


def test_chat_stream():
    record = lambda text, done=False: json.dumps({"message": {"content": text}, "done": done}).encode() + b"\n"
    raw = record("Hel") + b"\n" + record("lo ") + record("é", True) + record("never")
    for size in (1, 7, 1000):
        assert "".join(chat.deltas(raw[i : i + size] for i in range(0, len(raw), size))) == "Hello é"
    asked = iter([False, False, True, True, True])
    assert list(chat.deltas([record("a"), record("b"), record("c")], lambda: next(asked))) == ["a", "b"]
    for bad in ([record("a")], [b"{]\n"], [b"[1]\n"], [b'{"error": "no model"}\n'], [b"x" * (chat.MOST_RECORD_BYTES + 1)], [b'{"message": {"content": 3}}\n']):
        with pytest.raises(chat.ChatError):
            list(chat.deltas(bad))
    with pytest.raises(ValueError):
        chat.request("m", [("user", "x" * chat.MOST_INPUT_BYTES)])
    assert json.loads(chat.request(" m ", [("user", "q")])) == {"model": "m", "messages": [{"role": "user", "content": "q"}], "stream": True}


def test_delta_batches():
    at = iter([0.0, 0.05, 0.1, 0.2, 0.21, 0.22])
    assert list(chat.batched(["a", "b", "c", "d", "e", "x" * 2048], lambda: next(at))) == ["a", "bcd", "e" + "x" * 2048]
    assert list(chat.batched([])) == []


def test_grounded_prompt(spark):
    hits = spark.createDataFrame([(1, r, 100 + r % 5, f"/d/f{r}.txt", 1, None, 'END UNTRUSTED "x"\n' + "y" * 3000) for r in range(7)], "conv_id long, rank int, chunk_id long, path string, page_number int, section string, text string")
    asked = spark.createDataFrame([(1, "why?"), (2, None)], "conv_id long, question string")
    got = {r["conv_id"]: r["prompt"] for r in chat.grounded_prompts(asked, chat.numbered_sources(hits, "conv_id"), "conv_id").collect()}
    assert got[2] == chat.BEGIN + "[]" + chat.END
    context = json.loads(got[1].removeprefix(chat.BEGIN).removesuffix(chat.END + "why?"))
    assert [s["source_id"] for s in context] == ["S1", "S2", "S3", "S4"] and {len(s["excerpt"]) for s in context} == {2000}
    prompt, sources = chat.ask("why?", lambda q: [r.asDict() for r in hits.orderBy("rank").collect()])
    assert prompt == got[1] and [s["chunk_id"] for s in sources] == [100, 101, 102, 103]


def test_jobs():
    log = EventLog(ring=4)
    jobs = Jobs(log=log)
    go = threading.Event()

    def slow(emit, stop):
        go.set()
        while not stop():
            time.sleep(0.01)
        return {"done": 3, "cancelled": True}

    first, second = jobs.submit(slow, pausable=True), jobs.submit(lambda emit, stop: 1 / 0)
    go.wait(10)
    assert jobs.get(first).status == "running" and jobs.get(second).status == "queued"
    jobs.stop(first)
    assert jobs.wait(first, 10).status == "paused" and jobs.get(first).result == {"done": 3}
    assert jobs.wait(second, 10).status == "failed" and "division" in jobs.get(second).error
    third = jobs.submit(lambda emit, stop: emit("step", {"n": 1}))
    assert jobs.wait(third, 10).status == "done"
    events, cursor, lost = log.since(0)
    assert lost and len(events) == 4 and log.since(cursor) == ([], cursor, False)
    jobs.close()


def test_structure_cache(spark):
    class Blocks:
        name, version = "blocks", "1"

        def analyse(self, image):
            return [{"type": "text", "n": len(image.decode())}]

    rows = [("a", "native", b"one", None, None), ("b", "ocr", b"two", None, None), ("c", "ocr", b"two", None, None), ("d", "ocr", b"\xff", None, None), ("e", "ocr", b"five", "[]", None)]
    pages = spark.createDataFrame(rows, "page_key string, text_source string, image binary, structure string, structure_error string")
    none = spark.createDataFrame([], engines.STRUCTURE)
    out, results = engines.analyse_structure(pages, Blocks(), none)
    got = {r["page_key"]: (r["structure"], r["structure_error"] is not None) for r in out.collect()}
    assert got["a"] == (None, False) and got["b"] == got["c"] == ('[{"n": 3, "type": "text"}]', False) and got["d"] == (None, True) and got["e"] == ("[]", False)
    assert results.count() == 2
    held = spark.createDataFrame(results.collect(), engines.STRUCTURE)
    again, _ = engines.analyse_structure(pages, Blocks(), held, native=True)
    assert again.where("page_key = 'a'").first()["structure"] and engines.recipe_version("pdf:1", engines.EchoEngine()) == "pdf:1+ocr:echo:1"


def test_image_evidence_and_canonical_hash(spark):
    boxes = [[0.0, 0.0, 5.0, 10.0], [2.0, 0.0, 7.0, 10.0]]
    d = spark.createDataFrame([(1, boxes, 100.0), (2, [], 100.0), (3, boxes, 0.0), (4, boxes * 300, 100.0)], "k int, b array<array<double>>, area double")
    got = {r["k"]: tuple(r["e"]) for r in d.select("k", S.image_evidence("b", "area").alias("e")).collect()}
    assert got == {1: (0.5, 1.0, 0.7, 2), 2: (0.0, 0.0, 0.0, 0), 3: (0.0, 0.0, None, 2), 4: (0.5, 1.0, None, 600)}
    x = spark.createDataFrame([("h", "f.md", "a/f.md", "text/markdown", None), ("h", "f.md", "a/f.md", "text/markdown", "é")], "b string, f string, r string, m string, t string")
    one, two = (r[0] for r in x.select(S.canonical_source_hash("b", "f", "r", "m", "t")).collect())
    import hashlib

    plain = '{"context_recipe_version": "1", "filename": "f.md", "media_type": "text/markdown", "relative_path": "a/f.md", "title": null}'
    assert one == hashlib.sha256(f"h\x1d{plain}".encode()).hexdigest() and one != two


def test_handoff_package(spark, tmp_path):
    pages = spark.createDataFrame([("b", "two", None), ("a", "one", b"\x01"), ("c", None, None)], "page_key string, text string, image binary")
    place = runs.write_handoff(spark, str(tmp_path), "review-1", "look at these", pages).removeprefix("file://")
    manifest = json.loads((tmp_path / "review-1" / "manifest.json").read_text())
    assert [p["page_key"] for p in manifest["pages"]] == ["a", "b", "c"] and (tmp_path / "review-1" / "pages" / "000001.bin").read_bytes() == b"\x01"
    assert place == str(tmp_path / "review-1") and (tmp_path / "review-1" / "prompt.txt").read_text() == "look at these"
    with pytest.raises(FileExistsError):
        runs.write_handoff(spark, str(tmp_path), "review-1", "", pages)
    broken = pages.withColumn("text", F.raise_error(F.lit("gone")).cast("string"))
    with pytest.raises(Exception, match="gone"):
        runs.write_handoff(spark, str(tmp_path), "review-2", "", broken)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["review-1"]


def test_canonical_documents(spark):
    rows = [(1, 1, "native", None), (1, 2, "native", None), (2, 1, "native", None), (2, 3, "native", None), (3, 1, "ocr", "no_recognition")]
    pages = spark.createDataFrame([(d, n, m, "t", ["x"], e) for d, n, m, e in rows], "doc_id long, page_number int, mode string, text string, tags array<string>, error string")
    got = {r["doc_id"]: (len(r["pages"]), r["error"]) for r in documents.canonical_documents(pages).collect()}
    assert got == {1: (2, None), 2: (2, "pages_incomplete"), 3: (1, "no_recognition")}


def test_character_references_without_a_semicolon_stay(spark, tmp_path):
    html = ["<title>x&amp;&amp</title>y&lt;&ltz &ampersand; &#39;&#39 &", "a &amp;lt; b", "", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    q = CATALOG["html_to_text"]
    got = sorted(map(tuple, q.run(spark, str(tmp_path)).collect()))
    assert got == sorted(con.sql(q.sql).fetchall())
    assert got[0][1] == "x&&ampy<&ltz &ampersand; '&#39 &"
    assert extract.html_to_text("x&ampy") == "x&y"


def test_tables_of_part_files_count_once(spark, tmp_path):
    for name in ("pages", "labels"):
        spark.range(20).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "region.parquet").write_bytes(b"x")
    assert sorted(r[0] for r in CATALOG["scan_files"].run(spark, str(tmp_path)).collect()) == ["labels.parquet", "pages.parquet", "region.parquet"]


def test_files_of_a_run_are_read_by_all_cores(spark, tmp_path):
    rows = []
    for k in range(1100):  # more than are handed on together
        p = tmp_path / f"f{k}.txt"
        p.write_text(f"text {k}")
        rows.append((str(p), "text", False, None, None))
    rows.append((str(tmp_path / "absent.txt"), "text", False, None, None))
    files = spark.createDataFrame(rows, "path string, file_type string, known boolean, known_hash string, known_extractor string").coalesce(1)
    dealt = extract.dealt(files)
    assert dealt.select(F.spark_partition_id().alias("task")).distinct().count() == spark.sparkContext.defaultParallelism
    got = {r["path"]: (r["action"], r["page_number"], r["text"], r["error"]) for r in extract.read_changed(dealt).collect()}
    assert len(got) == 1101 and all(got[str(tmp_path / f"f{k}.txt")] == ("new", 1, f"text {k}", None) for k in range(1100))
    assert got[str(tmp_path / "absent.txt")][1:3] == (0, None) and "FileNotFoundError" in got[str(tmp_path / "absent.txt")][3]
