"""Sources: walking folders, classifying files and extracting pages from them."""

from __future__ import annotations

import hashlib
import io
import os
import re
import stat
import zipfile
from collections.abc import Callable, Iterator
from email import policy
from email.parser import BytesParser
from html.entities import html5
from html.parser import HTMLParser
from pathlib import Path
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusloom.functions import scalars as S
from corpusloom.sources import pdf, xls

SNIFF_BYTES, PRINTABLE = 8192, 0.95
FILES = "path string, relative_path string, size long, mtime_ns long, error string"
PAGES = "path string, page_number int, text string, needs_ocr boolean, error string"


def walk(root: str, on_error: Callable[[OSError], None] | None = None, stop: Callable[[], bool] = lambda: False) -> Iterator[Path]:
    """Files in sorted depth-first order. Names that begin with a dot are skipped, folders that do are entered; unreadable folders go to on_error."""
    for folder, subfolders, names in os.walk(root, onerror=on_error):
        subfolders.sort()
        for name in sorted(names):
            if stop():
                return
            if not name.startswith("."):
                yield Path(folder) / name


class _Folder(InputPartition):
    def __init__(self, root: str, part: str | None):
        self.root, self.part = root, part


class _FolderReader(DataSourceReader):
    """One partition per first-level folder, and one for the files beside them; executors do the walking."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as entries:
            folders = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
        return [_Folder(self.root, None), *[_Folder(self.root, name) for name in folders]]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        root = os.path.realpath(self.root)
        bad: list[OSError] = []
        if partition.part:
            paths = walk(os.path.join(root, partition.part), bad.append)
        else:
            names = sorted(n for n in os.listdir(root) if not n.startswith("."))
            paths = (Path(root, n) for n in names if not os.path.isdir(os.path.join(root, n)))
        for p in paths:
            try:
                s = p.stat()
                if stat.S_ISREG(s.st_mode):  # links are followed to files, never into folders
                    yield os.path.realpath(p), str(p.relative_to(root)), s.st_size, s.st_mtime_ns, None
            except OSError as e:  # a broken link or a file that went away is a row, not the end of the scan
                yield str(p), str(p.relative_to(root)), None, None, f"{type(e).__name__}: {e.strerror}"
        for e in bad:
            yield str(e.filename), os.path.relpath(str(e.filename), root), None, None, f"{type(e).__name__}: {e.strerror}"


class FolderSource(DataSource):
    """spark.read.format("corpus_folder").load(path): every file, also those that Spark's own listing hides.

    A file or folder that cannot be read is a row with its error and without size.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"])


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("corpus_folder").load(root)


def looks_like_text(head: bytes) -> bool:
    """Valid UTF-8 without NUL, nearly all printable; empty counts as text."""
    if b"\0" in head:
        return False
    try:
        t = head.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return not t or sum(c.isprintable() or c in "\n\r\t\f" for c in t) / len(t) >= PRINTABLE


def classify(files: DataFrame, path: str = "path", head: str | None = None) -> DataFrame:
    """files with file_type: by suffix, else `text` where the first bytes look like it, else null."""
    kind = S.file_type(path)
    if head:
        sniff = F.pandas_udf(lambda s: s.map(lambda b: looks_like_text(bytes(b)) if b is not None else False), "boolean")
        kind = F.coalesce(kind, F.when(sniff(F.substring(F.col(head), 1, SNIFF_BYTES)), "text"))
    return files.withColumn("file_type", kind)


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _closed(m: re.Match) -> str:
    """A character reference with its semicolon as it is; any other ampersand stands for itself."""
    return m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else f"&amp;{m[1] or ''}"


def html_to_text(html: str | None, closed: bool = False) -> str:
    """Visible text. closed: a character reference without its semicolon, as `&amp` at the end of a title, is text."""
    html = html or ""
    reader = _Visible()
    reader.feed(_REFERENCE.sub(_closed, html) if closed else html)
    reader.close()
    return "".join(reader.out)


def email_to_text(raw: bytes) -> str:
    """Four header lines, an empty line and the body: the plain part, else the HTML part's text. Attachments are dropped."""
    message = BytesParser(policy=policy.default).parsebytes(raw)
    head = "\n".join(f"{h}: {message.get(h, '')}" for h in ("Subject", "From", "To", "Date"))
    body = message.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    return f"{head}\n\n{html_to_text(text) if body is not None and body.get_content_subtype() == 'html' else text}"


class Extractor(Protocol):
    name: str
    version: str

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        """(text, needs_ocr) of each page."""


class TextExtractor:
    name, version = "text", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [(content.decode("utf-8"), False)]


class EmailExtractor:
    name, version = "email", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [(email_to_text(content), False)]


class ImageExtractor:
    name, version = "image", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [("", True)]


def _xml_texts(content: bytes, member: str, unit: str, text: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read(member))
    local = lambda e: e.tag.rpartition("}")[2]
    return ["".join(t.text or "" for t in e.iter() if local(t) == text) for e in tree.iter() if local(e) == unit]


class DocxExtractor:
    """Paragraphs of the main part, one page."""

    name, version = "docx", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [("\n".join(_xml_texts(content, "word/document.xml", "p", "t")), False)]


class SlideExtractor:
    """One page a slide, paragraphs in order; notes follow after `Notes: `."""

    name, version = "slides", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
        numbers = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for k in numbers:
            text = "\n".join(p for p in _xml_texts(content, f"ppt/slides/slide{k}.xml", "p", "t") if p)
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            said = "\n".join(p for p in _xml_texts(content, notes, "p", "t") if p) if notes in names else ""
            out.append((f"{text}\nNotes: {said}" if said else text, False))
        return out


class SheetExtractor:
    """One page a sheet: its name, then rows of cells; empty cells at a row's end and empty rows are dropped."""

    name, version = "sheet", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        local = lambda e: e.tag.rpartition("}")[2]
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in e.iter() if local(t) == "t") for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(e) == "si"]
            titles = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
            out = []
            for k, title in enumerate(titles, 1):
                lines = [f"Sheet: {title}"]
                for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter() if local(e) == "row"):
                    cells = []
                    for c in row:
                        column = 0
                        for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                            column = column * 26 + ord(ch) - 64
                        cells += [""] * (column - 1 - len(cells))
                        value = next((v.text or "" for v in c.iter() if local(v) in ("v", "t")), "")
                        cells.append(shared[int(value)] if c.get("t") == "s" else value)
                    while cells and not cells[-1]:
                        cells.pop()
                    if cells:
                        lines.append(" | ".join(cells))
                out.append(("\n".join(lines), False))
        return out


class PdfExtractor:
    """Text of each page; pages without enough of it need recognition. A file that cannot be opened or has no page is an error."""

    name, version = "pdf", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [(p.text, p.raster >= 0.30 or pdf.garbled(p.text) >= 0.02 or len(p.text.strip()) < 20) for p in pdf.read(content)]


class LegacySheetExtractor:
    """Old binary workbooks, one page a sheet as in SheetExtractor."""

    name, version = "xls", "1"

    def pages(self, content: bytes) -> list[tuple[str, bool]]:
        return [("\n".join([f"Sheet: {name}", *[" | ".join(r) for r in rows if r]]), False) for name, rows in xls.read(content)]


EXTRACTORS: dict[str, Extractor] = {
    **dict.fromkeys(("txt", "md", "text"), TextExtractor()),
    "eml": EmailExtractor(),
    "docx": DocxExtractor(),
    "xlsx": SheetExtractor(),
    "xls": LegacySheetExtractor(),
    "pptx": SlideExtractor(),
    "pdf": PdfExtractor(),
    **dict.fromkeys(("jpg", "jpeg", "png"), ImageExtractor()),
}


def extractor_for(kind: str) -> Extractor:
    if kind not in EXTRACTORS:
        raise KeyError(f"no extractor for {kind!r}")
    return EXTRACTORS[kind]


def extractor_version(kind: str | None) -> str | None:
    """`name:version` of a type's extractor: part of what a stored extraction is keyed by."""
    return f"{EXTRACTORS[kind].name}:{EXTRACTORS[kind].version}" if kind in EXTRACTORS else None


def current_extractor(kind: Column | str) -> Column:
    """extractor_version as an expression over file types."""
    table = F.create_map(*[F.lit(x) for k in sorted(EXTRACTORS) for x in (k, extractor_version(k))])
    return F.try_element_at(table, F.col(kind) if isinstance(kind, str) else kind)


def _pages_of(path: str, kind: str | None, content: bytes) -> list[tuple]:
    """(page_number, text, needs_ocr, image, error) of a file; a file that cannot be read is one row with its error."""
    try:
        found = extractor_for(kind).pages(content)
        if not found:
            raise ValueError("no pages")
        image = content if isinstance(EXTRACTORS[kind], ImageExtractor) else None
        return [(n, t, ocr, image if ocr else None, None) for n, (t, ocr) in enumerate(found, 1)]
    except Exception as e:  # one bad file must not end the job; the row says why
        return [(0, None, False, None, f"{type(e).__name__}: {e}")]


def extract_pages(files: DataFrame) -> DataFrame:
    """path, file_type, content to PAGES; a file that cannot be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, kind, content in zip(b["path"], b["file_type"], b["content"], strict=True):
                rows = [(path, n, t, ocr, error) for n, t, ocr, _, error in _pages_of(path, kind, bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "needs_ocr", "error"])

    return files.select("path", "file_type", "content").mapInPandas(run, PAGES)


#: What read_changed gives: one row a page; a file without pages is one row of page 0.
READ = (
    "path string, content_hash string, file_type string, action string, extractor string, page_number int, text string, "
    "needs_ocr boolean, image binary, error string"
)


#: Files that a task reads, and the rows and bytes that it hands on together.
TASK_FILES, HANDED_ROWS, HANDED_BYTES = 2000, 1000, 4 << 20


def dealt(files: DataFrame) -> DataFrame:
    """A written frame of files by path, dealt over all cores: its rows are small, the work on each is not."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // TASK_FILES))
    return files.repartition(tasks, F.xxhash64("path"))


def read_changed(candidates: DataFrame) -> DataFrame:
    """READ rows of files that may have changed, each read once.

    candidates: path, file_type (null: by its first bytes) and what is known of an indexed file: known_hash, known_extractor. A file
    whose content and extractor are the known ones is `refresh_metadata` and not extracted; others are `new` or `reprocess`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for b in batches:
            for row in b.itertuples(index=False):
                action = "reprocess" if row.known else "new"
                kind, digest, version = row.file_type, None, None
                try:
                    content = Path(row.path).read_bytes()
                    digest = hashlib.sha256(content).hexdigest()
                    kind = kind or ("text" if looks_like_text(content[:SNIFF_BYTES]) else None)
                    version = extractor_version(kind)
                    if row.known_hash == digest and row.known_extractor == version:
                        action, pages = "refresh_metadata", [(0, None, False, None, None)]
                    elif kind is None:
                        pages = [(0, None, False, None, None)]
                    else:
                        pages = _pages_of(row.path, kind, content)
                except OSError as e:
                    pages = [(0, None, False, None, f"{type(e).__name__}: {e.strerror}")]
                for p in pages:
                    rows.append((row.path, digest, kind, action, version, *p))
                    size += sum(len(x) for x in p if isinstance(x, str | bytes))
                    if len(rows) >= HANDED_ROWS or size >= HANDED_BYTES:
                        yield pd.DataFrame(rows, columns=_READ_COLUMNS)
                        rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_READ_COLUMNS)

    needed = candidates.select("path", "file_type", "known", "known_hash", "known_extractor")
    return needed.mapInPandas(run, READ)


_READ_COLUMNS = [f.split(" ")[0] for f in READ.split(", ")]


def read_contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files with content, read by the executors from a file system that they share; null where a file cannot be read."""

    def one(path: str) -> bytes | None:
        try:
            return Path(path).read_bytes()
        except OSError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(len(b)):
                part = b.iloc[k : k + 1]
                yield part.assign(content=[one(part["path"].iloc[0])])

    return files.mapInPandas(run, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def folder_preview(files: DataFrame, most: int = 50_000, order: str = "path") -> DataFrame:
    """Counts and bytes by type over the first `most` files in order, and whether there are more."""
    some = files.orderBy(order).limit(most)
    numbered = some.groupBy("file_type").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return numbered.withColumn("sampled", F.lit(files.select(order).limit(most + 1).count() > most))


class EmbeddingProvider(Protocol):
    dimensions: int

    def embed_documents(self, texts: list[str]) -> list[list[float] | None]: ...

    def embed_query(self, text: str) -> list[float]: ...


class HashedEmbedding:
    """Deterministic unit vectors from a hash of the text; stands in where no model is at hand."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_documents(self, texts: list[str]) -> list[list[float] | None]:
        return [self.embed_query(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        raw = b"".join(hashlib.sha256(f"{k}:{text}".encode()).digest() for k in range(-(-self.dimensions // 16)))
        x = [int.from_bytes(raw[2 * i : 2 * i + 2], "big") - 32767.5 for i in range(self.dimensions)]
        size = sum(v * v for v in x) ** 0.5
        return [v / size for v in x]


def embed(inputs: DataFrame, provider: EmbeddingProvider, batch: int = 16) -> DataFrame:
    """input_hash, text to input_hash, vector, success, error_message: one request per `batch` inputs; a batch that fails or comes back of wrong length or dimension is recorded per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                try:
                    got = provider.embed_documents(list(part["text"]))
                    wrong = None if len(got) == len(part) else f"{len(got)} vectors for {len(part)} inputs"
                except Exception as e:  # the provider's failure belongs to these rows alone
                    got, wrong = [], f"{type(e).__name__}: {e}"
                for k, key in enumerate(part["input_hash"]):
                    v = None if wrong else got[k]
                    bad = wrong or (None if v is not None and len(v) == provider.dimensions else "wrong dimension")
                    rows.append((key, None if bad else v, bad is None, bad))
            yield pd.DataFrame(rows, columns=["input_hash", "vector", "success", "error_message"])

    return inputs.select("input_hash", "text").mapInPandas(run, "input_hash string, vector array<float>, success boolean, error_message string")
