"""Scalar functions as Spark column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix to type.
FILE_TYPES = {
    ".pdf": "pdf", ".docx": "docx", ".eml": "eml", ".txt": "txt", ".md": "md", ".markdown": "md",
    ".jpg": "jpg", ".jpeg": "jpeg", ".png": "png", ".xlsx": "xlsx", ".xls": "xls", ".pptx": "pptx",
}
#: File type to media type.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "eml": "message/rfc822",
    "txt": "text/plain",
    "md": "text/markdown",
    "text": "text/plain",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
OTHER_MEDIA_TYPE = "application/octet-stream"
#: Utterances that need no search.
CHITCHAT = (
    "hi", "hi there", "hello", "hello there", "hey", "hey there", "good morning", "good afternoon", "good evening", "how are you", "hello how are you",
    "how's it going", "hows it going", "what's up", "whats up", "tell me a joke", "thanks", "thank you", "thanks for your help", "thank you for your help",
    "thanks a lot", "thank you very much", "you're welcome", "youre welcome", "ok", "okay", "got it", "bye", "goodbye",
)
#: Parts of error messages that name a passing failure.
TRANSIENT = ("connecterror", "connection refused", "connection reset", "temporarily unavailable", "timed out", "timeout")
#: Folders of cloud synchronisation clients.
CLOUD_FOLDERS = ("/Library/Mobile Documents/", "/Library/CloudStorage/", "/Dropbox/", "/Google Drive/", "/OneDrive")
SIDECAR_SUFFIX = ".corpusloom.md"
CONTEXT_RECIPE = "1"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _choose(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def folder_path(relative: Column | str) -> Column:
    """Parent of a relative path; empty at the top."""
    return F.regexp_replace(_c(relative), "/?[^/]*$", "")


def safe_folder(relative: Column | str) -> Column:
    """Parent folder with forward slashes; empty for absolute and drive paths."""
    p = F.replace(_c(relative), F.lit("\\"), F.lit("/"))
    return F.when(p.rlike("^/|^[A-Za-z]:/"), "").otherwise(F.regexp_replace(p, "/?[^/]*$", ""))


def portable_path(path: Column | str, relative: Column | str) -> Column:
    """The relative path, or the name alone where only an absolute path is known."""
    r = _c(relative)
    return F.when(r.isNotNull() & ~r.rlike("^/|^[A-Za-z]:"), r).otherwise(basename(path))


def file_type(path: Column | str) -> Column:
    """Type by suffix (case-insensitive), null for other suffixes."""
    return _choose(F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1)), FILE_TYPES)


def media_type(kind: Column | str) -> Column:
    return F.coalesce(_choose(F.lower(F.coalesce(_c(kind), F.lit(""))), MEDIA_TYPES), F.lit(OTHER_MEDIA_TYPE))


def sidecar_name(path: Column | str) -> Column:
    return F.concat(basename(path), F.lit(SIDECAR_SUFFIX))


def is_sidecar(path: Column | str) -> Column:
    return F.lower(basename(path)).endswith(SIDECAR_SUFFIX)


def under_root(path: Column | str, root: Column | str) -> Column:
    """The path is the root or lies beneath it; literal, case-sensitive, no wildcards."""
    p, r = _c(path), root if isinstance(root, Column) else F.lit(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("/")))


def config_hash(config: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def model_key(provider: Column | str, model: Column | str, dimensions: Column | str, config: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", _c(provider), _c(model), _c(dimensions).cast("string"), _c(config)), 256), 1, 32)


def model_key_of(provider: str, model: str, dimensions: int, config: str) -> str:
    """model_key of plain values."""
    return hashlib.sha256(":".join([provider, model, str(dimensions), config]).encode()).hexdigest()[:32]


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def garbled_ratio(text: Column | str) -> Column:
    """Share of replacement and control characters (tab, line feed, carriage return and form feed excepted); 0 for no text."""
    t = _c(text)
    bad = F.length(F.regexp_replace(t, r"[^�\x00-\x08\x0B\x0E-\x1F]", ""))
    return F.when(F.length(t) > 0, bad / F.length(t)).otherwise(F.lit(0.0))


def char_count(text: Column | str) -> Column:
    return F.length(strip(F.coalesce(_c(text), F.lit(""))))


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"\S+"), F.lit(0)))


def non_space_count(text: Column | str) -> Column:
    return F.length(F.regexp_replace(_c(text), r"\s", ""))


def excerpt(text: Column | str, width: int = 80) -> Column:
    """One line of at most `width` characters, cut with three dots."""
    t = strip(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)


def punctuation_only(line: Column | str) -> Column:
    return ~_c(line).rlike(r"[\p{L}\p{N}]")


def is_chitchat(question: Column | str) -> Column:
    q = F.regexp_replace(F.lower(_c(question)), "’", "'")
    q = strip(F.regexp_replace(F.regexp_replace(q, r"[\p{P}\p{S}&&[^']]", " "), r"\s+", " "))
    return q.isin(*CHITCHAT)


def safe_component(name: Column | str) -> Column:
    """A name that is safe in a path: other runs than letters, digits, dot, dash and underscore become one underscore."""
    s = F.regexp_replace(F.regexp_replace(_c(name), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "file").otherwise(s)


def is_transient(error: Column | str) -> Column:
    return F.lower(F.coalesce(_c(error), F.lit(""))).rlike("|".join(TRANSIENT))


def is_cloud_synced(path: Column | str) -> Column:
    found = F.lit(False)
    for folder in CLOUD_FOLDERS:
        found = found | _c(path).contains(folder)
    return found


def is_network_volume(path: Column | str) -> Column:
    return _c(path).startswith("/Volumes/")


def row_to_text(cells: Column | str) -> Column:
    """Cells joined by ' | ', null as empty, empty cells at the end dropped."""
    texts = F.transform(_c(cells), lambda x: F.coalesce(x, F.lit("")))
    last = F.array_max(F.transform(texts, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))))
    return F.array_join(F.slice(texts, 1, F.coalesce(last, F.lit(0))), " | ")


def idf(total: Column | str, df: Column | str) -> Column:
    """ln(1 + N / df), 0 without occurrences."""
    return F.when(_c(df) > 0, F.log1p(_c(total) / _c(df))).otherwise(F.lit(0.0))


def embedding_text(text: Column | str, filename: Column | str, folder: Column | str, media: Column | str, page: Column | str, title: Column | str | None = None, section: Column | str | None = None) -> Column:
    """Context lines, an empty line and the text; lines without value are left out."""

    def line(label: str, value: Column | str | None) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        v = _c(value).cast("string")
        return F.when(v != "", F.concat(F.lit(label + ": "), v))

    head = F.concat_ws("\n", F.lit(f"Recipe: {CONTEXT_RECIPE}"), F.concat(F.lit("File: "), _c(filename)), line("Folder", folder), line("Title", title), F.concat(F.lit("Type: "), _c(media)), F.concat(F.lit("Page: "), _c(page).cast("string")), line("Section", section))
    return F.concat(head, F.lit("\n\n"), _c(text))


def with_instruction(query: Column | str, instruction: str) -> Column:
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), _c(query))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    square = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str, least: float = 1e-10) -> Column:
    """Cosine similarity; a zero vector gives 0, not NaN."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    size = norm(a) * norm(b)
    return dot / F.when(size == 0, F.lit(least)).otherwise(size)


def page_mode(text_source: Column | str, error: Column | str) -> Column:
    s, e = _c(text_source), _c(error)
    return F.when(s.isin("native", "ocr", "merged"), s).when(e.isNotNull() & (e != ""), "failed").otherwise("skipped")


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with one accent and the letters without it, from the character database."""
    pairs = []
    for code in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]:
        c, parts = chr(code), unicodedata.normalize("NFD", chr(code))
        if c == c.lower() and len(parts) > 1 and parts[0].isascii() and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BARE = _accents()


def fold_accents(text: Column | str) -> Column:
    """Lower case, accents of Latin letters dropped."""
    t = _c(text)
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(F.lower(t), ACCENTED, BARE))


def tokenize(text: Column | str, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits, in order; fold: without accents, as a full-text index holds them."""
    return F.regexp_extract_all(fold_accents(text) if fold else F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Bits of a chunk's number within its file; the rest of a chunk id is the file's id.
CHUNK_BITS = 24


def chunk_id(file_id: Column | str, index: Column | str) -> Column:
    """An id that no two chunks share while a file has under 2 ** 24 of them."""
    return F.shiftleft(_c(file_id).cast("long"), CHUNK_BITS) + _c(index).cast("long")


def chunk_file(chunk: Column | str) -> Column:
    """The file of a chunk id."""
    return F.shiftright(_c(chunk).cast("long"), CHUNK_BITS)


#: Fixed value: the version of what a chunk's context is made of.
CONTEXT_RECIPE = "1"


def canonical_source_hash(base: Column | str, filename: Column | str, relative: Column | str, media: Column | str, title: Column | str) -> Column:
    """The content's digest with what else a chunk's context is made of, so that a new name or title makes new chunks."""

    @F.pandas_udf("string")
    def run(b: pd.Series, f: pd.Series, r: pd.Series, m: pd.Series, t: pd.Series) -> pd.Series:
        plain = lambda v: None if pd.isna(v) else v
        rows = zip(b, f, r, m, t, strict=True)
        names = ("filename", "relative_path", "media_type", "title")
        made = [(x[0], {"context_recipe_version": CONTEXT_RECIPE, **dict(zip(names, map(plain, x[1:]), strict=True))}) for x in rows]
        return pd.Series([hashlib.sha256(f"{d}\x1d{json.dumps(p, sort_keys=True)}".encode()).hexdigest() for d, p in made])

    return run(*map(_c, (base, filename, relative, media, title)))


def image_evidence(boxes: Column | str, page_area: Column | str) -> Column:
    """struct(max_coverage, summed_coverage, union_coverage, images) of the image boxes (x0, y0, x1, y1) on a page.

    Sums and unions stop at 1; union_coverage is null on pages without area and where there are too many boxes to unite.
    """
    b, area = _c(boxes), _c(page_area).cast("double")
    share = F.transform(b, lambda x: F.abs((x[2] - x[0]) * (x[3] - x[1])).cast("double") / area)
    none, empty = area.isNull() | (area <= 0), F.size(b) <= 0

    @F.pandas_udf("double")
    def united(rows: pd.Series) -> pd.Series:
        return pd.Series([union_area([tuple(map(float, x)) for x in r]) for r in rows], dtype="float64")

    total, union = F.aggregate(share, F.lit(0.0), lambda s, x: s + x), united(b)
    known = union.isNotNull() & ~F.isnan(union)
    return F.struct(
        F.when(none | empty, 0.0).otherwise(F.array_max(share)).alias("max_coverage"),
        F.when(none | empty, 0.0).otherwise(F.least(total, F.lit(1.0))).alias("summed_coverage"),
        F.when(none, None).when(empty, 0.0).when(known, F.least(union / area, F.lit(1.0))).alias("union_coverage"),
        F.greatest(F.size(b), F.lit(0)).alias("images"),
    )


def union_area(rectangles: list[tuple[float, float, float, float]], most: int = 512) -> float | None:
    """Area covered by axis-parallel rectangles (x0, y0, x1, y1); None where more than `most` are given."""
    boxes = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rectangles]
    boxes = [r for r in boxes if r[2] > r[0] and r[3] > r[1]]
    if len(boxes) > most:
        return None
    xs = sorted({x for r in boxes for x in (r[0], r[2])})
    area = 0.0
    for left, right in zip(xs, xs[1:], strict=False):
        covered, reach = 0.0, -math.inf
        for lo, hi in sorted((r[1], r[3]) for r in boxes if r[0] <= left and right <= r[2]):
            covered += max(0.0, hi - max(lo, reach))
            reach = max(reach, hi)
        area += (right - left) * covered
    return area
