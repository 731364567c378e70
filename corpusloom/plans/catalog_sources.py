"""Queries over sources and sinks: office files, recognition, sidecar runs, JSON rules, streams of answers."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from html import escape
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import chat
from corpusloom.operators import retrieval as R
from corpusloom.operators import state as M
from corpusloom.operators import text as X
from corpusloom.plans.catalog_text import _suffixed
from corpusloom.plans.model import documents, files, query, table
from corpusloom.session import Corpus
from corpusloom.settings import Settings
from corpusloom.shared import local_path, shared_root
from corpusloom.sources import engines, extract, sidecar

#: What XML cannot hold, and what ends a line elsewhere than at a line feed, as one class for patterns of both engines.
_ODD = r"[\x00-\x09\x0b-\x1f\x{7f}-\x{9f}\x{2028}\x{2029}\x{fffe}\x{ffff}]"
_CLEAN = f"regexp_replace(coalesce(text, ''), '{_ODD}', ' ', 'g')"


def _clean(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), _ODD, " ").alias("text"))


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def _docx(text: str) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})


def _pptx(text: str) -> bytes:
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sld>'
    return _zipped({f"ppt/slides/slide{k}.xml": slide(line) for k, line in enumerate(text.split("\n"), 1)})


def _xlsx(text: str) -> bytes:
    rows = "".join(f'<row><c r="A{k}" t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for k, x in enumerate(text.split("\n"), 1))
    book = '<w xmlns="w"><sheets><sheet name="Lines"/></sheets></w>'
    return _zipped({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": f'<w xmlns="w">{rows}</w>'})


def _made(s: SparkSession, d: str, kind: str, make) -> DataFrame:
    """Every document as a file of a type, extracted again."""
    build = F.pandas_udf(lambda t: t.map(make), "binary")
    f = _clean(s, d).select(F.col("doc_id").cast("string").alias("path"), F.lit(kind).alias("file_type"), build("text").alias("content"))
    return extract.extract_pages(f).select("path", "page_number", F.sha2("text", 256).alias("digest"), "error")


_PAGE = "SELECT CAST(doc_id AS VARCHAR) AS path, {} AS page_number, sha256({}) AS digest, CAST(NULL AS VARCHAR) AS error FROM {}"


@query("extract_docx", _PAGE.format("1", _CLEAN, "documents"))
def _(s, d):
    return _made(s, d, "docx", _docx)


@query("extract_pptx", _PAGE.format("CAST(k AS INTEGER)", "l[k]", f"(SELECT doc_id, l, unnest(generate_series(1, len(l))) AS k FROM (SELECT doc_id, string_split({_CLEAN}, chr(10)) AS l FROM documents))"))
def _(s, d):
    return _made(s, d, "pptx", _pptx)


@query(
    "extract_xlsx",
    _PAGE.format(
        "1", "'Sheet: Lines' || CASE WHEN len(l) > 0 THEN chr(10) || array_to_string(l, chr(10)) ELSE '' END",
        f"(SELECT doc_id, list_filter(string_split({_CLEAN}, chr(10)), lambda x: x <> '') AS l FROM documents)",
    ),
)
def _(s, d):
    return _made(s, d, "xlsx", _xlsx)


@query(
    "extractor_registry",
    "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'text:1' WHEN 1 THEN 'pdf:1' WHEN 2 THEN 'email:1' WHEN 4 THEN 'text:1' WHEN 5 THEN 'docx:1' END AS extractor FROM documents",
)
def _(s, d):
    return _suffixed(s, d).select("doc_id", extract.current_extractor(S.file_type("path")).alias("extractor"))


@query(
    "recognise_tiers",
    "SELECT CAST(doc_id AS VARCHAR) AS page_key, CASE WHEN doc_id % 3 = 0 THEN 'strong:1' ELSE 'weak:1' END AS engine, sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
)
def _(s, d):
    """Texts as pictures of themselves: a weak engine that is sure of two thirds, and a strong one for the rest."""

    class Weak(engines.EchoEngine):
        def recognise(self, image):
            sure = int(image.split(b"\n", 1)[0]) % 3 != 0
            return engines.Recognised(image.decode().split("\n", 1)[1], 0.9 if sure else 0.2)

    class Strong(Weak):
        def recognise(self, image):
            return engines.Recognised(image.decode().split("\n", 1)[1], 0.99)

    doc = F.col("doc_id").cast("string")
    p = documents(s, d).where("text is not null").select(doc.alias("page_key"), F.encode(F.concat(doc, F.lit("\n"), "text"), "UTF-8").alias("image"))
    root = f"{shared_root(s)}/recognise-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return s.read.schema(df.schema).parquet(f"{root}/{name}")

    found, _all = engines.recognise_pages(p, [Weak("weak"), Strong("strong")], s.createDataFrame([], engines.RESULT), keep)
    return found.select("page_key", "engine", F.sha2("text", 256).alias("digest"))


@query(
    "structure_cache",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' WHEN doc_id % 4 = 1 THEN NULL WHEN n_chars % 2 = 0 THEN '[{\"n\": ' || strlen(coalesce(text, '')) || '}]' END AS structure, "
    "doc_id % 4 > 1 AND n_chars % 2 = 1 AS failed FROM (SELECT doc_id, text, length(coalesce(text, '')) AS n_chars FROM documents)",
)
def _(s, d):
    """Pages of every fourth document have a structure, those of the next are native; images of an odd number of characters fail."""

    class Lengths:
        name, version = "lengths", "1"

        def analyse(self, image):
            if len(image.decode()) % 2:
                raise ValueError("odd")
            return [{"n": len(image)}]

    k = F.col("doc_id") % 4
    p = documents(s, d).select(
        F.col("doc_id").alias("page_key"), F.when(k == 1, "native").otherwise("ocr").alias("text_source"),
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("image"), F.when(k == 0, "kept").alias("structure"),
        F.lit(None).cast("string").alias("structure_error"),
    )
    out, _results = engines.analyse_structure(p, Lengths(), s.createDataFrame([], engines.STRUCTURE))
    return out.select(F.col("page_key").alias("doc_id"), "structure", F.col("structure_error").isNotNull().alias("failed"))


@query("insert_absent", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM files")
def _(s, d):
    f = files(s, d).select("file_id")
    old, new = f.where("file_id % 3 <> 0").withColumn("version", F.lit("old")), f.withColumn("version", F.lit("new"))
    return M.insert_absent(old, new, ["file_id"])


@query("query_tokens", "SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') AS tokens FROM (SELECT conv_id, turn, replace(replace(text, chr(304), ' '), chr(8490), ' ') AS text FROM conversations)")
def _(s, d):
    words = F.pandas_udf(lambda t: t.map(lambda x: " ".join(R.query_tokens(x))), "string")
    return table(s, d, "conversations").select("conv_id", "turn", words(F.coalesce("text", F.lit(""))).alias("tokens"))


@query("query_check", "SELECT p_partkey, p_size % 7 <> 0 AND p_size % 3 <> 2 AND p_size BETWEEN 1 AND 50 AS valid FROM part")
def _(s, d):
    def valid(size: pd.Series) -> pd.Series:
        def one(n: int) -> bool:
            try:
                return R.checked_query(" q " if n % 7 else "  ", ("fts", "hybrid", "other")[n % 3], n) == "q"
            except ValueError:
                return False

        return size.map(one)

    return table(s, d, "part").select("p_partkey", F.pandas_udf(valid, "boolean")("p_size").alias("valid"))


@query("config_hash", "SELECT p_partkey, sha256('{\"brand\": \"' || p_brand || '\", \"size\": ' || p_size || '}') AS digest FROM part")
def _(s, d):
    one = lambda b, z: pd.Series([S.config_hash({"size": int(y), "brand": x}) for x, y in zip(b, z, strict=True)])
    return table(s, d, "part").select("p_partkey", F.pandas_udf(one, "string")("p_brand", "p_size").alias("digest"))


@query("strict_json", "SELECT doc_id, doc_id % 4 = 3 AS valid FROM documents")
def _(s, d):
    def valid(t: pd.Series) -> pd.Series:
        def one(x: str) -> bool:
            try:
                return sidecar.strict_json(x) is not None
            except ValueError:
                return False

        return t.map(one)

    text = F.element_at(F.array(*map(F.lit, ['{"a":1,"a":2}', '{"a":NaN}', '{"a":', '{"a":{"b":[1,2]}}'])), (F.col("doc_id") % 4 + 1).cast("int"))
    return documents(s, d).select("doc_id", F.pandas_udf(valid, "boolean")(text).alias("valid"))


@query("comment_json", "SELECT doc_id, '{\"n\":' || doc_id || ',\"t\":\"a-\\u002d' || CASE WHEN doc_id % 2 = 1 THEN '-' ELSE '' END || '>b\"}' AS marker FROM documents")
def _(s, d):
    one = F.pandas_udf(lambda n: n.map(lambda k: sidecar.marker_json({"t": "a" + "-" * (int(k) % 2) + "-->b", "n": int(k)})), "string")
    return documents(s, d).select("doc_id", one("doc_id").alias("marker"))


@query("unwrap_fence", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'line ' || doc_id || chr(10) || 'end' ELSE '```' || chr(10) || 'open ' || doc_id END AS text FROM documents")
def _(s, d):
    n = F.col("doc_id").cast("string")
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```markdown\nline "), n, F.lit("\nend\n```"))).otherwise(F.concat(F.lit("```\nopen "), n))
    return documents(s, d).select("doc_id", F.pandas_udf(lambda t: t.map(X.unwrap_fence), "string")(wrapped).alias("text"))


@query(
    "canonical_hash",
    "SELECT file_id, sha256(content_hash || chr(29) || '{\"context_recipe_version\": \"1\", \"filename\": \"doc_' || (file_id - 1) || '.txt\", \"media_type\": \"text/plain\", "
    "\"relative_path\": \"' || relative_path || '\", \"title\": null}') AS digest FROM files WHERE content_hash IS NOT NULL",
)
def _(s, d):
    f = files(s, d).where("content_hash is not null")
    made = S.canonical_source_hash("content_hash", S.basename("path"), "relative_path", F.lit("text/plain"), F.lit(None).cast("string"))
    return f.select("file_id", made.alias("digest"))


@query(
    "image_evidence",
    "SELECT p_partkey, round(greatest(p_size * 10, 100) / 2000.0, 6) AS max_coverage, round(least((p_size * 10 + 100) / 2000.0, 1), 6) AS summed_coverage, "
    "round((p_size * 10 + 100 - least(p_size, 5) * 10) / 2000.0, 6) AS union_coverage, 2 AS images FROM part",
)
def _(s, d):
    box = lambda *x: F.array(*[F.lit(v).cast("double") if not isinstance(v, str) else F.col(v).cast("double") for v in x])
    e = S.image_evidence(F.array(box(0, 0, "p_size", 10), F.array(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(20.0))), F.lit(2000.0))
    d = table(s, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.*")
    return d.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("max_coverage", "summed_coverage", "union_coverage")], "images")


@query("chat_stream", "SELECT conv_id, turn, sha256(coalesce(text, '')) AS digest FROM conversations")
def _(s, d):
    """Every text as the stream of an answer in records of seven characters, cut into odd parts, read and batched again."""

    def back(text: str) -> str:
        records = [json.dumps({"message": {"content": text[i : i + 7]}}) for i in range(0, len(text), 7)] + [json.dumps({"done": True})]
        raw = "\n".join(records).encode()
        return "".join(chat.batched(chat.deltas(raw[i : i + 11] for i in range(0, len(raw), 11))))

    read = F.pandas_udf(lambda t: t.map(back), "string")
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2(read(F.coalesce("text", F.lit(""))), 256).alias("digest"))


_COUNTED = "SELECT count(*) FILTER (text IS NOT NULL) AS n FROM documents"


@query(
    "markdown_run",
    f"SELECT step, CASE step WHEN 3 THEN n WHEN 4 THEN 0 WHEN 1 THEN n ELSE 0 END AS done, CASE step WHEN 2 THEN n WHEN 4 THEN n ELSE 0 END AS kept "
    f"FROM ({_COUNTED}), (VALUES (1), (2), (3), (4)) AS r(step)",
)
def _(s, d):
    """Every document as a file, through the Markdown route: sidecars twice, then indexed twice."""
    place = local_path(f"{shared_root(s)}/markdown-run-{uuid.uuid4().hex}")

    def put(batches):
        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                path = Path(place, "in", str(int(doc) % 97), f"doc_{doc}.txt")
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(text.encode())
            yield pd.DataFrame({"n": [len(b)]})

    documents(s, d).where("text is not null").select("doc_id", "text").mapInPandas(put, "n long").agg(F.sum("n")).collect()
    corpus = Corpus(s, f"{place}/store", Settings(dimensions=16))
    one, two = corpus.generate_markdown(f"{place}/in"), corpus.generate_markdown(f"{place}/in")
    three, four = corpus.index_sidecars(f"{place}/in"), corpus.index_sidecars(f"{place}/in")
    rows = [(1, one.get("create", 0), one.get("skip_unchanged", 0)), (2, two.get("create", 0), two.get("skip_unchanged", 0))]
    rows += [(3, three["indexed"], three["skipped"]), (4, four["indexed"], four["skipped"])]
    return s.createDataFrame(rows, "step int, done long, kept long")
