"""The corpus model over the benchmark tables: files, pages and chunks of `documents`, runs and items of `orders` and `lineitem`.

SQL holds the same relations as common table expressions, for checking in another engine.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import retrieval as R
from corpusloom.operators import text as X
from corpusloom.shared import Folder, shared_root

PAGE_CHARS = 4000
TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages",
    "part", "region", "supplier",
)


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query with its SQL; relations of CTES that the SQL names are put before it."""

    def put(f):
        CATALOG[name] = Query(f, with_relations(sql) if sql else None)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents; a table too small to be read by all cores is dealt out first, since what follows is heavy on text."""
    d = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return d.repartition(cores) if size < cores * (16 << 20) else d


def files(spark: SparkSession, d: str) -> DataFrame:
    rel = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents(spark, d).select(
        (F.col("doc_id") + 1).alias("file_id"), F.concat(F.lit("/corpus/"), rel).alias("path"), rel.alias("relative_path"), F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") * 1000).alias("mtime_ns"), F.sha2("text", 256).alias("content_hash"), "source", "lang", "text",
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).where("length(text) > 0")
    last = F.floor((F.length("text") - 1) / PAGE_CHARS).cast("int")
    return docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("doc_id", (F.col("k") + 1).alias("page_number"), F.substring("text", F.col("k") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    f = X.flat_chunks(documents(spark, d).select((F.col("doc_id") + 1).alias("file_id"), "text"))
    return f.select(S.chunk_id("file_id", "piece_no").alias("chunk_id"), "file_id", F.col("piece_no").alias("chunk_index"), F.lit(1).alias("page_number"), F.lit("native").alias("source_type"), F.col("piece").alias("text"))


_INDEXES: dict[tuple, R.TextIndex] = {}


def text_index(spark: SparkSession, d: str) -> R.TextIndex:
    """The stored full-text index of the documents: built at the first search of a session over this table, then read."""
    made_of = Folder(spark, d).fingerprint("documents.parquet")
    key = (spark.sparkContext.applicationId, d, made_of)
    if key not in _INDEXES:
        path = f"{shared_root(spark)}/text-index-{uuid.uuid4().hex}"
        _INDEXES[key] = R.TextIndex.build(spark, chunks(spark, d), path, R.TextIndex.buckets_for(made_of[0]))
    return _INDEXES[key]


_NAMES: dict[tuple, R.NameIndex] = {}


def name_index(spark: SparkSession, d: str, cap: int | None = None) -> R.NameIndex:
    """The stored index of the files' names, built as text_index is; with a cap, of the first so many files a token and column."""
    made_of = Folder(spark, d).fingerprint("documents.parquet")
    key = (spark.sparkContext.applicationId, d, made_of, cap)
    if key not in _NAMES:
        named = files(spark, d).select("file_id", S.basename("path").alias("basename"), S.folder_path("relative_path").alias("folder_path"))
        _NAMES[key] = R.NameIndex.build(spark, named, f"{shared_root(spark)}/name-index-{uuid.uuid4().hex}", R.TextIndex.buckets_for(made_of[0]), cap)
    return _NAMES[key]


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """A vector for the first chunk of the file of the same number."""
    return table(spark, d, "embeddings").select(S.chunk_id(F.col("vec_id") + 1, F.lit(0)).alias("chunk_id"), "embedding", "vec_id")


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()["embedding"]


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "paused").otherwise("completed")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 2 == 0, "index").otherwise("markdown").alias("phase"), F.concat(F.lit("/root/"), F.col("o_custkey").cast("string")).alias("root_path"), status.alias("status"), F.col("o_orderdate").alias("ts"))


def items(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "paused").otherwise("queued")
    ordinal = F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), ordinal.alias("ordinal"), F.col("l_partkey").alias("item_key"), status.alias("status"), F.col("l_quantity").alias("size"))


FTS_QUERY, NAME_QUERY = "license token", "src3 de"
#: Words for both channels of a search.
BOTH_QUERY = f"{FTS_QUERY} {NAME_QUERY}"


def _bm25(words: str) -> str:
    """SQL of the best 50 chunks for the words."""
    at = dict(enumerate(words.split()))
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS t{i}" for i, w in at.items())
    df = ", ".join(f"count(*) FILTER (t{i} > 0) OVER () AS d{i}" for i in at)
    parts = " + ".join(
        f"2.2 * greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * t{i} / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in at
    )
    every = ", ".join(f"t{i}" for i in at)
    return (
        f"SELECT chunk_id, score FROM (SELECT chunk_id, {parts} AS score FROM (SELECT chunk_id, {every}, dl, count(*) OVER () AS n, "
        f"avg(dl) OVER () AS avgdl, {df} FROM (SELECT chunk_id, len(w) AS dl, {counts} FROM (SELECT chunk_id, "
        r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM chunks)) WHERE dl > 0) "
        f"WHERE {' + '.join(f't{i}' for i in at)} > 0) ORDER BY score DESC, chunk_id LIMIT 50"
    )


def _fused(text: str, vectors: bool, names: bool = True) -> str:
    named = "UNION ALL SELECT 'n', file_id, score FROM every_name" if names else ""
    near = "UNION ALL SELECT 'v', file_id, score FROM near_files " if vectors else ""
    return (
        "SELECT file_id, sum(x) AS score FROM (SELECT file_id, CASE WHEN max(score) OVER (PARTITION BY c) = min(score) OVER (PARTITION BY c) THEN 1.0 "
        "ELSE (score - min(score) OVER (PARTITION BY c)) / (max(score) OVER (PARTITION BY c) - min(score) OVER (PARTITION BY c)) END AS x "
        f"FROM (SELECT 'f' AS c, file_id, score FROM {text} {near}{named})) GROUP BY file_id ORDER BY score DESC, file_id LIMIT 10"
    )


def _best(hits: str) -> str:
    """SQL of the best chunk of each file."""
    return (
        "SELECT file_id, chunk_id, score FROM (SELECT file_id, chunk_id, score, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, chunk_id) AS nth "
        f"FROM {hits} JOIN chunks USING (chunk_id)) WHERE nth = 1"
    )


CTES = {
    "files": "SELECT doc_id + 1 AS file_id, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, source || '/' || lang || '/doc_' || doc_id || '.txt' AS relative_path, CAST(strlen(text) AS BIGINT) AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS content_hash, source, lang, text FROM documents",
    "doc_pages": f"SELECT doc_id, CAST(k + 1 AS INTEGER) AS page_number, substring(text, k * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // {PAGE_CHARS})) AS k FROM documents WHERE length(text) > 0)",
    "chunks": r"SELECT file_id * 16777216 + k AS chunk_id, file_id, CAST(k AS INTEGER) AS chunk_index, 1 AS page_number, 'native' AS source_type, p AS text FROM (SELECT file_id, k, regexp_replace(substring(t, k * 850 + 1, 1000), '^\s+|\s+$', '', 'g') AS p FROM (SELECT file_id, t, unnest(generate_series(0, greatest(0, CAST(ceil((length(t) - 1000) / 850.0) AS BIGINT)))) AS k FROM (SELECT doc_id + 1 AS file_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE length(t) > 0)) WHERE length(p) > 0",
    "vectors": "SELECT (vec_id + 1) * 16777216 AS chunk_id, embedding, vec_id FROM embeddings",
    "runs": "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'index' ELSE 'markdown' END AS phase, '/root/' || o_custkey AS root_path, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'paused' ELSE 'completed' END AS status, o_orderdate AS ts FROM orders",
    "items": "SELECT l_orderkey AS run_id, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS ordinal, l_partkey AS item_key, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'paused' ELSE 'queued' END AS status, l_quantity AS size FROM lineitem",
    "fts": _bm25(FTS_QUERY),
    "fts_both": _bm25(BOTH_QUERY),
    "names": r"SELECT file_id, sum(w * ln(1 + n / df)) AS score FROM (SELECT file_id, tok, w, count(*) OVER (PARTITION BY tok) AS df, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n, nth FROM (SELECT file_id, tok, 1.0 AS w, row_number() OVER (PARTITION BY tok ORDER BY file_id) AS nth FROM (SELECT file_id, unnest(['de', 'src3']) AS tok, source, lang FROM files) WHERE tok = lower(source) OR tok = lower(lang))) WHERE nth <= 500 GROUP BY file_id ORDER BY score DESC, file_id LIMIT 50",
    "every_name": r"SELECT file_id, sum(w * ln(1 + n / df)) AS score FROM (SELECT file_id, tok, 1.0 AS w, count(*) OVER (PARTITION BY tok) AS df, (SELECT CAST(count(*) AS DOUBLE) FROM documents) AS n FROM (SELECT file_id, unnest(['de', 'src3']) AS tok, source, lang FROM files) WHERE tok = lower(source) OR tok = lower(lang)) GROUP BY file_id ORDER BY score DESC, file_id LIMIT 50",
    "near": "SELECT chunk_id, 0.0 - sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))) AS score FROM vectors, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY score DESC, chunk_id LIMIT 50",
    "fts_files": _best("fts"),
    "both_files": _best("fts_both"),
    "near_files": _best("near"),
    "keyword_ranked": _fused("both_files", False),
    "hybrid_ranked": _fused("both_files", True),
    "search_ranked": _fused("fts_files", False, False),
}
_NEEDS = {
    "fts": ["chunks"], "fts_both": ["chunks"], "names": ["files"], "every_name": ["files"], "near": ["vectors"], "fts_files": ["fts", "chunks"],
    "both_files": ["fts_both", "chunks"], "near_files": ["near", "chunks"], "keyword_ranked": ["both_files", "every_name"],
    "hybrid_ranked": ["both_files", "near_files", "every_name"], "search_ranked": ["fts_files"],
}


def with_relations(sql: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in CTES:
        if re.search(rf"\b(FROM|JOIN|,)\s*{name}\b", sql):
            add(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
    return f"WITH {head} {sql}" if head else sql
