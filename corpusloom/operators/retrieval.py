"""Keyword, file name and vector search, score fusion and citations.

Text is searched through a TextIndex (stored postings and chunks, of which a query reads its tokens' and its hits' folders)
or, without one, by a scan of the chunks. Each channel of a search is one small job whose result, a pool of at most some
fifty rows, becomes a local relation; what fuses and cites them is planned over those.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusloom.functions import scalars as S

POOL, K1, B, LEAST_IDF = 50, 1.2, 0.75, 1e-6
BASENAME_WEIGHT, FOLDER_WEIGHT, TOKEN_CAP, RRF_K = 3.0, 1.0, 500, 60
#: File ids of a range of the stored name index.
NAME_SPAN = 1 << 12
PLACES = ("basename", "folder_path")


def query_tokens(query: str, unicode: bool = False) -> list[str]:
    """Words of a query as typed: ASCII letters and digits, or (unicode) all letters and digits without accents. Repeats stay."""
    if not unicode:
        return [t.lower() for t in re.findall(r"[A-Za-z0-9]+", query)]
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", plain)


def checked_query(query: str, mode: str = "hybrid", top_k: int = 10) -> str:
    if not query.strip():
        raise ValueError("the query is blank")
    if mode not in ("fts", "vector", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must lie between 1 and 50")
    return query.strip()


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, token, tf of every token of every chunk: the inverted index as a table."""
    return chunks.select(key, F.explode(S.tokenize(text)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Files of a range of the stored index; ranges that a search reads first, and those that it names one by one.
SPAN, FIRST_RANGES, LISTED_RANGES = 256, 8, 1024
#: Stored chunks, in bytes, whose postings a task makes and sorts.
TASK_BYTES = 16 << 20


def _share(average: Column) -> Column:
    """What tf and dl make of a token's weight in BM25."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))


def _weights(wanted: list[str], df: dict[str, int], total: int) -> dict[str, float]:
    """Clipped idf of each token that occurs, times its occurrences in the query."""
    idf = {t: max(math.log((total - n + 0.5) / (n + 0.5)), LEAST_IDF) for t, n in df.items()}
    return {t: wanted.count(t) * x for t, x in idf.items()}


def _weight_of(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for t, w in weights.items():
        out = F.when(F.col("token") == t, F.lit(float(w))).otherwise(out)
    return out


def _scored(postings: DataFrame, weights: dict[str, float], average: Column, k: int) -> DataFrame:
    """chunk_id, score of the k best chunks by some postings."""
    scored = postings.groupBy("chunk_id").agg(F.sum(_weight_of(weights) * _share(average)).alias("score"))
    return scored.orderBy(F.col("score").desc(), "chunk_id").limit(k)


class TextIndex:
    """Stored full-text index: postings by token bucket, chunks by file bucket, and the totals that BM25 asks for.

    No token is one task's when the index is written, since postings are written where their chunks are. A query reads the
    folders of its tokens' buckets, and citations those of their files' buckets.
    """

    def __init__(
        self, postings: DataFrame | list[tuple[DataFrame, int]], chunks: DataFrame | list[tuple[DataFrame, int]],
        totals: DataFrame | tuple[int, int], buckets: int = 0,
    ):
        """Both tables whole, in so many buckets, or as parts that each have their own number of buckets; totals: one row or (n, tokens)."""
        self._postings = [(postings, buckets)] if isinstance(postings, DataFrame) else postings
        self._chunks = [(chunks, buckets)] if isinstance(chunks, DataFrame) else chunks
        self.totals = totals

    @property
    def postings(self) -> DataFrame:
        return _union([p for p, _ in self._postings])

    @property
    def chunks(self) -> DataFrame:
        return _union([c for c, _ in self._chunks])

    def postings_of(self, tokens: list[str]) -> DataFrame | None:
        """The postings of some tokens, from their buckets alone; None where nothing is stored."""
        found = []
        for rows, buckets in self._postings:
            at = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in tokens]
            found.append(rows.where(F.col("bucket").isin(*at) & F.col("token").isin(*tokens)))
        return _union(found) if found else None

    def total(self) -> tuple[int, int]:
        """Chunks that have tokens, and their tokens."""
        return self.totals if isinstance(self.totals, tuple) else tuple(self.totals.select("n", "tokens").first())

    @staticmethod
    def buckets_for(size: int) -> int:
        """Folders for so many bytes of text. Every task that makes postings writes a file to each."""
        return max(8, min(64, size >> 32))

    @staticmethod
    def posted(chunks: DataFrame, buckets: int, fold: bool = True) -> DataFrame:
        """token, chunk_id, tf, dl, bucket of chunks (chunk_id, text)."""
        # Counted where the chunk is, by the places in its sorted words where another word begins: no row is dealt for it.
        words = F.sort_array(S.tokenize("text", fold=fold))
        t = chunks.select("chunk_id", words.alias("_w")).withColumn("dl", F.size("_w").cast("int"))
        first = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
        t = t.select("chunk_id", "dl", "_w", F.when(F.col("dl") > 0, first).alias("_first"))
        counted = F.transform(
            "_first", lambda i, k: F.struct(F.get("_w", i - 1).alias("token"), (F.coalesce(F.get("_first", k + 1), F.col("dl") + 1) - i).cast("int").alias("tf"))
        )
        # Of an outer generator no filter is inferred, which would split the text again.
        rows = t.select("chunk_id", "dl", F.explode_outer(counted).alias("x")).where("x is not null").select("x.token", "chunk_id", "x.tf", "dl")
        return rows.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))

    @staticmethod
    def placed(chunks: DataFrame, buckets: int) -> DataFrame:
        """chunks with `part`, the bucket of their file, dealt for writing."""
        d = chunks.drop("part").withColumn("part", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
        return d.repartition("part", F.pmod("chunk_id", F.lit(4))).sortWithinPartitions("part", "chunk_id")

    @staticmethod
    def bucketed(postings: DataFrame, buckets: int) -> DataFrame:
        """postings in another number of buckets, dealt for writing."""
        return TextIndex.dealt(postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")))

    @staticmethod
    def dealt(postings: DataFrame) -> DataFrame:
        return postings.repartition("bucket", F.pmod("chunk_id", F.lit(8))).sortWithinPartitions("bucket", "token", "chunk_id")

    @staticmethod
    def counted(postings: DataFrame) -> DataFrame:
        """One row: n chunks that have tokens, and their tokens in all."""
        return postings.agg(F.count_distinct("chunk_id").alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))

    @classmethod
    def build(cls, spark: SparkSession, chunks: DataFrame, path: str, buckets: int, span: int = SPAN) -> TextIndex:
        """Write the index of chunks (chunk_id, file_id, text and more) below path, each table once.

        Neither chunks nor postings are dealt: a task writes those of its own files, sorted, so the disk that it takes is what is
        stored, and readers leave out row groups and pages by their least and largest token or chunk.
        span: files of a range. For each token and range, `ranges` holds the number of postings and the largest share of a score
        that one of them has, so a search reads the ranges that can hold one of its best.
        """
        packed = {"compression": "zstd"}
        groups = {"parquet.block.size": str(TASK_BYTES)}
        chunks.sortWithinPartitions("chunk_id").write.options(**packed, **groups).parquet(f"{path}/chunks")
        # A session of its own, whose scans are split finely enough for a task to sort its postings in memory.
        fine = spark.newSession()
        fine.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
        posted = cls.posted(fine.read.schema(chunks.schema).parquet(f"{path}/chunks"), 1)
        posted = posted.withColumn("range", F.expr(f"cast(shiftright(chunk_id, {S.CHUNK_BITS}) div {span} as int)"))
        # No buckets: each would be a file of every task, and a token's rows are found by the statistics of its files anyway.
        rows = posted.drop("bucket").sortWithinPartitions("token", "range", "chunk_id")
        rows.write.options(**packed).parquet(f"{path}/postings")
        postings = spark.read.schema(rows.schema).parquet(f"{path}/postings").withColumn("bucket", F.lit(0))
        n, tokens = cls.counted(postings).first()
        most = F.max(_share(F.lit(tokens / n if n else 1.0))).alias("most")
        ranges = postings.groupBy("token", "range").agg(F.count("*").alias("n"), most)
        ranges.sortWithinPartitions("token", "range").write.options(**packed).parquet(f"{path}/ranges")
        stored = spark.read.schema(chunks.schema).parquet(f"{path}/chunks").withColumn("part", F.lit(0))
        made = cls([(postings.drop("range"), 1)], [(stored, 1)], (n, tokens))
        made._ranged, made._ranges = postings, spark.read.schema(ranges.schema).parquet(f"{path}/ranges").withColumn("bucket", F.lit(0))
        return made

    _ranged: DataFrame | None = None
    _ranges: DataFrame | None = None
    #: Postings of the ranges that the last search read, and all of its tokens.
    read: tuple[int, int] = (0, 0)

    def search(self, query: str, k: int = POOL, unicode: bool = False, pruned: bool = True) -> DataFrame:
        """chunk_id, score: BM25 with clipped idf, from the query's postings alone; where ranges are stored, from those that matter.

        The ranges of the largest possible scores are read first; a range that cannot beat the k-th best chunk of these is left out.
        """
        wanted = query_tokens(query, unicode)
        spark = SparkSession.active()
        none = spark.createDataFrame([], "chunk_id long, score double")
        distinct = list(dict.fromkeys(wanted))
        if not distinct:
            return none
        total, tokens = self.total()
        average = F.lit(tokens / total if total else 1.0)
        if self._ranges is None or not pruned:
            mine = self.postings_of(distinct)
            df = {} if mine is None else {r["token"]: r["df"] for r in mine.groupBy("token").agg(F.count("*").alias("df")).collect()}
            return _scored(mine, _weights(wanted, df, total), average, k) if df else none
        at = [F.pmod(F.xxhash64(F.lit(t)), F.lit(self._postings[0][1])).cast("int") for t in distinct]
        of_query = F.col("bucket").isin(*at) & F.col("token").isin(*distinct)
        ranges = self._ranges.where(of_query)
        df = {r["token"]: r["df"] for r in ranges.groupBy("token").agg(F.sum("n").alias("df")).collect()}
        if not df:
            return none
        weights = _weights(wanted, df, total)
        could = ranges.groupBy("range").agg(F.sum(_weight_of(weights) * F.col("most")).alias("could"), F.sum("n").alias("n"))
        first = could.orderBy(F.col("could").desc(), "range").limit(FIRST_RANGES).collect()
        mine = self._ranged.where(of_query)
        early = [r["range"] for r in first]
        best = _scored(mine.where(F.col("range").isin(*early)), weights, average, k).collect()
        least = best[-1]["score"] if len(best) == k else 0.0
        # The largest possible score of a range and the scores within are sums of the same numbers in other orders.
        open_ = could.where((F.col("could") >= least * (1 - 1e-9)) & ~F.col("range").isin(*early))
        rest = open_.limit(LISTED_RANGES + 1).collect()
        self.read = sum(r["n"] for r in [*first, *rest]), sum(df.values())
        held_best = spark.createDataFrame(best, "chunk_id long, score double")
        if not rest:
            return held_best
        if len(rest) <= LISTED_RANGES:
            others = mine.where(F.col("range").isin(*[r["range"] for r in rest]))
        else:
            others = mine.join(open_.select("range"), "range", "left_semi")
        found = held_best.unionByName(_scored(others, weights, average, k))
        return found.orderBy(F.col("score").desc(), "chunk_id").limit(k)

    def rows_of(self, file_ids: list[int]) -> DataFrame:
        """Chunks of a few files, from their buckets alone."""
        found = []
        for rows, buckets in self._chunks:
            at = [F.pmod(F.xxhash64(F.lit(i).cast("long")), F.lit(buckets)).cast("int") for i in file_ids]
            mine = F.col("part").isin(*at) & F.col("file_id").isin(*file_ids) if file_ids else F.lit(False)
            found.append(rows.where(mine).drop("part"))
        return _union(found)


class TextScan:
    """The same without an index: every search reads the chunks."""

    def __init__(self, chunks: DataFrame):
        self.chunks = chunks

    def search(self, query: str, k: int = POOL, unicode: bool = False) -> DataFrame:
        return search_fts(self.chunks, query, k, unicode=unicode)

    def rows_of(self, file_ids: list[int]) -> DataFrame:
        return self.chunks.where(F.col("file_id").isin(*file_ids) if file_ids else F.lit(False))


def text_of(chunks: DataFrame | TextIndex | TextScan) -> TextIndex | TextScan:
    return TextScan(chunks) if isinstance(chunks, DataFrame) else chunks


class VectorIndex(Protocol):
    """Nearest chunks of a query vector."""

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """key, score; higher is nearer, ties to the smaller key."""


class ExactVectors:
    """The vector index that reads every vector: exact, one scan and one top-k a query."""

    def __init__(self, vectors: DataFrame, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding"):
        self.vectors, self.metric, self.key, self.vector = vectors, metric, key, vector

    def search(self, query: Sequence[float], k: int = POOL) -> DataFrame:
        return search_vectors(self.vectors, query, k, self.metric, self.key, self.vector)


def nearest_of(vectors: DataFrame | VectorIndex, metric: str = "l2") -> VectorIndex:
    return ExactVectors(vectors, metric) if isinstance(vectors, DataFrame) else vectors


def _times(tokens: Column, token: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == F.lit(token)))


def search_fts(chunks: DataFrame, query: str, k: int = POOL, key: str = "chunk_id", text: str = "text", unicode: bool = False) -> DataFrame:
    """key, score: BM25 with clipped idf. Only the query's tokens are counted, so nothing but their matches and two totals is shuffled."""
    wanted = query_tokens(query, unicode)
    spark = chunks.sparkSession
    if not wanted:
        return spark.createDataFrame([], chunks.select(key).schema.add("score", "double"))
    tokens = F.col("_tokens")  # split once, read once a token
    distinct = list(dict.fromkeys(wanted))
    # Through a generator, which filters do not pass: else each filter below would split the text again.
    counts = F.struct(F.size(tokens).alias("dl"), *[_times(tokens, t).alias(f"tf{i}") for i, t in enumerate(distinct)])
    counted = chunks.select(key, S.tokenize(text, fold=True).alias("_tokens")).select(key, F.inline(F.array(counts))).where("dl > 0")
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))])
    hits = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(distinct)))).join(F.broadcast(totals))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        weight = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + F.lit(float(wanted.count(t))) * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def name_rows(files: DataFrame) -> DataFrame:
    """token, place (basename or folder_path), file_id: a row for each distinct token of each part of a file's name."""
    tokens = lambda c: F.transform(F.array_distinct(S.tokenize(c, fold=True)), lambda t: F.struct(t.alias("token"), F.lit(c).alias("place")))
    return files.select("file_id", F.explode(F.concat(tokens("basename"), tokens("folder_path"))).alias("x")).select("x.token", "x.place", "file_id")


def _named(hits: DataFrame, total: Column, k: int) -> DataFrame:
    """file_id, score of rows (token, place, file_id, df)."""
    weight = F.when(F.col("place") == "basename", BASENAME_WEIGHT).otherwise(FOLDER_WEIGHT)
    scored = hits.groupBy("file_id").agg(F.sum(S.idf(total, "df") * weight).alias("score"))
    return scored.orderBy(F.col("score").desc(), "file_id").limit(k)


def _capped(rows: DataFrame, cap: int | None) -> DataFrame:
    """All files of each token and place; with a cap, the first so many in order of their ids."""
    if cap is None:
        return rows
    first = Window.partitionBy("token", "place").orderBy("file_id")
    return rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= cap).drop("nth")


def search_filenames(files: DataFrame | NameIndex, query: str, k: int = POOL, cap: int | None = None) -> DataFrame:
    """file_id, score over file_id, basename, folder_path: per distinct query token, idf times the weights of the columns that
    hold it. With a cap, only so many files a token and column count. A stored index answers from its rows of the query's tokens."""
    if not isinstance(files, DataFrame):
        return files.search(query, k)
    wanted = sorted(set(query_tokens(query)))
    if not wanted:
        return files.sparkSession.createDataFrame([], "file_id long, score double")
    in_ = lambda c, t: F.array_contains(S.tokenize(c, fold=True), F.lit(t))
    flags = [F.array(F.lit(t), F.lit(c), F.when(in_(c, t), "1")) for t in wanted for c in ("basename", "folder_path")]
    rows = files.select("file_id", F.explode(F.filter(F.array(*flags), lambda x: x[2].isNotNull())).alias("x"))
    rows = rows.select("file_id", F.col("x")[0].alias("token"), F.col("x")[1].alias("place"))
    df = rows.groupBy("token").agg(F.countDistinct("file_id").alias("df"))
    total = files.agg(F.count("*").alias("n"))
    return _named(_capped(rows, cap).join(F.broadcast(df), "token").join(F.broadcast(total)), F.col("n"), k)


class NameIndex:
    """Stored file name index; a query opens the folders of its tokens' buckets.

    Whole: a row for each token and range of NAME_SPAN file ids, with the number of its files and their ids by place, so the token
    of all files is many bounded rows. Whole with a cap: a row for each token and place, with the token's number of files and the
    first `cap` of them. In parts that lose files (segments): a row for each file, counted when asked.
    """

    def __init__(self, parts: list[tuple[DataFrame, int]], total: int, whole: bool, cap: int | None = None):
        self.parts, self.total, self.whole, self.cap = parts, total, whole, cap

    @staticmethod
    def bucketed(rows: DataFrame, buckets: int, spread: str = "place") -> DataFrame:
        """rows with the bucket of their token, dealt for writing by token and another column."""
        d = rows.drop("bucket").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        return d.repartition("bucket", F.pmod(F.xxhash64("token", spread), F.lit(4))).sortWithinPartitions("bucket", "token")

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, path: str, buckets: int, cap: int | None = None) -> NameIndex:
        """Write the whole index of files (file_id, basename, folder_path) below path.

        Gathered are the files of a range, or the first `cap` of a token and place, so no token is one task's.
        """
        if cap is None:
            in_name, in_folder = (F.coalesce(S.tokenize(c, fold=True), F.array().cast("array<string>")) for c in PLACES)
            has = lambda t: F.struct(t.alias("token"), F.array_contains(in_name, t).alias("_name"), F.array_contains(in_folder, t).alias("_folder"))
            rows = files.select("file_id", F.inline(F.transform(F.array_distinct(F.concat(in_name, in_folder)), has)))
            ids = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col("file_id"))))
            spans = rows.groupBy("token", F.floor(F.col("file_id") / NAME_SPAN).alias("span")).agg(
                F.count("*").alias("n"), ids("_name").alias("basename"), ids("_folder").alias("folder_path")
            )
            return cls._written(spark, cls.bucketed(spans, buckets, "span"), path, buckets, files.count(), cap)
        rows = name_rows(files)
        either = F.array_distinct(F.concat(S.tokenize("basename", fold=True), S.tokenize("folder_path", fold=True)))
        df = files.select(F.explode(either).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
        heads = _capped(rows, cap).groupBy("token", "place").agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"))
        made = cls.bucketed(heads.join(df, "token").select("token", "place", "df", "file_ids"), buckets)
        return cls._written(spark, made, path, buckets, files.count(), cap)

    @classmethod
    def _written(cls, spark: SparkSession, made: DataFrame, path: str, buckets: int, total: int, cap: int | None) -> NameIndex:
        made.write.partitionBy("bucket").parquet(path)
        stored = spark.read.schema(made.schema).parquet(path)
        return cls([(stored, buckets)], total, True, cap)

    def search(self, query: str, k: int = POOL) -> DataFrame:
        """file_id, score, as search_filenames."""
        wanted = sorted(set(query_tokens(query)))
        spark = SparkSession.active()
        if not wanted or not self.parts:
            return spark.createDataFrame([], "file_id long, score double")
        mine = []
        for rows, buckets in self.parts:
            at = [F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in wanted]
            mine.append(rows.where(F.col("bucket").isin(*at) & F.col("token").isin(*wanted)).drop("bucket"))
        rows = _union(mine)
        if self.whole and self.cap is None:
            df = rows.groupBy("token").agg(F.sum("n").alias("df"))
            at = lambda c: F.transform(c, lambda i: F.struct(F.lit(c).alias("place"), i.alias("file_id")))
            hits = rows.join(F.broadcast(df), "token").select("token", "df", F.inline(F.concat(*map(at, PLACES))))
        elif self.whole:
            hits = rows.select("token", "place", "df", F.explode("file_ids").alias("file_id"))
        else:
            df = rows.groupBy("token").agg(F.countDistinct("file_id").alias("df"))
            hits = _capped(rows, self.cap).join(F.broadcast(df), "token")
        return _named(hits, F.lit(self.total), k)


def search_vectors(vectors: DataFrame, query: Sequence[float], k: int = POOL, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """key, score: exact nearest vectors; negative Euclidean distance or cosine."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = F.lit(0.0) - S.l2_distance(vector, q) if metric == "l2" else S.cosine(vector, q)
    return vectors.where(F.size(vector) == len(query)).select(key, score.alias("score")).orderBy(F.col("score").desc(), key).limit(k)


#: Queries that are held against a block of vectors at once.
QUERY_BLOCK = 1 << 12


def search_vectors_batch(
    vectors: DataFrame, queries: DataFrame, k: int = POOL, metric: str = "l2", key: str = "chunk_id", vector: str = "embedding",
    query_key: str = "query_id", block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_key, nth (from 1), key, score of the k nearest of many queries (query_key, vector), exactly; ties to the smaller key.

    Queries go out in blocks of a counted size, and every block is one scan of the vectors: a task keeps the k best of each query
    over its vectors, and the tasks' best are merged. Vectors of another length than a query's are not its neighbours; null
    ones, and with cosine those of length 0, are nobody's.
    """
    blocks = max(1, -(-queries.count() // block))
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("q"), F.col(vector).alias("v"))
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        held = part.sparkSession.sparkContext.broadcast([(r["q"], r["v"]) for r in part.collect()])
        near = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).mapInArrow(_nearest(held, k, metric), "q long, key long, score double")
        found = near if found is None else found.unionByName(near)
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "key"))
    best = found.withColumn("nth", nth).where(F.col("nth") <= k)
    return best.select(F.col("q").alias(query_key), "nth", F.col("key").alias(key), "score")


def _nearest(held, k: int, metric: str):
    """The k best of each query over a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(v) for _, v in held.value}:
            mine = [(q, v) for q, v in held.value if len(v) == size]
            by_size[size] = np.array([q for q, _ in mine]), np.array([v for _, v in mine], np.float64)
        best = {size: (np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)) for size, (q, _) in by_size.items()}
        for batch in batches:
            column, keys = batch.column(1), np.asarray(batch.column(0))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
            for size, (_, wanted) in by_size.items():
                mine = np.flatnonzero(sizes == size)
                if not len(mine):
                    continue
                flat = column.take(pa.array(mine)).flatten()
                some = np.asarray(flat.cast(pa.float64())).reshape(len(mine), size)
                scores, at = best[size]
                score = _scores(wanted, some, metric)
                every = np.concatenate([scores, score], axis=1)
                named = np.concatenate([at, np.broadcast_to(keys[mine], score.shape)], axis=1)
                order = np.lexsort((named, -every), axis=1)[:, :k]
                best[size] = np.take_along_axis(every, order, 1), np.take_along_axis(named, order, 1)
        for size, (ids, _) in by_size.items():
            scores, at = best[size]
            known = np.isfinite(scores)
            of = np.broadcast_to(ids[:, None], scores.shape)[known]
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(at[known]), pa.array(scores[known])], ["q", "key", "score"])

    return run


def _scores(wanted: np.ndarray, some: np.ndarray, metric: str) -> np.ndarray:
    """Each query against each vector, summed dimension by dimension in double precision."""
    total = np.zeros((len(wanted), len(some)))
    for i in range(wanted.shape[1]):
        total += (wanted[:, i : i + 1] - some[:, i]) ** 2 if metric == "l2" else wanted[:, i : i + 1] * some[:, i]
    if metric == "l2":
        return -np.sqrt(total)
    size = np.sqrt((wanted**2).sum(1))[:, None] * np.sqrt((some**2).sum(1))
    return np.where(size > 0, total / np.where(size > 0, size, 1), -np.inf)


def collapse_to_file(hits: DataFrame, chunk_files: DataFrame) -> DataFrame:
    """file_id, chunk_id, score: the best chunk of each file."""
    best = Window.partitionBy("file_id").orderBy(F.col("score").desc(), "chunk_id")
    return hits.join(chunk_files.select("chunk_id", "file_id"), "chunk_id").withColumn("nth", F.row_number().over(best)).where("nth = 1").select("file_id", "chunk_id", "score")


def fuse_scores(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, key: str = "file_id", held: bool = False) -> DataFrame:
    """key, score: scores scaled to 0..1 within each channel (1 where all are equal), weighted and summed.

    held: the channels are local relations of a pool each, so one task fuses them without an exchange.
    """
    parts = []
    for name, hits in channels.items():
        w = F.lit((weights or {}).get(name, 1.0))
        parts.append(hits.select(F.lit(name).alias("channel"), key, "score", w.alias("weight")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.coalesce(1) if held else rows
    of = Window.partitionBy("channel")
    low, high = F.min("score").over(of), F.max("score").over(of)
    scaled = rows.withColumn("scaled", F.when(high == low, 1.0).otherwise((F.col("score") - low) / F.when(high != low, high - low)))
    return scaled.groupBy(key).agg(F.sum(F.col("scaled") * F.col("weight")).alias("score"))


def fuse_ranks(channels: dict[str, DataFrame], key: str = "file_id", k: int = RRF_K) -> DataFrame:
    """key, score: sum of 1 / (k + rank), ranks from 1 within each channel."""
    rows = None
    for name, hits in channels.items():
        part = hits.select(F.lit(name).alias("channel"), key, "score")
        rows = part if rows is None else rows.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.col("score").desc(), key))
    return rows.withColumn("rank", rank).groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def hydrate(ranked: DataFrame, chunks: DataFrame, files: DataFrame, support: dict[str, DataFrame]) -> DataFrame:
    """Citations of ranked files: the supporting chunk of the first channel that has one, else the file's first chunk, else the file alone
    (chunk_id minus the file's id, page 0, index -1, type filename)."""
    d = ranked
    for name, hits in support.items():
        d = d.join(hits.select("file_id", F.col("chunk_id").alias(f"chunk_{name}")), "file_id", "left")
    first = chunks.join(ranked.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.min_by("chunk_id", "chunk_index").alias("chunk_first"))
    d = d.join(first, "file_id", "left").withColumn("chunk_id", F.coalesce(*[F.col(f"chunk_{n}") for n in support], F.col("chunk_first")))
    c = chunks.select("chunk_id", "page_number", "chunk_index", "source_type", F.col("text").alias("chunk_text"))
    d = d.join(c, "chunk_id", "left").join(files.select("file_id", "path"), "file_id")
    return d.select(
        "file_id", F.coalesce("chunk_id", -F.col("file_id")).alias("chunk_id"), "path", F.coalesce("page_number", F.lit(0)).alias("page_number"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"),
        F.coalesce("source_type", F.lit("filename")).alias("source_type"), S.excerpt("chunk_text").alias("excerpt"), "score",
    )


def held(top: DataFrame) -> DataFrame:
    """A channel's candidates as a local relation. They are at most a pool (a limit stands before), and several later steps
    read them, so each channel is one job."""
    return top.sparkSession.createDataFrame(top.collect(), top.schema)


def by_file(hits: DataFrame, text: TextIndex | TextScan, sure: bool = False) -> DataFrame:
    """The best chunk of each file among a channel's pool, at most some fifty rows; chunks that the text does not hold are left out.

    sure: the pool comes from that text, so its chunks need not be looked up.
    """
    spark = hits.sparkSession
    pool = hits.withColumn("file_id", S.chunk_file("chunk_id")).select("file_id", "chunk_id", "score").collect()
    if not sure:
        ids = [r["chunk_id"] for r in pool]
        found = text.rows_of(sorted({r["file_id"] for r in pool})).where(F.col("chunk_id").isin(*ids) if ids else F.lit(False))
        there = {r["chunk_id"] for r in found.select("chunk_id").collect()}
        pool = [r for r in pool if r["chunk_id"] in there]
    best: dict[int, tuple] = {}
    for r in sorted(pool, key=lambda r: (-r["score"], r["chunk_id"])):
        best.setdefault(r["file_id"], tuple(r))
    return spark.createDataFrame(list(best.values()), "file_id long, chunk_id long, score double")


def cited(
    channels: dict[str, DataFrame], names: DataFrame, chunks: DataFrame | TextIndex | TextScan, files: DataFrame, top_k: int,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Channels of files with chunks, and file names, fused; the first top_k with citations."""
    ranked = held(fuse_scores({**channels, "filename": names}, weights, held=True).orderBy(F.col("score").desc(), "file_id").limit(top_k))
    ids = [r["file_id"] for r in ranked.collect()]
    rows = text_of(chunks).rows_of(ids)
    return hydrate(ranked, rows, files.where(F.col("file_id").isin(*ids) if ids else F.lit(False)), channels)


def keyword_search(
    chunks: DataFrame | TextIndex, files: DataFrame, query: str, top_k: int = 10, pool: int = POOL, names: NameIndex | None = None
) -> DataFrame:
    """Full text and file names (names: their stored index), collapsed to files, fused and cited."""
    text = text_of(chunks)
    channels = {"fts": by_file(text.search(query, pool), text, sure=True)}
    return cited(channels, held(search_filenames(names or files, query, pool)), text, files, top_k)


def vector_search(
    vectors: DataFrame | VectorIndex, chunks: DataFrame | TextIndex, files: DataFrame, query: Sequence[float], top_k: int = 10,
    metric: str = "l2",
) -> DataFrame:
    """Nearest chunks with their citations; not collapsed to files."""
    text, hits = text_of(chunks), held(nearest_of(vectors, metric).search(query, top_k))
    ids = sorted({r[0] for r in hits.select(S.chunk_file("chunk_id")).collect()})
    c = text.rows_of(ids).select("chunk_id", "file_id", "page_number", "chunk_index", "source_type", S.excerpt("text").alias("excerpt"))
    named = files.where(F.col("file_id").isin(*ids) if ids else F.lit(False)).select("file_id", "path")
    columns = ["file_id", "chunk_id", "path", "page_number", "chunk_index", "source_type", "excerpt", "score"]
    return hits.join(c, "chunk_id").join(named, "file_id").select(*columns)


def hybrid_search(
    chunks: DataFrame | TextIndex, files: DataFrame, vectors: DataFrame | VectorIndex, query: str, vector: Sequence[float],
    top_k: int = 10, pool: int = POOL, metric: str = "l2", weights: dict[str, float] | None = None, names: NameIndex | None = None,
) -> DataFrame:
    """Full text, vectors and file names (names: their stored index) fused per file."""
    text = text_of(chunks)
    found = by_file(text.search(query, pool), text, sure=True)
    channels = {"fts": found, "vector": by_file(nearest_of(vectors, metric).search(vector, pool), text)}
    return cited(channels, held(search_filenames(names or files, query, pool)), text, files, top_k, weights)


def build_vectors(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, dimensions: int, config: str) -> DataFrame:
    """chunk_id, embedding, model_key for every chunk whose embedding input has a vector of this model."""
    e = embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions) & (F.col("config_hash") == config) & F.col("success"))
    key = F.coalesce(F.col("embedding_input_hash"), F.col("chunk_hash"))
    return chunks.withColumn("input_hash", key).join(e.select("input_hash", F.col("vector").alias("embedding")), "input_hash").select("chunk_id", "embedding", S.model_key(F.lit(provider), F.lit(model), F.lit(dimensions), F.lit(config)).alias("model_key"))


def require_ready(runs: DataFrame) -> None:
    """Raise while the newest indexing run is not completed; a corpus without runs is ready."""
    last = runs.where("phase = 'index'").orderBy(F.col("run_id").desc()).select("status").limit(1).collect()
    if last and last[0]["status"] != "completed":
        raise RuntimeError(f"the newest index run is {last[0]['status']}")


def search(
    spark: SparkSession, runs: DataFrame, chunks: DataFrame | TextIndex, files: DataFrame, query: str, mode: str = "fts",
    top_k: int = 10, vectors: DataFrame | VectorIndex | None = None, embed=None, names: NameIndex | None = None,
) -> DataFrame:
    """The checked entry point: gate, mode, query embedding (only where the mode needs it)."""
    query = checked_query(query, mode, top_k)
    require_ready(runs)
    if mode == "fts":
        return keyword_search(chunks, files, query, top_k, names=names)
    vector = embed(query)
    if mode == "vector":
        return vector_search(vectors, chunks, files, vector, top_k)
    return hybrid_search(chunks, files, vectors, query, vector, top_k, names=names)
