"""The corpus as one object: folders are indexed run by run, and what is published is searched.

An index run begins with a plan: the folder is listed, files whose size and time of change are known are left alone, and the others are
dealt into batches by their bytes. A batch reads its files once, recognises pages without text, assesses pages, cuts chunks and
makes postings and vectors, all for these files alone; it is published at once, as new segments and the keys of what they replace
(see operators/segments.py). A run that stops goes on with its next batch (see operators/ledger.py), and what did not change is neither
read nor written.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.operators import documents as D
from corpusloom.operators import ledger as L
from corpusloom.operators import quality as Q
from corpusloom.operators import retrieval as R
from corpusloom.operators import state as M
from corpusloom.operators import text as X
from corpusloom.operators.segments import BROADCAST_KEYS, Change, Conflict, Layout, SegmentStore
from corpusloom.settings import Settings
from corpusloom.shared import Folder
from corpusloom.sources import engines as E
from corpusloom.sources import extract, markdown

SCHEMAS = {
    "files": "file_id long, path string, relative_path string, size long, mtime_ns long, content_hash string, file_type string, "
    "extractor string, status string, error string, warning string, indexed_at timestamp",
    "pages": "file_id long, page_number int, text string, text_source string, decision string, reason_codes array<string>",
    "chunks": "chunk_id long, file_id long, chunk_index int, page_number int, source_type string, section string, "
    "block_type string, text string, chunk_hash string, input_hash string, input_text string, part int",
    "postings": "token string, chunk_id long, tf int, dl int, bucket int",
    "names": "token string, place string, file_id long, bucket int",
    "totals": "file_id long, chunks long, n long, tokens long",
    "vectors": "model_key string, file_id long, chunk_id long, input_hash string, vector array<float>",
    "embedding_errors": "chunk_id long, input_hash string, error_message string",
    "ocr": E.RESULT,
    "exclusions": "path string, excluded_at timestamp",
    "items": "run_id long, item_key string, content_hash string, config_hash string, status string, outcome string, error string",
    "runs": "run_id long, phase string, root_path string, status string, indexed long, skipped long, removed long, failed long, "
    "walk_errors long, started_at timestamp, seconds double",
}
#: What a file's rows go by, in each table that has some.
KEYS = {
    **dict.fromkeys(("files", "names", "pages", "chunks", "totals", "vectors"), "file_id"), "postings": f"shiftright(chunk_id, {S.CHUNK_BITS})",
    "exclusions": "path", "ocr": "page_key",
}
LAYOUTS = {
    "chunks": Layout(R.TextIndex.placed, ["part"]),
    "postings": Layout(R.TextIndex.bucketed, ["bucket"]),
    "names": Layout(R.NameIndex.bucketed, ["bucket"]),
}
#: Tables whose rows are made of a file's pages.
DERIVED = ("pages", "chunks", "postings", "totals", "vectors")
COUNTS = ("indexed", "skipped", "removed", "failed", "walk_errors")
PLAN = (
    "path string, relative_path string, size long, mtime_ns long, file_type string, known boolean, known_hash string, known_extractor string, "
    "file_id long, batch int"
)


class Stopped(RuntimeError):
    """The caller asked to stop; nothing was published."""


def numbered(rows: DataFrame, order: str, name: str, after: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """rows with running numbers after `after` in the order of a column, whatever their folder or file system.

    Rows are dealt by ranges and numbered within each; counts of the ranges give where each begins. keep(frame, name) writes
    a frame once, so that the ranges are the same for both.
    """
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = keep(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # A row a range: their number is that of the shuffle's partitions.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("_at") - F.col("_first") + F.col("_before") + F.lit(after + 1)
    starts = ranges.withColumn("_before", before).drop("_n")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, number.cast("long")).drop("_range", "_at", "_first", "_before")


def few(ids: DataFrame) -> DataFrame:
    """Distinct ids of a written frame, to be broadcast where they are counted to be few."""
    ids = ids.distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids


def named_rows(files: DataFrame) -> DataFrame:
    """The name index's rows of files."""
    named = files.select("file_id", S.basename("path").alias("basename"), S.folder_path("relative_path").alias("folder_path"))
    return R.name_rows(named)


def summed(counts: dict[str, int], batches: dict[str, dict[str, int]]) -> dict[str, int]:
    """A run's counts: those of its plan and of its published batches."""
    out = {c: counts.get(c, 0) for c in COUNTS}
    for done in batches.values():
        for c in COUNTS:
            out[c] += done.get(c, 0)
    return out


class Corpus:
    """Tables under `home`, on any file system that Spark writes to; the folders that are indexed must be mounted on the executors.

    batch_bytes: bytes of files that are published together. Another embedding provider is told from the last one by its name,
    model, dimensions and config; the next index run makes its vectors and drops those of others.
    """

    def __init__(
        self, spark: SparkSession, home: str, settings: Settings | None = None, provider: extract.EmbeddingProvider | None = None,
        engines: list[E.OcrEngine] | None = None, stop: Callable[[], bool] = lambda: False, batch_bytes: int = 256 << 30,
    ):
        self.spark, self.settings = spark, settings or Settings()
        self.provider = provider or extract.HashedEmbedding(self.settings.dimensions)
        self.engines = list(engines or [])
        self.store = SegmentStore(spark, home, keys=KEYS, layouts=LAYOUTS)
        self.ledger = L.Ledger(self.store.folder)
        self.batch_bytes = batch_bytes
        self._stop = stop
        self._staging: Folder | None = None
        #: Where kept frames are written.
        self._places: dict[int, tuple[DataFrame, str]] = {}
        self._run: L.Run | None = None

    @property
    def model_key(self) -> str:
        """The identity of the embedding provider's vectors."""
        of = lambda name, default: str(getattr(self.provider, name, default))
        return S.model_key_of(of("name", type(self.provider).__name__), of("model", ""), self.provider.dimensions, of("config", ""))

    def table(self, name: str) -> DataFrame:
        if name == "runs":
            return self._runs()
        try:
            return self.store.read(name)
        except FileNotFoundError:
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _runs(self) -> DataFrame:
        """A row a run, from the ledger."""
        done = self.store.manifest()["batches"]
        rows = []
        for r in self.ledger.all():
            counts = summed(r.get("counts", {}), done.get(str(r["run_id"]), {}))
            began = datetime.fromtimestamp(r["started_at"], UTC)
            seconds = max(0.0, r.get("ended_at", r.get("beat", r["started_at"])) - r["started_at"])
            rows.append((r["run_id"], r["phase"], r["root"], r["status"], *[counts[c] for c in COUNTS], began, seconds))
        return self.spark.createDataFrame(rows, SCHEMAS["runs"])

    # -- index runs ---------------------------------------------------------------------------------

    def index(self, root: str, verify: bool = False) -> dict[str, int]:
        """Bring the files under root up to date, batch by batch; counts of what was done.

        Files whose size and time of change are known are not read; verify reads all. What could not be listed is counted in
        walk_errors, and nothing that is known at or below it is forgotten. Refused (ledger.Busy) while another run works on
        files of this root.
        """
        root = root.rstrip("/")
        return self._go(self.ledger.start("index", root, {"verify": verify}), lambda: self._listing(root))

    def retry_failed(self, root: str) -> dict[str, int]:
        """Read again only the files under root that failed, without a walk."""
        root = root.rstrip("/")
        return self._go(self.ledger.start("index", root, {"partial": True}), lambda: self._failed(root))

    def resume(self, run_id: int) -> dict[str, int]:
        """Go on with a run that was paused or whose holder is gone: batches that are published are left out."""
        run = self.ledger.resume(run_id)
        record = run.record
        if record["phase"] != "index" or record["options"].get("sidecars"):
            run.move("cancel")
            raise ValueError(f"run {run_id} of phase {record['phase']} begins anew")
        root = record["root"]
        return self._go(run, lambda: self._failed(root) if record["options"].get("partial") else self._listing(root))

    def resumable(self) -> list[dict]:
        """Queued and paused runs with their batches and how many of them are published."""
        done = self.store.manifest()["batches"]
        return [{**r, "done": len(done.get(str(r["run_id"]), {}))} for r in self.ledger.resumable()]

    def _failed(self, root: str) -> DataFrame:
        known = self.table("files").where(S.under_root("path", root) & (F.col("status") == "failed"))
        return known.select("path", "relative_path", "size", "mtime_ns", F.lit(None).cast("string").alias("error"))

    def _listing(self, root: str) -> DataFrame:
        """Files under root without sidecars and excluded ones; one row a real path."""
        found = extract.scan_files(self.spark, root).where(~S.is_sidecar("path"))
        if self.settings.excluded:
            found = found.where(~F.col("relative_path").isin(*self.settings.excluded))
        found = found.groupBy("path").agg(F.min_by(F.struct("relative_path", "size", "mtime_ns", "error"), "relative_path").alias("x"))
        return found.select("path", "x.*").join(self.table("exclusions").select("path"), "path", "left_anti")

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write a frame that several steps read into the run's own folder; asked between steps whether to stop."""
        self._asked()
        path = self._staging.path(f"{name}-{uuid.uuid4().hex}")
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(schema).parquet(path)
        self._places[id(kept)] = kept, path.removeprefix(f"{self.store.folder.root}/")
        return kept

    def _drop(self, *kept: DataFrame) -> None:
        """Remove kept frames that nothing reads any more, and the shuffles of steps that have ended (Spark does so once they are collected)."""
        for frame in kept:
            _, place = self._places.pop(id(frame))
            self.store.folder.delete(place)
        self.spark._jvm.System.gc()

    def _whole(self, kept: DataFrame, gone: DataFrame | None = None, **more) -> Change:
        """A change whose rows are those of a kept frame: its folder becomes the segment. Nothing reads the frame after the commit."""
        return Change(kept, gone, written=self._places[id(kept)][1], **more)

    def _asked(self) -> None:
        if self._stop():
            raise Stopped("stopped by the caller")
        wish = self._run.wish() if self._run else None
        if wish:
            raise Stopped(wish)

    def _held(self, run: L.Run, work: Callable[[], dict[str, int]]) -> dict[str, int]:
        """work() with a heartbeat and a folder of its own; its end is the run's."""
        self._staging = Folder(self.spark, f"{self.store.folder.root}/_staging-{uuid.uuid4().hex}")
        self._run = run
        try:
            with run.beating():
                counts = work()
                run.move("fail" if counts.pop("refused", False) else "complete")
                return counts
        except Stopped as e:
            run.move("cancel" if str(e) == "cancel" else "pause")
            raise
        except L.Lost:
            raise
        except Exception as e:
            run.move("fail", error=f"{type(e).__name__}: {e}"[:1000])
            raise
        finally:
            self._staging.delete("")
            self._places.clear()
            self._run = None

    def _go(self, run: L.Run, listing: Callable[[], DataFrame]) -> dict[str, int]:
        """Plan a run if it has no plan yet, and do the batches of it that are not published."""

        def work() -> dict[str, int]:
            options = run.record["options"]
            if not run.state.get("planned"):
                run.update(**self._planned(run.run_id, run.record["root"], listing(), options))
            done = self.store.manifest()["batches"].get(str(run.run_id), {})
            for batch in range(run.state["batches"]):
                if str(batch) not in done:
                    self._batch(run, batch)
            for last in (False, False, True):  # made again where another run published meanwhile
                try:
                    self._embed_missing(run)
                    break
                except Conflict:
                    if last:
                        raise
            self.store.merge()
            if run.state["batches"]:
                self.store.folder.delete(f"ledger/plan-{run.run_id:08d}")
            done = self.store.manifest()["batches"].get(str(run.run_id), {})
            return summed(run.state["counts"], done)

        return self._held(run, work)

    def _plan(self, run_id: int, name: str) -> str:
        return self.store.folder.path(f"ledger/plan-{run_id:08d}/{name}")

    def _planned(self, run_id: int, root: str, listing: DataFrame, options: dict) -> dict:
        """Write what a run has to do (files by batch, and files that are gone); the run's state from then on."""
        base, known = self.store.version, self.table("files")
        scanned = self._keep(listing, "listing")
        listed, unread = scanned.where("error is null").drop("error"), scanned.where("error is not null")
        k = known.select(
            "path", "file_id", (F.col("status") == "indexed").alias("k_indexed"), F.col("size").alias("k_size"),
            F.col("mtime_ns").alias("k_mtime"), F.col("content_hash").alias("known_hash"), F.col("extractor").alias("known_extractor"),
            F.col("file_type").alias("k_type"), F.lit(True).alias("known"),
        )
        d = listed.withColumn("file_type", S.file_type("path")).join(k, "path", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        current = extract.current_extractor(F.coalesce("file_type", "k_type"))
        same = F.col("k_indexed") & (F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime")) & (F.col("known_extractor") == current)
        d = d.withColumn("same", F.coalesce(same & F.lit(not options.get("verify")), F.lit(False)))
        of_indexed = lambda c: F.when(F.col("k_indexed"), F.col(c)).alias(c)
        listed_columns = ["path", "relative_path", "size", "mtime_ns", "file_type", "known"]
        todo = self._keep(d.where(~F.col("same")).select(*listed_columns, of_indexed("known_hash"), of_indexed("known_extractor"), "file_id"), "todo")
        sums = todo.agg(F.count("*").alias("n"), F.count_if("known").alias("known"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
        # New paths are numbered in the order of their relative paths, after numbers that nobody else gets; known ones keep theirs.
        top = self.store.reserve("file_id", sums["n"] - sums["known"])
        gone = known.where(F.lit(False)) if options.get("partial") else M.deleted_files(known, listed, root, [], unread)
        gone = self._keep(gone.select("path", "file_id"), "gone")
        counts = {"skipped": d.where("same").count(), "removed": gone.count(), "walk_errors": unread.count()}
        batches = max(math.ceil(sums["bytes"] / self.batch_bytes), 1) if sums["n"] or counts["removed"] else 0
        if batches:
            batch = F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int").alias("batch")
            fresh = todo.where(~F.col("known")).drop("file_id")
            fresh = numbered(fresh, "relative_path", "file_id", top, self._keep) if sums["n"] > sums["known"] else todo.where(F.lit(False))
            every = todo.where("known").unionByName(fresh.select(*todo.columns))
            every.select("*", batch).write.mode("overwrite").parquet(self._plan(run_id, "files"))
            gone.write.mode("overwrite").parquet(self._plan(run_id, "gone"))
        return {"planned": True, "batches": batches, "base": base, "counts": counts}

    def _batch(self, run: L.Run, batch: int) -> None:
        """Read a batch's files, and publish all that is made of them."""
        self._asked()
        plan = self.spark.read.schema(PLAN).parquet(self._plan(run.run_id, "files")).where(F.col("batch") == batch)
        read = self._keep(extract.read_changed(extract.dealt(plan)), "read")
        action = read.groupBy("path").agg(*[F.first(c).alias(c) for c in ("content_hash", "file_type", "action", "extractor")], F.max("error").alias("error"))
        action = self._keep(action.join(plan.select("path", "relative_path", "size", "mtime_ns", "file_id", "known"), "path"), "actions")
        todo, same = action.where("action <> 'refresh_metadata'"), action.where("action = 'refresh_metadata'")
        pages, warnings, ocr = self._recognised(
            read.where("error is null and page_number > 0").join(todo.select("path", "file_id", "content_hash"), "path").drop(read["content_hash"])
        )
        self._drop(read)
        status = F.when(F.col("error").isNotNull(), "failed").when(F.col("file_type").isNull(), "unsupported").otherwise("indexed")
        columns = self.table("files").columns
        new_files = todo.join(warnings, "file_id", "left").withColumns({"status": status, "indexed_at": F.lit(datetime.now(UTC))})
        moved = same.select("file_id", F.col("size").alias("new_size"), F.col("mtime_ns").alias("new_mtime"))
        moved = self.table("files").join(moved, "file_id").withColumns({"size": F.col("new_size"), "mtime_ns": F.col("new_mtime")})
        files = self._keep(new_files.select(*columns).unionByName(moved.select(*columns)), "files")
        left = self.spark.read.schema("path string, file_id long").parquet(self._plan(run.run_id, "gone")).select("file_id")
        left = left if batch == 0 else left.where(F.lit(False))
        gone = self._keep(todo.where("known").select("file_id").unionByName(left), "gone-ids")
        counts = todo.agg(F.count("*").alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
        counts["skipped"] = same.count()
        replaced = gone.unionByName(same.where("known").select("file_id")) if counts["skipped"] else gone
        changes = {"files": self._whole(files, replaced)}
        derived, counters = self._derived(files, gone, pages)
        fresh = files.join(todo.where("not known").select("file_id"), "file_id", "left_semi")
        changes["names"], counters["files"] = Change(named_rows(fresh), left), fresh.count() - left.count()
        if ocr is not None:
            changes["ocr"] = ocr
        self._asked()
        self.store.commit(
            {**changes, **derived}, run.record["root"], run.state["base"], run.run_id, batch, counts, counters, run.still_mine
        )

    def _recognised(self, pages: DataFrame) -> tuple[DataFrame, DataFrame, Change | None]:
        """Pages with what recognition adds, a warning of each file whose pages it could not read, and what becomes of stored results.

        pages: file_id, content_hash, page_number, text, needs_ocr, image.
        """
        p = pages.withColumn("page_key", F.concat_ws(":", "content_hash", "page_number"))
        action = F.when(~F.col("needs_ocr"), "native").when(S.non_space_count("text") == 0, "page").otherwise("merge")
        p = self._keep(p.withColumn("action", action), "pages")
        cache = self.table("ocr")
        wanted = p.where("needs_ocr and image is not null").select("page_key", "image").dropDuplicates(["page_key"])
        results, asked = E.recognise_pages(wanted, self.engines, cache, self._keep, self.settings.tier_confidence)
        stored = None
        if self.engines:  # all results of a page that was asked for go, and those that are to stay come again
            again = cache.join(asked.select("page_key").distinct(), "page_key", "left_semi")
            stored = Change(self._keep(M.upsert(again, asked, ["page_key", "engine"]), "ocr"), asked.select("page_key"))
        best = results.dropDuplicates(["page_key"])
        resolved = E.resolve_pages(p.select("page_key", "file_id", "page_number", "text", "action"), best)
        resolved = resolved.join(best.select("page_key", F.col("confidence").alias("mean_confidence"), F.col("success").alias("ocr_success")), "page_key", "left")
        resolved = self._keep(resolved, "resolved")
        self._drop(p)
        failed = resolved.groupBy("file_id").agg(F.count("*").alias("n"), F.count_if(F.col("ocr_error").isNotNull()).alias("bad")).where("bad > 0")
        warnings = failed.select("file_id", F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" pages could not be recognised")).alias("warning"))
        return resolved, warnings, stored

    def _derived(self, files: DataFrame, gone: DataFrame, pages: DataFrame) -> tuple[dict[str, Change], dict[str, int]]:
        """Changes of the tables that are made of pages, and of the totals: rows of resolved pages come, those of gone files go."""
        nothing = {c: F.lit(None).cast(t) for c, t in (("line_count", "int"), ("orientation_verified", "boolean"), ("orientation_risk", "boolean"), ("correspondence", "double"))}
        mode = F.when(F.col("action") == "native", "native").when(F.col("text_source") == "none", "skipped").otherwise(F.col("text_source"))
        good = pages.select("file_id", "page_number", F.coalesce("resolved_text", F.lit("")).alias("text"), "text_source", mode.alias("mode"), "ocr_success", "mean_confidence", "page_key")
        assessed = Q.assess_pages(good.withColumns(nothing)).select("file_id", "page_number", "text", "text_source", "decision", "reason_codes")
        config = X.MarkdownConfig(self.settings.chunk_size, self.settings.chunk_overlap)
        pieces = X.markdown_chunks(good.select(F.col("file_id").alias("doc_id"), "page_number", "text"), config).withColumnRenamed("doc_id", "file_id")
        named = pieces.join(files.select("file_id", "path", "relative_path", "file_type"), "file_id")
        named = named.join(good.select("file_id", "page_number", F.col("text_source").alias("source_type")), ["file_id", "page_number"], "left")
        context = S.embedding_text("chunk", S.basename("path"), S.folder_path("relative_path"), S.media_type("file_type"), "page_number", None, "section")
        chunks = self._keep(named.select(
            S.chunk_id("file_id", "chunk_index").alias("chunk_id"), "file_id", "chunk_index", "page_number",
            F.coalesce("source_type", F.lit("native")).alias("source_type"), "section", "block_type", F.col("chunk").alias("text"),
            "chunk_hash", F.sha2(context, 256).alias("input_hash"), context.alias("input_text"),
        ), "chunks")
        postings = self._keep(R.TextIndex.posted(chunks, 1), "postings")
        words = postings.groupBy("chunk_id").agg(F.sum("tf").alias("tokens"))
        per = chunks.select("chunk_id", "file_id").join(words, "chunk_id", "left").groupBy("file_id")
        totals = self._keep(per.agg(F.count("*").alias("chunks"), F.count("tokens").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")), "totals")
        key = self.model_key
        some = not gone.isEmpty()
        made, failed = self._embedded(chunks, gone if some else None)
        came, went, kept = self._totals(totals), dict.fromkeys(("chunks", "n", "tokens"), 0), 0
        if some:
            ids = few(gone)
            went = self._totals(self.table("totals").join(ids, "file_id", "left_semi"))
            kept = self.table("vectors").where(F.col("model_key") == key).join(ids, "file_id", "left_semi").count()
        counters = {f"text_{c}": came[c] - went[c] for c in ("chunks", "n", "tokens")}
        counters[f"vectors:{key}"] = made.count() - kept
        size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        gone = gone if some else None
        out = {
            "pages": Change(assessed, gone), "chunks": Change(chunks, gone, size=size(chunks)), "totals": self._whole(totals, gone),
            "postings": Change(postings, gone, size=size(postings)), "vectors": self._whole(made, gone, mark=key),
        }
        return out | ({"embedding_errors": Change(failed, replace=True)} if failed is not None else {}), counters

    def _totals(self, totals: DataFrame) -> dict[str, int]:
        of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return totals.agg(of("chunks"), of("n"), of("tokens")).first().asDict()

    def _embedded(self, chunks: DataFrame, stale: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Vectors of chunks, and failures if there are any. stale: files whose vectors of the same inputs are taken over."""
        key = F.lit(self.model_key).alias("model_key")
        wanted = chunks.select("input_hash", F.col("input_text").alias("text")).dropDuplicates(["input_hash"])
        have = None
        if stale is not None:
            have = self.table("vectors").where(F.col("model_key") == self.model_key).join(few(stale), "file_id", "left_semi")
            have = self._keep(have.select("input_hash", "vector").dropDuplicates(["input_hash"]), "have")
            wanted = wanted.join(have, "input_hash", "left_anti")
        asked = self._keep(extract.embed(wanted, self.provider), "embedded")
        vectors = asked.where("success").select("input_hash", "vector")
        vectors = vectors.unionByName(have) if have is not None else vectors
        made = chunks.select("file_id", "chunk_id", "input_hash").join(vectors, "input_hash")
        made = self._keep(made.select(key, "file_id", "chunk_id", "input_hash", "vector"), "vectors")
        failed = asked.where("not success")
        if failed.isEmpty():
            return made, None
        return made, chunks.select("chunk_id", "input_hash").join(failed, "input_hash").select("chunk_id", "input_hash", "error_message")

    def _embed_missing(self, run: L.Run) -> None:
        """Vectors of this provider for chunks without one (after a change of provider, or where embedding failed); those of others go."""
        head, key = self.store.manifest(), self.model_key
        others = {s["mark"] for s in head["tables"].get("vectors", {}).get("segments", [])} - {key}
        if not others and head["counters"].get("text_chunks", 0) == head["counters"].get(f"vectors:{key}", 0):
            return
        base = head["version"]
        self._asked()
        mine = self.table("vectors").where(F.col("model_key") == key).select("chunk_id")
        chunks = self._keep(self.table("chunks").join(mine, "chunk_id", "left_anti"), "without-vector")
        made, failed = self._embedded(chunks)
        changes = {"vectors": self._whole(made, mark=key, only_mark=key)}
        if failed is not None:
            changes["embedding_errors"] = Change(failed, replace=True)
        counters = {f"vectors:{key}": made.count()} | {f"vectors:{k}": -head["counters"].get(f"vectors:{k}", 0) for k in others if k}
        self.store.commit(changes, "", base, None, None, None, counters, run.still_mine, neutral=True)

    # -- the two-phase route: sources to Markdown, Markdown to index --------------------------------

    def generate_markdown(self, root: str) -> dict[str, int]:
        """Write a Markdown sidecar beside every source under root; outcomes are counted and kept per file in `items`."""
        root = root.rstrip("/")
        run = self.ledger.start("markdown", root)

        def work() -> dict[str, int]:
            listing = self._keep(self._listing(root), "listing").where("error is null")
            done = self._keep(markdown.write_sidecars(extract.dealt(listing).withColumn("file_type", S.file_type("path"))), "outcomes")
            counts = {r["outcome"]: r["count"] for r in done.groupBy("outcome").count().collect()}
            made = {"indexed": sum(counts.get(c, 0) for c in ("create", "update")), "failed": counts.get("failed", 0)}
            self.store.commit({"items": Change(self._items(run, done))}, root, None, run.run_id, 0, made, None, run.still_mine)
            return counts

        return self._held(run, work)

    def _items(self, run: L.Run, done: DataFrame) -> DataFrame:
        status = F.when(F.col("outcome") == "failed", "failed").otherwise("completed")
        return done.select(
            F.lit(run.run_id).cast("long").alias("run_id"), F.col("path").alias("item_key"), "content_hash", F.lit(markdown.VERSION).alias("config_hash"),
            status.alias("status"), "outcome", "error",
        )

    def index_sidecars(self, root: str) -> dict[str, int]:
        """Index the sidecars under root. Published only if every one of them is whole and bound to its source; else the
        run is recorded as failed with its items, and what was published before stays.

        Sidecars whose text is that of a completed item of an earlier run are not indexed again.
        """
        root = root.rstrip("/")
        run = self.ledger.start("index", root, {"sidecars": True})
        return self._held(run, lambda: self._sidecars(run, root))

    def _sidecars(self, run: L.Run, root: str) -> dict[str, int]:
        base, began = self.store.version, datetime.now(UTC)
        found = extract.scan_files(self.spark, root).where(S.is_sidecar("path") & F.col("error").isNull())
        read = self._keep(markdown.read_sidecars(found), "sidecars")
        bound = self._keep(markdown.bound(read.where("page_number = 0 or page_number is null")), "bound")
        failed = bound.where("reason is not null").count()
        known = self.table("files")
        before = self.table("items").where("outcome = 'indexed' and status = 'completed'")
        before = before.groupBy("item_key").agg(F.max_by("content_hash", "run_id").alias("content_hash"))
        before = before.join(known.where("status = 'indexed'").select(F.col("path").alias("item_key")), "item_key", "left_semi")
        states = M.inherit_checkpoint(
            bound.select(F.col("source_path").alias("item_key"), F.col("sidecar_hash").alias("content_hash"), F.lit(markdown.VERSION).alias("config_hash")),
            before.withColumns({"config_hash": F.lit(markdown.VERSION), "status": F.lit("completed")}),
        )
        outcome = F.when(F.col("reason").isNull(), "indexed").otherwise("failed").alias("outcome")
        items = bound.select(F.col("source_path").alias("path"), F.col("sidecar_hash").alias("content_hash"), outcome, F.col("reason").alias("error"))
        items = self._items(run, items)
        counts = {"indexed": 0, "skipped": 0, "removed": 0, "failed": failed}
        if failed:
            self.store.commit({"items": Change(items)}, root, None, run.run_id, 0, counts, None, run.still_mine)
            return {**counts, "refused": True}
        open_ = self._keep(states.where("status = 'queued'").select(F.col("item_key").alias("source_path")), "open")
        ok = bound.join(open_, "source_path", "left_semi")
        d = ok.select(F.col("source_path").alias("path"), "relative_path", F.col("actual_size").alias("size"), "mtime_ns", F.col("actual_hash").alias("content_hash"))
        have = self._keep(d.withColumn("file_type", S.file_type("path")).join(known.select("path", "file_id"), "path", "left"), "have")
        new = have.where("file_id is null").drop("file_id")
        n = new.count()
        fresh = numbered(new, "relative_path", "file_id", self.store.reserve("file_id", n), self._keep).select(*have.columns) if n else have.where("false")
        rows = have.where("file_id is not null").unionByName(fresh)
        none = F.lit(None).cast("string")
        extra = {"extractor": extract.current_extractor("file_type"), "status": F.lit("indexed"), "error": none, "warning": none, "indexed_at": F.lit(began)}
        files = self._keep(rows.withColumns(extra).select(*known.columns), "new-files")
        pages = read.where("page_number > 0").join(files.select(F.col("path").alias("source_path"), "file_id"), "source_path")
        pages = pages.select(
            "file_id", "page_number", F.col("text").alias("resolved_text"), F.lit("native").alias("text_source"), F.lit("native").alias("action"),
            F.concat_ws(":", "sidecar_hash", "page_number").alias("page_key"), F.lit(None).cast("boolean").alias("ocr_success"),
            F.lit(None).cast("double").alias("mean_confidence"),
        )
        counts |= {"indexed": files.count(), "skipped": states.where("status = 'completed'").count()}
        gone = self._keep(have.where("file_id is not null").select("file_id"), "gone-ids")
        pages = self._keep(pages, "resolved")
        self._drop(read)
        derived, counters = self._derived(files, gone, pages)
        fresh = files.join(gone, "file_id", "left_anti")
        changes = {"files": Change(files, gone), "names": Change(named_rows(fresh)), "items": Change(items), **derived}
        counters["files"] = n
        self.store.commit(changes, root, base, run.run_id, 0, counts, counters, run.still_mine)
        self.store.merge()
        return counts

    # -- reading ------------------------------------------------------------------------------------

    def text_index(self) -> R.TextIndex:
        """The stored postings and chunks, segment by segment."""
        counters = self.store.manifest()["counters"]
        parts = {}
        for name in ("postings", "chunks"):
            try:
                parts[name] = [(df, s["parts"]) for df, s in self.store.segments(name)]
            except FileNotFoundError:
                parts[name] = []
            parts[name] = parts[name] or [(self.spark.createDataFrame([], SCHEMAS[name]), 1)]
        return R.TextIndex(parts["postings"], parts["chunks"], (counters.get("text_n", 0), counters.get("text_tokens", 0)))

    def vectors(self) -> DataFrame:
        """chunk_id, embedding of the present provider; vectors of other providers are not read."""
        try:
            found = self.store.read("vectors", mark=self.model_key)
        except FileNotFoundError:
            found = self.table("vectors")
        return found.select("chunk_id", F.col("vector").alias("embedding"))

    def name_index(self) -> R.NameIndex:
        """The stored index of file names, segment by segment."""
        total = self.store.manifest()["counters"].get("files", 0)
        try:
            parts = [(df, s["parts"]) for df, s in self.store.segments("names")]
        except FileNotFoundError:
            parts = []
        return R.NameIndex(parts, total, False)

    def search(self, query: str, mode: str = "hybrid", top_k: int | None = None) -> DataFrame:
        embed = lambda q: self.provider.embed_query(q)
        return R.search(
            self.spark, self.table("runs"), self.text_index(), self.table("files").select("file_id", "path"), query, mode,
            top_k or self.settings.top_k, self.vectors(), embed, self.name_index(),
        )

    def search_many(self, questions: list[str], top_k: int | None = None) -> DataFrame:
        """question (its number), nth, chunk_id, score: the nearest chunks of many questions, in one scan of the vectors."""
        R.require_ready(self.table("runs"))
        asked = [(k, self.provider.embed_query(R.checked_query(q))) for k, q in enumerate(questions)]
        wanted = self.spark.createDataFrame(asked, "question long, embedding array<float>")
        return R.search_vectors_batch(self.vectors(), wanted, top_k or self.settings.top_k, query_key="question")

    def retriever(self, top_k: int = 4, mode: str = "hybrid") -> Callable[[str], list[dict]]:
        """A function from a question to its cited chunks with their whole text, as a chat asks for."""

        def find(question: str) -> list[dict]:
            hits = [r.asDict() for r in self.search(question, mode, top_k).collect()]
            rows = self.text_index().rows_of(sorted({h["file_id"] for h in hits}))
            ids = [h["chunk_id"] for h in hits]
            texts = {r["chunk_id"]: r["text"] for r in rows.where(F.col("chunk_id").isin(*ids)).select("chunk_id", "text").collect()} if ids else {}
            hits.sort(key=lambda h: (-h["score"], h["file_id"], h["chunk_id"]))
            return [{**h, "text": texts.get(h["chunk_id"])} for h in hits]

        return find

    def read_document(self, path: str, most: int = 4000) -> DataFrame:
        """page_number, text of a file's pages until `most` characters are shown."""
        f = self.table("files").where((F.col("path") == path) & (F.col("status") == "indexed")).select("file_id")
        p = self.table("pages").join(F.broadcast(f), "file_id", "left_semi").withColumnRenamed("file_id", "doc_id")
        return D.preview(p, most).select("page_number", F.col("shown").alias("text")).orderBy("page_number")

    # -- removal ------------------------------------------------------------------------------------

    def _forget(self, gone: DataFrame) -> tuple[dict[str, Change], dict[str, int]]:
        """Changes of all tables when some files (file_id) go, and of the totals."""
        gone = self.spark.createDataFrame(gone.select("file_id").collect(), "file_id long") if gone.count() < 1000 else gone.select("file_id")
        went = self._totals(self.table("totals").join(gone, "file_id", "left_semi"))
        counters = {f"text_{c}": -went[c] for c in ("chunks", "n", "tokens")}
        counters[f"vectors:{self.model_key}"] = -self.vectors().join(gone, S.chunk_file("chunk_id") == gone["file_id"], "left_semi").count()
        counters["files"] = -self.table("files").join(gone, "file_id", "left_semi").count()
        return {name: Change(gone=gone) for name in ("files", "names", *DERIVED)}, counters

    def remove(self, root: str) -> int:
        """Forget all files under root; the number of files. Refused (ledger.Busy) while a run works on some of them."""
        root = root.rstrip("/")
        run = self.ledger.start("remove", root)

        def work() -> dict[str, int]:
            base = self.store.version
            gone = self.table("files").where(S.under_root("path", root)).select("file_id")
            n = gone.count()
            if n:
                changes, counters = self._forget(gone)
                self.store.commit(changes, root, base, run.run_id, 0, {"removed": n}, counters, run.still_mine)
            return {"removed": n}

        return self._held(run, work)["removed"]

    def remove_file(self, path: str, sidecar: bool = True) -> bool:
        """Exclude one file from now on, forget it, and remove its generated sidecar; whether it was known.

        The exclusion and the removal are published together; the source itself is left alone.
        """
        run = self.ledger.start("remove", path)

        def work() -> dict[str, int]:
            base = self.store.version
            gone = self.table("files").where(F.col("path") == path).select("file_id")
            n = gone.count()
            changes, counters = self._forget(gone) if n else ({}, {})
            row = self.spark.createDataFrame([(path, datetime.now(UTC))], SCHEMAS["exclusions"])
            changes["exclusions"] = Change(row, row.select("path"))
            self.store.commit(changes, path, base, run.run_id, 0, {"removed": n}, counters, run.still_mine)
            return {"removed": n}

        known = self._held(run, work)["removed"] > 0
        if sidecar:
            markdown.remove_generated(path)
        return known

    def include_file(self, path: str) -> None:
        """Take back an exclusion; the next index run finds the file again."""
        self.store.commit({"exclusions": Change(gone=self.spark.createDataFrame([(path,)], "path string"))}, path)

    def status(self) -> DataFrame:
        """One row: files by state, chunks, vectors in use, the latest run of indexing or Markdown."""
        counters = self.store.manifest()["counters"]
        last = self.table("runs").where("phase <> 'remove'")
        last = last.agg(F.max("run_id").alias("run_id"), F.max_by("status", "run_id").alias("run_status"), F.max_by("started_at", "run_id").alias("run_started_at"))
        of = lambda s: F.count_if(F.col("status") == s).alias(s)
        files = self.table("files").agg(F.count("*").alias("files"), of("indexed"), of("failed"), of("unsupported"), F.count("warning").alias("warnings"))
        total = lambda name: F.lit(counters.get(name, 0)).cast("long")
        return files.withColumns({"chunks": total("text_chunks"), "embedded": total(f"vectors:{self.model_key}")}).join(last)
