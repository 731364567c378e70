"""Reports over runs, files and reviews, and the package that is handed to a reviewer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S
from corpusloom.shared import Folder

#: States in which an item of a run can be.
ITEM_STATES = ("completed", "paused", "queued", "failed", "running", "skipped")


def progress(items: DataFrame) -> DataFrame:
    """run_id, total, done."""
    done = F.sum(F.when(F.col("status") == "completed", 1).otherwise(0))
    return items.groupBy("run_id").agg(F.count("*").alias("total"), F.coalesce(done, F.lit(0)).alias("done"))


def invariant(items: DataFrame) -> DataFrame:
    """run_id, holds: whether every item of a run is in exactly one known state."""
    known = sum((F.count_if(F.col("status") == x) for x in ITEM_STATES), F.lit(0))
    return items.groupBy("run_id").agg((F.count("*") == known).alias("holds"))


def review_queue(runs: DataFrame, most: int = 500) -> DataFrame:
    """What waits for a decision, newest first; ties by place, then number."""
    return runs.where(F.col("status").isin("paused", "queued")).orderBy(F.col("ts").desc(), "root_path", "run_id").limit(most)


def handoff_manifests(runs: DataFrame) -> DataFrame:
    """root_path, manifest: the runs of a root and their states, in order."""
    entry = F.struct("run_id", F.concat_ws(":", F.col("run_id").cast("string"), "status").alias("e"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ",")
    return runs.groupBy("root_path").agg(F.concat(F.lit("{"), listed, F.lit("}")).alias("manifest"))


def write_handoff(spark: SparkSession, place: str, name: str, prompt: str, pages: DataFrame) -> str:
    """A review package as a folder: manifest.json, prompt.txt and the pages (page_key, text, image) as files.

    All or nothing: everything is written into a staged folder, which is then renamed; a package of that name must not exist.
    Returns its path. Pages are streamed, one at a time.
    """
    folder = Folder(spark, place)
    folder.make()
    if folder.exists(name):
        raise FileExistsError(folder.path(name))
    stage = f".{name}.{uuid.uuid4().hex}"
    try:
        listed = []
        for row in _streamed(pages.select("page_key", "text", "image").orderBy("page_key")):
            base = f"pages/{len(listed) + 1:06d}"
            entry = {"page_key": row["page_key"], "text": f"{base}.txt"}
            folder.create(f"{stage}/{base}.txt", (row["text"] or "").encode())
            if row["image"] is not None:
                entry["image"] = f"{base}.bin"
                folder.create(f"{stage}/{base}.bin", bytes(row["image"]))
            listed.append(entry)
        folder.create(f"{stage}/prompt.txt", prompt.encode())
        folder.create(f"{stage}/manifest.json", json.dumps({"name": name, "pages": listed}, sort_keys=True).encode())
        folder.rename(stage, name)
    except BaseException:
        folder.delete(stage)
        raise
    return folder.path(name)


def _streamed(rows: DataFrame) -> Iterator:
    return rows.toLocalIterator(prefetchPartitions=False)


def recognition_warning(bad: Column, pages: Column) -> Column:
    """What a file's pages that could not be recognised say of it; null where there are none."""
    return F.when(bad == pages, "all pages failed").when(bad > 0, "some pages failed")


def index_status(runs: DataFrame) -> DataFrame:
    """status, n, latest: runs by state, and the newest run."""
    latest = runs.agg(F.max("run_id").alias("latest"))
    return runs.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(latest)).select("status", "n", "latest")


def readiness(runs: DataFrame) -> DataFrame:
    """One row, ready: whether the newest index run is completed, or there is none."""
    last = runs.where("phase = 'index'").agg(F.max_by("status", "run_id").alias("last"))
    return last.select((F.coalesce("last", F.lit("completed")) == "completed").alias("ready"))


def errors_of(events: DataFrame, payload: str = "struct<k:long>", kind: str = "error") -> DataFrame:
    """event_id and the fields of each error event's JSON payload, props."""
    fields = F.from_json("props", payload)
    return events.where(F.col("event_type") == kind).select("event_id", fields.alias("_p")).select("event_id", "_p.*")


def top_folder(path: Column | str) -> Column:
    """The first two parts of an absolute path: what a file is adopted under."""
    return F.regexp_extract(path, "^(/[^/]+/[^/]+)/", 1)


def adopted_folders(files: DataFrame) -> DataFrame:
    return files.select(top_folder("path").alias("folder")).distinct()


def backfill_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """file_id, root, relative path of files under known roots (root, base); an equi-join on the files' top folders."""
    f = files.withColumn("base", top_folder("path"))
    return f.join(roots, "base").select("file_id", "root", F.expr("substring(path, length(base) + 2)").alias("relative"))


def retry_scope(files: DataFrame, root: str) -> DataFrame:
    """files with the failed ones under root set back to pending."""
    again = S.under_root("path", root) & (F.col("status") == "failed")
    return files.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """child, orphans: rows whose parent is missing."""
    lost = child.select(F.col(key).alias("k")).join(parent.select(F.col(parent_key).alias("k")), "k", "left_anti")
    return lost.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("child"), "orphans")
