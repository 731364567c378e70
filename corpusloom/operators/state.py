"""Incremental planning, mutations of tables and run state.

Tables are immutable: an update is an anti-join of the old rows and a union with the new ones. How the corpus keeps them is in segments.py.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions import scalars as S


def incremental_plan(listing: DataFrame, known: DataFrame, verify: bool = False) -> DataFrame:
    """path, action for every listed file: skip_metadata, refresh_metadata, reprocess or new.

    listing: path, size, mtime_ns, content_hash (of files that differ in size or time at least); known: the same with status.
    """
    k = known.select(
        "path", F.col("size").alias("k_size"), F.col("mtime_ns").alias("k_mtime"), F.col("content_hash").alias("k_hash"),
        F.col("status").alias("k_status"),
    )
    indexed = F.col("k_status") == "indexed"
    same = indexed & (F.col("size") == F.col("k_size")) & (F.col("mtime_ns") == F.col("k_mtime")) & F.lit(not verify)
    action = (
        F.when(F.col("k_status").isNull(), "new")
        .when(same, "skip_metadata")
        .when(indexed & (F.col("content_hash") == F.col("k_hash")), "refresh_metadata")
        .otherwise("reprocess")
    )
    return listing.join(k, "path", "left").select("path", action.alias("action"))


def misses(wanted: DataFrame, cache: DataFrame, keys: list[str], evict: Column | None = None) -> DataFrame:
    """Distinct wanted keys without a usable cached result; rows for which `evict` holds do not count as results."""
    have = cache if evict is None else cache.where(~evict)
    return wanted.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def ocr_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """As misses; failures that pass (connections, time limits) are tried again."""
    return misses(wanted, cache, keys, ~F.col("success") & S.is_transient("error_message"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str = "file_id") -> dict[str, DataFrame]:
    """What is left of each dependent table (frame, its column) without the gone keys."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return {name: t.join(g, t[c] == g["_gone"], "left_anti") for name, (t, c) in tables.items()}


def deleted_files(
    known: DataFrame, listed: DataFrame, root: str, other_roots: list[str], unread: DataFrame | None = None
) -> DataFrame:
    """Known files under the root that were not listed and that no other root covers.

    unread: paths of files and folders that could not be looked into; what is known at or below them is not deleted.
    """
    mine = known.where(S.under_root("path", root))
    for r in other_roots:
        mine = mine.where(~S.under_root("path", r))
    gone = mine.join(listed.select("path"), "path", "left_anti")
    if unread is None:
        return gone
    # Each missing path with its ancestors: few rows a path, joined on equality.
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    hidden = gone.select("path", F.explode(above).alias("_above")).join(unread.select(F.col("path").alias("_above")), "_above", "left_semi")
    return gone.join(hidden.select("path").distinct(), "path", "left_anti")


def new_owners(files: DataFrame, gone: DataFrame) -> DataFrame:
    """content_hash, owner: the smallest remaining file of each content that a gone file owned."""
    left = files.join(gone.select("file_id"), "file_id", "left_anti")
    hashes = gone.join(files.select("file_id", F.col("content_hash").alias("_h")), "file_id").select(F.col("_h").alias("content_hash")).distinct()
    return left.join(hashes, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("file_id").alias("owner"))


def relink(files: DataFrame, root_id: int, new_root: str) -> DataFrame:
    return files.withColumn("path", F.when(F.col("root_id") == root_id, F.concat(F.lit(new_root + "/"), F.col("relative_path"))).otherwise(F.col("path")))


def relink_overlap(known: DataFrame, listed: DataFrame, most: int = 200) -> DataFrame:
    """sampled, overlap, accepted: share of the first `most` known relative paths that are listed."""
    s = known.select("relative_path").orderBy("relative_path").limit(most)
    hit = s.join(listed.select("relative_path", F.lit(1).alias("hit")).distinct(), "relative_path", "left")
    return hit.agg(F.count("*").alias("sampled"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("overlap")).withColumn("accepted", F.col("overlap") >= 0.5)


def inherit_checkpoint(seeds: DataFrame, old: DataFrame) -> DataFrame:
    """item_key, content_hash, config_hash, status: completed where the old item of that key has both fingerprints and is completed."""
    o = old.select("item_key", F.col("content_hash").alias("o_content"), F.col("config_hash").alias("o_config"), F.col("status").alias("o_status"))
    same = (F.col("o_content") == F.col("content_hash")) & (F.col("o_config") == F.col("config_hash")) & (F.col("o_status") == "completed")
    return seeds.join(o, "item_key", "left").select("item_key", "content_hash", "config_hash", F.when(same, "completed").otherwise("queued").alias("status"))


#: What a run in a state may do.
TRANSITIONS = {
    ("queued", "start"): "running", ("paused", "resume"): "running", ("running", "pause"): "paused", ("running", "complete"): "completed",
    ("running", "fail"): "failed", ("running", "recover"): "paused", ("queued", "cancel"): "cancelled", ("paused", "cancel"): "cancelled", ("running", "cancel"): "cancelled",
}


def fold_runs(events: DataFrame, key: str = "run_id", order: str = "seq", kind: str = "kind") -> DataFrame:
    """Final state of each run: its events folded in order; an event that its state does not allow changes nothing."""
    moves = F.create_map(*[F.lit(x) for (a, e), b in TRANSITIONS.items() for x in (f"{a} {e}", b)])
    ordered = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, kind))).alias("e"))
    state = F.aggregate("e", F.lit("queued"), lambda s, x: F.coalesce(moves[F.concat_ws(" ", s, x[kind])], s))
    return ordered.select(key, state.alias("state"), F.size("e").alias("events"))


def resumable_runs(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Queued or paused runs with progress; only the newest of a root and phase counts."""
    last = runs.groupBy("phase", "root_path").agg(F.max("run_id").alias("run_id"))
    r = runs.join(last, ["phase", "root_path", "run_id"], "left_semi").where(F.col("status").isin("queued", "paused"))
    p = items.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("done"))
    return r.join(p, "run_id", "left").select("run_id", "phase", "root_path", "status", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("done", F.lit(0)).alias("done"))


def claim_next(items: DataFrame) -> DataFrame:
    """The next item of each run: paused before queued, then by ordinal."""
    first = Window.partitionBy("run_id").orderBy(F.when(F.col("status") == "paused", 0).otherwise(1), "ordinal")
    return items.where(F.col("status").isin("paused", "queued")).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def corpus_fingerprint(rows: DataFrame, key: str, digest: str, digits: int = 2) -> DataFrame:
    """One row: a digest of all `key:digest` lines in order. Lines are folded in groups by the key's hash, then the groups' digests, so that no task holds all lines."""

    def fold(frame: DataFrame, by: list[str], order: str, value: Column) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])
        return frame.groupBy(*by).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("fingerprint"))

    groups = fold(rows.withColumn("_g", F.substring(F.sha2(key, 256), 1, digits)), ["_g"], key, F.concat_ws(":", key, digest))
    return fold(groups, [], "_g", F.col("fingerprint"))


def next_action() -> Column:
    """The first of these that applies, over columns service_down, store_ok, folders, has_run, failed; null where nothing is to do."""
    c = F.col
    return (
        F.when(c("service_down"), "start_embedding_service").when(~c("store_ok"), "repair_store").when(c("folders") == 0, "add_folder").when(~c("has_run"), "index_now").when(c("failed") > 0, "review_failures")
    )


def schema_fingerprint(schema: StructType) -> str:
    return S.config_hash(json.loads(schema.json()))


def schema_diff(old: StructType, new: StructType) -> dict[str, list[str]]:
    a, b = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (old, new))
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def atomic_write(path: Path, data: bytes) -> None:
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
