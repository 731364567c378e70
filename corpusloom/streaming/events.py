"""Event streams: sequenced events with cursors, and run states kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.state import TRANSITIONS, incremental_plan

RING = 2000


def events_since(events: DataFrame, cursor: int, ring: int = RING) -> DataFrame:
    """Events after the cursor that the ring still holds, in order. The ring is the `ring` highest sequence numbers."""
    held = events.orderBy(F.col("seq").desc()).limit(ring)
    return held.where(F.col("seq") > cursor).orderBy("seq")


def poll(events: DataFrame, cursor: int, ring: int = RING) -> DataFrame:
    """One row: events found, the new cursor, and whether events between were lost."""
    found = events_since(events, cursor, ring).agg(F.count("*").alias("found"), F.coalesce(F.max("seq"), F.lit(cursor)).alias("cursor"), F.min("seq").alias("first"))
    return found.select("found", "cursor", (F.coalesce(F.col("first"), F.lit(cursor + 1)) > cursor + 1).alias("gap"))


def fold_chat(events: DataFrame) -> DataFrame:
    """chat_id, seq, kind, payload to chat_id, answer (deltas in order), status, events."""
    d = events.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "payload"))).alias("e"))
    deltas = F.transform(F.filter("e", lambda x: x["kind"] == "delta"), lambda x: x["payload"])
    ends = F.transform(F.filter("e", lambda x: x["kind"].isin("done", "failed", "cancelled")), lambda x: x["kind"])
    return d.select("chat_id", F.array_join(deltas, "").alias("answer"), F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit("running")).alias("status"), F.size("e").alias("events"))


def last_turns(conversations: DataFrame, most: int = 12) -> DataFrame:
    """The last `most` rows of each conversation."""
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return conversations.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= most).drop("nth")


def run_states(events: DataFrame) -> DataFrame:
    """Streaming: run_id, state, applied after each micro-batch; events that a state does not allow are ignored. events: run_id, seq, kind."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, applied = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        for kind in rows["kind"]:
            after = TRANSITIONS.get((now, kind))
            if after:
                now, applied = after, applied + 1
        state.update((now, applied))
        yield pd.DataFrame({"run_id": [key[0]], "state": [now], "applied": [applied]})

    return events.groupBy("run_id").applyInPandasWithState(step, "run_id long, state string, applied long", "state string, applied long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Tumbling counts per event type; rows later than the watermark are dropped when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "events", "total")


def stream_index(spark: SparkSession, folder: str, checkpoint: str, known: DataFrame, sink) -> StreamingQuery:
    """Incremental re-scan: each micro-batch of arriving file rows (Parquet: path, size, mtime_ns, content_hash) is planned against the known files and given to sink(plan, batch)."""
    rows = spark.readStream.schema("path string, size long, mtime_ns long, content_hash string").parquet(folder)
    return rows.writeStream.foreachBatch(lambda batch, n: sink(incremental_plan(batch, known), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
