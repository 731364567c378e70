"""Mixing sources to target weights by a low-discrepancy source schedule.

Every source's documents are laid end to end in a shuffled order (a hash of
the id) and cut into blocks of equally many words. Slot k of the schedule draws the
point frac((k + 1) * golden ratio); the point's place in the cumulative target weights names
the source, and the slot's rank within its source names the block (rank modulo the number of
blocks, so ranks beyond one pass repeat the source). The schedule runs until
each source has the slots its target needs; the last slot of a source is cut
to the target. Golden-ratio points have bounded discrepancy, so any prefix of
the schedule is mixed near the target weights.

No source is ever one task: documents are numbered per (source, hash bucket)
and slots per run of slots, and only sums of those small groups are ordered. One task orders the sources themselves, a row each, so
their number, not their size, is what must stay within a task's reach.

Defined results: null text has size 0 and is taken 0 times; null source is a source of
its own and sorts last; an empty table gives an empty result; rows that repeat
an id are separate documents; sources whose documents are all empty get target 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as T
from .common import cut, input_bytes

BLOCK_WORDS = 512
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
GOLDEN = 0.6180339887498949
#: Slots that one bucket of the schedule numbers in one window.
SLOT_RUN = 1 << 12
#: Cells into which the cumulative weights are cut to find a point's source.
RANGE_CELLS = 1 << 12


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and digest, a fingerprint of the row that tells repeated ids apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches):
            size = np.zeros(rows.num_rows, np.int64)
            for at, many, part, edges in T.pieces(buf, offsets, T.SPACE_CLASS):
                size[at : at + many] += np.diff(T.Words(part, edges, T.SPACE_CLASS).first)
            yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in range(3)], pa.array(size)], ["doc_id", "source", "digest", "size"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), digest().alias("digest"), "text")
    return d.mapInArrow(count, "doc_id long, source string, digest long, size long")


def digest():
    """Fingerprint of a row of documents; rows of equal id, source and text have the same."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: weighted shares of `share` of all words, none above `cap` times its source.

    Water-filling in closed form: ordered by cap / weight, the sources that stop at
    their cap are a prefix; the rest share what is left by weight. One row per source is ordered.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1)).withColumn("most", F.col("source_size") * F.lit(cap))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "budget": F.sum("source_size").over(whole) * F.lit(share),
            "weight_left": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "capped_before": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        }
    )
    # Level of fill if this source and all after it were uncapped: the first source that holds its share fixes the level for the rest.
    per = per.withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
    per = per.withColumn("fits", F.col("weight") * F.col("level") <= F.col("most"))
    per = per.withColumn("final_level", F.max(F.when(F.col("fits"), F.col("level"))).over(whole))
    target = F.when(F.col("final_level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * F.col("final_level")))
    return per.select("source", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source, rank (from 0), block, words, block_words: the slots of each source until its target is met.

    targets: source, source_size, target. A pass over a source has ceil(size / block_words)
    blocks, the last one short. Slots are made by spark.range; each run of SLOT_RUN
    slots numbers its own slots per source, and the counts of the runs are summed up.
    """
    spark = targets.sparkSession
    w = Window.orderBy(F.col("source").isNull(), "source")
    size, target = F.col("source_size"), F.col("target")
    t = targets.where("target > 0").withColumn("blocks", F.ceil(size / block_words))
    passes = F.floor(target / size)
    t = t.withColumns({"needs": passes * F.col("blocks") + F.ceil((target - passes * size) / block_words), "sid": F.row_number().over(w)})
    t = t.withColumn("hi", F.sum("needs").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("needs"))
    total = t.agg(F.coalesce(F.max("hi"), F.lit(0)).alias("n")).first()["n"]
    # A point's source: an equi-join on coarse cells of the cumulative weights, at most RANGE_CELLS + one row per source.
    cell = max(1, -(-total // RANGE_CELLS))
    # What later steps need of a source comes along here, so none of them meets a source's slots by its name alone.
    carried = ["sid", "lo", "hi", "source", "target", "needs", "blocks", "source_size"]
    ranges = t.select(*carried, F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    point = F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0)) * F.lit(float(total))
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") / cell))
    slots = slots.join(ranges, "cell").where("lo <= point and point < hi").select("slot", *carried).withColumn("run", F.floor(F.col("slot") / SLOT_RUN))
    runs = slots.groupBy("sid", "run").count()
    runs = runs.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("in_run", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1).join(runs.drop("count"), ["sid", "run"])
    drawn = ranked.select("slot", *carried, (F.col("before") + F.col("in_run")).alias("rank"))
    # What a source lacks at the end of the schedule (its discrepancy: a few slots) follows as a tail, in source order.
    have = runs.groupBy("sid").agg(F.max(F.col("before") + F.col("count")).alias("have"))
    lacks = t.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < needs")
    tail = lacks.select(*carried, F.explode(F.sequence(F.col("have"), F.col("needs") - 1)).alias("rank"))
    out = drawn.unionByName(tail.withColumn("slot", F.lit(total) + F.col("lo") + F.col("rank"))).where("rank < needs")
    block = F.pmod("rank", "blocks")
    whole = F.least(F.lit(block_words), size - block * block_words)
    left = F.floor(target + F.lit(0.5)) - F.floor(F.col("rank") / F.col("blocks")) * size - block * block_words
    return out.select("slot", "source", "rank", block.alias("block"), F.greatest(F.lit(0), F.least(whole, left)).cast("long").alias("words"), whole.cast("long").alias("block_words"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken (long) and source, digest: the words that the mix takes of each document."""
    buckets = max(64, min(1 << 16, input_bytes(docs) >> 18))
    sizes = cut(word_counts(docs), "mix-sizes")
    targets = cut(source_targets(sizes, weights, share, cap).coalesce(1), "mix-targets")
    shuffled = F.xxhash64("doc_id", "digest", F.lit(seed))
    s = sizes.withColumns({"at": shuffled, "bucket": F.pmod(F.shiftright(shuffled, 20), F.lit(buckets)).cast("int")})
    ends = s.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ends = ends.withColumn("offset", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("source", "bucket").orderBy("at", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = s.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = lambda a, b, *more: F.expr(" and ".join([f"{a}.source <=> {b}.source", *[f"{a}.{m} = {b}.{m}" for m in more]]))
    # A source has a row a bucket here; its target goes on with them, so that no join is on the source alone.
    ends = ends.alias("e").join(targets.alias("t"), same("e", "t")).select("e.source", "bucket", "offset", "source_size", "target")
    kept = ["p.doc_id", "p.source", "p.size", "p.digest", "e.source_size", "e.target"]
    placed = placed.alias("p").join(ends.alias("e"), same("p", "e", "bucket")).select(*kept, (F.col("offset") + F.col("inside")).alias("start"))
    placed = cut(placed, "mix-placed")
    # Uses of a block: its whole slots; the slot that is cut to the target takes only the block's first words.
    whole = F.col("words") >= F.col("block_words")
    used = schedule(targets, block_words).groupBy("source", "block").agg(F.sum(F.when(whole, 1).otherwise(0)).alias("uses"), F.coalesce(F.max(F.when(~whole, F.col("words"))), F.lit(0)).alias("part"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    lo = F.greatest(F.col("start"), F.col("p.block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("p.block") + 1) * block_words)
    part_end = F.col("p.block") * block_words + F.col("part")
    took = pieces.alias("p").join(used.alias("u"), same("p", "u", "block")).select("p.doc_id", "p.source", "p.digest", "start", ((hi - lo) * F.col("uses") + F.greatest(F.lit(0), F.least(hi, part_end) - lo)).alias("took"))
    took = took.groupBy("doc_id", "source", "digest", "start").agg(F.sum("took").alias("taken"))
    key = F.expr("p.doc_id <=> k.doc_id and p.source <=> k.source and p.digest = k.digest and p.start = k.start and p.size > 0")
    out = placed.alias("p").join(took.alias("k"), key, "left").select("p.*", F.coalesce("k.taken", F.lit(0)).cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "digest", "start")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """docs with all their columns and size, source_size, target, taken; columns of these names give way.

    What the mix takes of a row finds it again by the row's fingerprint; rows that repeat are counted off against each other.
    """
    added = ["size", "source_size", "target", "taken"]
    out = mix(docs, weights, share, cap, block_words, seed)
    took = out.withColumn("_nth", F.row_number().over(Window.partitionBy("digest").orderBy("start", "doc_id", "source", "taken")))
    took = took.select("digest", F.col("_nth").alias("_of"), *[F.col(c).alias(f"_new_{c}") for c in added])
    # The row travels as one struct, so no column of the caller can clash with those of the join.
    rows = docs.select(digest().alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("digest").orderBy(F.xxhash64("_row"))))
    found = rows.join(took, (rows["digest"] == took["digest"]) & (F.col("_nth") == F.col("_of")))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *[F.col(f"_new_{c}").alias(c) for c in added])


def order_slots(docs: DataFrame) -> DataFrame:
    """The schedule alone for a caller who streams blocks: slot, source, rank, words."""
    return schedule(source_targets(word_counts(docs)))
