"""Merkle manifest of a dataset: one root over all rows, and for every row the siblings that prove it.

Every row is a leaf. The leaves of a partition (a language, say) in order of their ids make a tree: each run of eight
nodes becomes their digest until one node is left. The partitions' nodes, ordered by name, make the tree whose node is the root.

Trees are walked in aligned blocks of 512 leaves. Within a block a recursive postorder walk returns the digest of each
subtree and, while it unwinds, appends the siblings of that subtree to the path of every leaf it contains. The blocks' roots are
the leaves of the next distributed walk, 512 times smaller, and so on to the root. The way up keeps only digests; on the way
down each block is walked again beside the path of its root, so that paths (some 450 bytes a level and leaf) are never stored.

A row's place in its tree comes from ranges: rows are dealt by (partition, id, leaf), numbered within each range, and counts of
the ranges are summed, so neither a large partition nor a repeated row is one task. What is dealt is a digest or two of
a row; texts are read once and stay where they are.

Defined results: null ids come first in their tree, equal ids in the order of their leaves; equal rows are equal leaves beside
each other. A null partition is a tree of its own and comes first. A row with a null id or a null text is never tampered with. An empty
table gives an empty result. Further columns are not looked at. A text is hashed whole by the JVM, of whatever length.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Nodes that become one.
FAN = 8
#: Levels of a tree that one block walks: blocks are of FAN ** LEVELS leaves.
LEVELS = 3
BLOCK = FAN**LEVELS
#: The columns that a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The contract changes the rows whose id's CRC-32 this divides.
TAMPERED = 3

#: A node: its tree, its place in it, how many nodes the tree has at this level, its digest.
NODE = "tree string, place long, nodes long, digest string"
PATH = "tree string, place long, path binary, subroot string"


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as a string: their number, a colon, and they."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def folded(text: Column) -> Column:
    """The text with A-Z in lower case, and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- the walk over one block ------------------------------------------------------------------------


def _digest(parts: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def walk(leaves: list[bytes], levels: int, paths: list[list[bytes]] | None = None, lo: int = 0, hi: int | None = None) -> bytes:
    """Digest of the subtree over leaves lo to hi, `levels` above them, by a postorder walk.

    paths: one list a leaf. While the walk unwinds, each subtree's siblings go to the leaves that it contains, lower levels
    first: the place among the nodes of the run, the number of its siblings, and the siblings.
    """
    hi = len(leaves) if hi is None else hi
    if not levels:
        return leaves[lo]
    step = FAN ** (levels - 1)
    edges = [*range(lo, hi, step), hi]
    nodes = [walk(leaves, levels - 1, paths, a, b) for a, b in zip(edges, edges[1:], strict=False)]
    if paths is not None:
        for k in range(len(nodes)):
            step_up = bytes((k, len(nodes) - 1)) + b"".join(nodes[:k] + nodes[k + 1 :])
            for leaf in range(edges[k], edges[k + 1]):
                paths[leaf].append(step_up)
    return _digest(nodes)


def steps(path: bytes) -> list[tuple[int, list[bytes]]]:
    """A path as (place among the nodes of the run, siblings) of each level."""
    out, at = [], 0
    while at < len(path):
        k, n = path[at], path[at + 1]
        out.append((k, [path[at + 2 + 64 * i : at + 66 + 64 * i] for i in range(n)]))
        at += 2 + 64 * n
    return out


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf has with the siblings of a path."""
    for k, siblings in steps(path):
        leaf = _digest(siblings[:k] + [leaf] + siblings[k:])
    return leaf


def proof(path: bytes) -> bytes:
    """Digest of all siblings of a path, level by level."""
    return _digest([s for _, siblings in steps(path) for s in siblings])


def levels_of(nodes: int, most: int = LEVELS) -> int:
    """Levels above so many nodes until one is left, at most `most`."""
    levels = 0
    while nodes > 1 and levels < most:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by("place")


def _up(group: pa.Table) -> pa.Table:
    """One node for a block: what is left of it `levels` further up."""
    g = _in_order(group)
    nodes = g["nodes"][0].as_py()
    levels = levels_of(nodes)
    digest = walk([d.encode() for d in g["digest"].to_pylist()], levels)
    left = nodes
    for _ in range(levels):
        left = -(-left // FAN)
    row = {"tree": g["tree"][0].as_py(), "place": g["place"][0].as_py() // BLOCK, "nodes": left, "digest": digest.decode()}
    return pa.Table.from_pylist([row])


def _paths(g: pa.Table, above: bytes) -> list[bytes]:
    """The paths of a block's leaves up to the root; above: the path of the block's own node."""
    leaves = [d.encode() for d in g["digest"].to_pylist()]
    paths: list[list[bytes]] = [[] for _ in leaves]
    walk(leaves, levels_of(g["nodes"][0].as_py()), paths)
    return [b"".join([*p, above]) for p in paths]


# -- distributed ------------------------------------------------------------------------------------


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with place (from 0) and nodes: where each stands in its tree, in order of some columns, and the tree's size.

    rows: a written frame. They are dealt by ranges of (tree, order) and written once, so that ranges and numbers stay the same
    for all who read them.
    """
    keys = [tree, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = dealt.drop("_tie").withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    placed = cut(ranged, "merkle-ranges")
    parts = placed.groupBy(tree, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    of = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each tree and range that holds some of it.
    starts = parts.withColumns({"_before": before, "_nodes": F.sum("_n").over(of)}).select(
        F.col(tree).alias("_tree"), F.col("_range").alias("_of"), (F.col("_before") - F.col("_first")).alias("_shift"), F.col("_nodes").alias("nodes")
    )
    starts = small(cut(starts, "merkle-starts"))
    same = (F.col(tree) == F.col("_tree")) & (F.col("_range") == F.col("_of"))
    return placed.join(starts, same).withColumn("place", F.col("_at") + F.col("_shift")).select(*rows.columns, "place", "nodes")


def _blocks(nodes: DataFrame, *more: str):
    blocks = nodes.select("tree", "place", "nodes", "digest", *more).withColumn("block", F.expr(f"place div {BLOCK}"))
    return blocks.groupBy("tree", "block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes given, and those that each further walk leaves, until every tree has one."""
    levels = [nodes]
    while not levels[-1].where("nodes > 1").isEmpty():
        levels.append(cut(_blocks(levels[-1]).applyInArrow(_up, NODE), "merkle-nodes"))
    return levels


def _beside(paths: DataFrame):
    return paths.withColumnRenamed("place", "block").groupBy("tree", "block")


def descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """tree, place, path, subroot of nodes; paths: the same of the nodes that their blocks became."""

    def down(group: pa.Table, above: pa.Table) -> pa.Table:
        g, top = _in_order(group), above["path"][0].as_py()
        subroot = pa.array([above["subroot"][0].as_py()] * len(g), pa.string())
        return pa.table({"tree": g["tree"], "place": g["place"], "path": pa.array(_paths(g, top), pa.binary()), "subroot": subroot})

    return cut(_blocks(nodes).cogroup(_beside(paths)).applyInArrow(down, PATH), "merkle-paths")


def leaves_of(docs: DataFrame, columns: tuple[str, ...], order: str, tree: str, tampered: int) -> DataFrame:
    """doc_id, tree, digest (of the leaf), other (of the leaf whose text is changed, where it is)."""
    of = [F.col(f"`{c}`") for c in columns]
    changed = F.lit(False)
    if tampered:
        hit = F.crc32(F.col(f"`{order}`").cast("string")) % tampered == 0
        changed = F.coalesce(hit, F.lit(False)) & F.col("text").isNotNull()
    other = leaf_digest([folded(c) if name == "text" else c for name, c in zip(columns, of, strict=True)])
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree}`").cast("string")), F.lit(""))  # null comes first
    doc_id = F.col(f"`{order}`").cast("long").alias("doc_id")
    return docs.select(doc_id, name.alias("tree"), leaf_digest(of).alias("digest"), F.when(changed, other).alias("other"))


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, order: str = "doc_id", tree: str = "lang", tampered: int = TAMPERED
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (string), verified (boolean) of every row of docs.

    columns: what leaves are made of; order: the id that rows are ordered by; tree: the column that deals rows to trees.
    Rows whose id's CRC-32 `tampered` divides are folded to a root with A-Z of their text in lower case (0: none are).
    """
    rows = cut(leaves_of(docs, columns, order, tree, tampered), "merkle-leaves")
    levels = climb(numbered(rows, "tree", ["doc_id", "digest"]))
    # The node that each tree has become is a leaf of the last tree, in the order of their names.
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = numbered(cut(subroots, "merkle-subroots"), "tree", ["name"])
    top_levels = climb(tops)
    last = top_levels[-1].select("tree", "place", F.lit(b"").alias("path"), F.col("digest").alias("subroot"))
    root = last.first()  # a row at most
    paths = last
    for nodes in reversed(top_levels[:-1]):
        paths = descend(nodes, paths)
    named = tops.select(F.col("place").alias("_place"), "name", "digest").join(paths, F.col("_place") == F.col("place"))
    paths = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"))
    for nodes in reversed(levels[1:-1]):
        paths = descend(nodes, paths)
    return _proven(levels[0], paths, root["subroot"] if root else "")


LEAF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proven(leaves: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """The rows of LEAF: each block of leaves is walked beside the path of its own node."""

    def prove(group: pa.Table, above: pa.Table) -> pa.Table:
        g = _in_order(group)
        paths = _paths(g, above["path"][0].as_py())
        given = [d if o is None else o for d, o in zip(g["digest"].to_pylist(), g["other"].to_pylist(), strict=True)]
        back = [fold(leaf.encode(), path).decode() for leaf, path in zip(given, paths, strict=True)]
        text = lambda values: pa.array(values, pa.string())
        return pa.table({
            "doc_id": g["doc_id"], "leaf": g["digest"], "subroot": text([above["subroot"][0].as_py()] * len(g)),
            "root": text([root] * len(g)), "proof_sha256": text([proof(path).decode() for path in paths]),
            "folded_root": text(back), "verified": pa.array([b == root for b in back]),
        })

    return _blocks(leaves, "doc_id", "other").cogroup(_beside(paths)).applyInArrow(prove, LEAF)
