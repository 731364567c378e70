"""Packed answers: what many buckets say about a key goes to the key's group in few rows.

An entry belongs to an owner (three longs, of which the first two are the key). `pack` makes
one row per group of owners, so a bucket sends as many rows as there are groups,
not one per owner; `unpack` reads a group's rows back, entries of one owner together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkit as T

FIELDS = "g int, owners binary, counts binary, values binary"
SCHEMA = pa.schema([("g", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("values", pa.binary())])


def group_of(owners: np.ndarray, groups: int) -> np.ndarray:
    mixed = T.mix(owners[:, 0].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + owners[:, 1].astype(np.uint64))
    return (mixed % np.uint64(groups)).astype(np.int64)


def pack(owners: np.ndarray, of: np.ndarray, values: np.ndarray, groups: int, to_bytes, by_first: bool = False) -> pa.Table:
    """owners: (m, 3) longs; of: owner of each value; by_first: the first long alone names the group."""
    if not len(of):
        return SCHEMA.empty_table()
    g = group_of(owners * [1, 0, 0] if by_first else owners, groups)
    order = np.lexsort((of, g[of]))
    of, values = of[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    who = of[begin]
    counts = np.diff(np.append(begin, len(of)))
    step = np.flatnonzero(np.concatenate([[True], g[who][1:] != g[who][:-1]]))
    rows = list(zip(step.tolist(), np.append(step[1:], len(who)).tolist(), strict=True))
    edge = np.append(begin, len(of))
    return pa.table(
        [
            pa.array(g[who][step].astype(np.int32)),
            pa.array([owners[who[lo:hi]].astype("<i8").tobytes() for lo, hi in rows], pa.binary()),
            pa.array([counts[lo:hi].astype("<i4").tobytes() for lo, hi in rows], pa.binary()),
            pa.array([to_bytes(values[edge[lo] : edge[hi]]) for lo, hi in rows], pa.binary()),
        ],
        schema=SCHEMA,
    )


def unpack(group: pa.Table, from_bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners (m, 3) by key, first value of each owner (m + 1), values."""
    owners = np.frombuffer(b"".join(group["owners"].to_pylist()), "<i8").reshape(-1, 3)
    counts = np.frombuffer(b"".join(group["counts"].to_pylist()), "<i4")
    values = from_bytes(b"".join(group["values"].to_pylist()))
    order = np.lexsort((owners[:, 1], owners[:, 0]))
    begin = np.cumsum(counts) - counts
    owners, counts, begin = owners[order], counts[order], begin[order]
    index = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(values))
    head = np.concatenate([[True], (owners[1:, :2] != owners[:-1, :2]).any(1)]) if len(owners) else np.zeros(0, bool)
    first = np.append((np.cumsum(counts) - counts)[head], len(values))
    return owners[head], first, values[index]
