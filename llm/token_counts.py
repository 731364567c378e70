"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary piece that a word
starts with, then goes on behind it. A trie over the pieces gets failure links: when a
node has no edge for the next byte, the link leads to the node of what remains once
the pieces that are then settled are popped, and the number of popped pieces is
stored with the link. Links are closed into one transition table, so each byte
costs one look-up of a next node and one of a count, and no piece is ever built.
At a word's end a node's stored count settles what is left. The table takes 6 bytes a node and byte class in every worker: 144 MB for
50,000 pieces (98,000 nodes). A vocabulary whose table would pass TABLE_BYTES keeps its edges and links (16 bytes a node) and
follows the links; the counts are the same.

Words are runs of characters that are not ASCII white space; a piece that starts a
word may carry a marker (word-initial pieces), as byte-level vocabularies do with a space.
All words of a slice advance together, one byte a step, longest words first; words of over LONG bytes go alone. Texts longer than
a slice are read in parts.

Defined results: null and empty texts have 0 tokens; a byte that no piece covers
makes the whole word one unknown token, as in greedy word-piece; rows that
repeat are counted again; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as T

#: Where the public vocabularies lie; a parameter of every caller.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of the closed table in a worker; beyond that links are followed.
TABLE_BYTES = 192 << 20
#: Bytes of a word that is counted on its own.
LONG = 4096
DEAD = -1


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file (base64 piece, space, rank)."""
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line]


class LongestMatch:
    """The automaton over byte classes.

    marker: prefix that a piece at a word's start carries (b" " for byte-level vocabularies);
    the start node is the one reached by the marker.
    """

    def __init__(self, pieces: list[bytes], marker: bytes = b" ", table_bytes: int = TABLE_BYTES):
        self.classes = np.zeros(256, np.int64)
        for c in sorted({b for p in pieces for b in p}):
            self.classes[c] = self.classes.max() + 1
        self.width = int(self.classes.max()) + 1
        edges: list[dict[int, int]] = [{}]
        token = [False]
        parent = [(0, 0)]
        for piece in pieces:
            node = 0
            for b in piece:
                c = int(self.classes[b])
                nxt = edges[node].get(c)
                if nxt is None:
                    nxt = len(edges)
                    edges[node][c] = nxt
                    edges.append({})
                    token.append(False)
                    parent.append((node, c))
                node = nxt
            token[node] = node > 0
        n = len(edges)
        self.rest = np.zeros(n, np.int32)
        self.fail = np.full(n, DEAD, np.int64)
        self.popped = np.zeros(n, np.int64)
        order = [0]
        for node in order:  # breadth first: a link always leads to a shallower node
            order.extend(edges[node].values())
            if not node:
                continue
            up, c = parent[node]
            if token[node]:
                self.fail[node], self.popped[node] = 0, 1
            elif up:
                to, settled = self._follow(edges, int(self.fail[up]), c)
                if to != DEAD:
                    self.fail[node], self.popped[node] = to, self.popped[up] + settled
            to = self.fail[node]
            self.rest[node] = DEAD if to == DEAD or self.rest[to] == DEAD else self.rest[to] + self.popped[node]
        self.closed = n * self.width * 6 <= table_bytes
        if self.closed:
            self._close(edges, order)
        else:
            pairs = sorted((node * self.width + c, child) for node in order for c, child in edges[node].items())
            self.key, self.child = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.start = 0
        for b in marker:
            to, _ = self._follow(edges, self.start, int(self.classes[b]))
            self.start = max(to, 0)

    def _follow(self, edges: list[dict[int, int]], node: int, c: int) -> tuple[int, int]:
        """(next node, pieces popped) of one byte, by links."""
        settled = 0
        while node != DEAD:
            if c in edges[node]:
                return edges[node][c], settled
            if not node:
                break
            settled += int(self.popped[node])
            node = int(self.fail[node])
        return DEAD, 0

    def _close(self, edges: list[dict[int, int]], order: list[int]) -> None:
        go = np.full((len(edges), self.width), DEAD, np.int32)
        pops = np.zeros((len(edges), self.width), np.int16)
        for node in order:
            to = int(self.fail[node])
            if to != DEAD:
                go[node] = go[to]
                pops[node] = pops[to] + self.popped[node]
            for c, child in edges[node].items():
                go[node, c] = child
                pops[node, c] = 0
        self.go, self.pops = go.ravel(), pops.ravel()

    def step(self, node: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next nodes, pieces popped) of one byte each; DEAD where no piece goes on."""
        cell = node * self.width + c
        if self.closed:
            return self.go[cell].astype(np.int64), self.pops[cell]
        out, settled, node = np.full(len(node), DEAD, np.int64), np.zeros(len(node), np.int64), node.copy()
        open_ = np.arange(len(node))
        while len(open_):
            key = node[open_] * self.width + c[open_]
            at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
            hit = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
            out[open_[hit]] = self.child[at[hit]]
            open_ = open_[~hit]
            open_ = open_[node[open_] > 0]
            settled[open_] += self.popped[node[open_]]
            node[open_] = self.fail[node[open_]]
            open_ = open_[node[open_] != DEAD]
        return out, settled

    def _alone(self, byte_class: np.ndarray) -> int:
        """Tokens of one long word."""
        if not self.closed:
            node, total = np.array([self.start]), 0
            for k in range(len(byte_class)):
                node, settled = self.step(node, byte_class[k : k + 1])
                if node[0] == DEAD:
                    return 1
                total += int(settled[0])
            node = int(node[0])
        else:
            go, pops, width, node, total = memoryview(self.go), memoryview(self.pops), self.width, self.start, 0
            for c in byte_class.astype(np.uint8).tobytes() if width <= 256 else byte_class.tolist():
                cell = node * width + c
                node = go[cell]
                if node == DEAD:
                    return 1
                total += pops[cell]
        return 1 if self.rest[node] == DEAD else total + int(self.rest[node])

    def count(self, words: T.Words) -> np.ndarray:
        """Tokens of each word."""
        length = (words.end - words.start).astype(np.int64)
        order = np.argsort(-length, kind="stable")
        byte_class = self.classes[words.buf]
        out = np.empty(len(order), np.int64)
        long = int((length > LONG).sum())
        for k in order[:long].tolist():
            out[k] = self._alone(byte_class[words.start[k] : words.end[k]])
        order = order[long:]
        length, at = length[order], words.start[order]
        node = np.full(len(order), self.start, np.int64)
        total = np.zeros(len(order), np.int64)
        longest = int(length[0]) if len(length) else 0
        shorter = np.searchsorted(-length, -np.arange(longest), side="left")
        for step in range(longest):
            live = int(shorter[step])
            nxt, settled = self.step(node[:live], byte_class[at[:live] + step])
            total[:live] += settled
            lost = nxt == DEAD
            if lost.any():
                total[:live][lost] = -(1 << 40)
                nxt[lost] = 0
            node[:live] = nxt
        end = self.rest[node].astype(np.int64)
        out[order] = np.where((total < 0) | (end == DEAD), 1, total + end)
        return out


_BUILT: dict[tuple[int, bytes], LongestMatch] = {}


def count_tokens(docs: DataFrame, path: str = VOCABULARY, marker: bytes = b" ") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Only the piece list is sent out; a worker builds the automaton once and keeps it.
    """
    pieces = read_pieces(path)
    held = docs.sparkSession.sparkContext.broadcast(pieces)
    key = (hash(tuple(pieces)), marker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offsets, _ in T.slices(batches):
            if key not in _BUILT:
                _BUILT.clear()
                _BUILT[key] = LongestMatch(held.value, marker)
            n, tokens = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            for at, many, part, edges in T.pieces(buf, offsets, T.SPACE_CLASS):
                words = T.Words(part, edges, T.SPACE_CLASS)
                total = np.concatenate([[0], np.cumsum(_BUILT[key].count(words))])
                n[at : at + many] += np.diff(words.first)
                tokens[at : at + many] += total[words.first[1:]] - total[words.first[:-1]]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(n), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
