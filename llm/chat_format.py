"""Chat formatting with typed content parts.

A message's content is plain text or a list of typed parts. A visitor walks
the parts in order: text is escaped, and an image, audio or document part becomes a
placeholder whose attachment reference and expanded token count are
recorded on the side, in order. Turns are marked by control strings:

    <s>[role] text</s>       ordinary turns      (role name between brackets)
    placeholder              [[image:0]], [[audio:1]], ...

Inside texts the escape character BACKSLASH is written before every character that
could begin a control string ('<', '[', ']' and itself), so no text, whatever it
holds, can forge a turn or a placeholder, and unescaping gives the
exact text back. `parse` reads a formatted string back into turns.

Defined results: null text is empty; null role is the empty role; rows of one turn number are
ordered by turn (nulls first), role, text; rows that repeat stay repeated; a null
conv_id is a conversation of its own; an empty table gives only the
rows that the caller adds. Only texts of role `assistant` are under the loss mask.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"
ESCAPE = "\\"
_SPECIAL = re.compile(r"[\\<\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: A turn: begin mark, escaped role, escaped text with placeholders, end mark.
_TURN = re.compile(r"<s>\[((?:[^\\<\[\]]|\\.)*)\] ((?:[^\\<\[\]]|\\.|\[\[(?:image|audio|document):[0-9]+\]\])*)</s>", re.DOTALL)
_PLACEHOLDER = re.compile(r"\[\[(image|audio|document):([0-9]+)\]\]")
_BODY = re.compile(r"\\(.)|\[\[(image|audio|document):([0-9]+)\]\]", re.DOTALL)

SCHEMA = (
    "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, "
    "attachments array<struct<position:int,turn:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"
)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rendering:
    """What a visitor has gathered from one conversation."""

    patch: int = 14
    out: list[str] = field(default_factory=list)
    at: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)

    def put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)


class PartVisitor:
    """Flattens content parts. Token counts of attachments follow fixed public rules.

    image: one token per patch of `patch` x `patch` pixels; audio: 50 tokens a second;
    document: one token per four characters of its declared size. Undeclared sizes count one token.
    """

    def __init__(self, patch: int = 14, audio_rate: int = 50, chars_per_token: int = 4):
        self.patch, self.audio_rate, self.chars_per_token = patch, audio_rate, chars_per_token
        self._by_kind: dict[str, Callable[[dict[str, Any]], int]] = {"image": self.image, "audio": self.audio, "document": self.document}

    def image(self, part: dict[str, Any]) -> int:
        w, h = part.get("width") or 0, part.get("height") or 0
        return max(1, -(-w // self.patch) * -(-h // self.patch))

    def audio(self, part: dict[str, Any]) -> int:
        return max(1, round((part.get("seconds") or 0) * self.audio_rate))

    def document(self, part: dict[str, Any]) -> int:
        return max(1, -(-(part.get("chars") or 0) // self.chars_per_token))

    def visit(self, part: Any, turn: int, to: Rendering) -> None:
        """A string or null is text; a list is visited in order; an unknown kind is an error."""
        if part is None:
            return
        if isinstance(part, str):
            to.put(escape(part))
        elif isinstance(part, list):
            for p in part:
                self.visit(p, turn, to)
        elif (kind := part.get("type")) == "text":
            to.put(escape(part.get("text") or ""))
        elif kind in self._by_kind:
            n = len(to.attachments)
            to.attachments.append({"position": n, "turn": turn, "kind": kind, "ref": part.get("ref"), "tokens": self._by_kind[kind](part)})
            to.put(f"[[{kind}:{n}]]")
        else:
            raise ValueError(f"unknown content part: {kind!r}")


def render(messages: list[tuple[str | None, Any]], visitor: PartVisitor | None = None) -> Rendering:
    """(role, content) pairs to a formatted string, loss spans (code points, of the text alone) and attachments."""
    visitor, to = visitor or PartVisitor(), Rendering()
    for turn, (role, content) in enumerate(messages):
        to.put(f"{BOS}[{escape(role or '')}] ")
        start = to.at
        visitor.visit(content, turn, to)
        if role == "assistant":
            to.loss.append((start, to.at))
        to.put(EOS)
    return to


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay as they are. Raises if the string is not well formed."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), _BODY.sub(lambda b: b[1] if b[1] is not None else b[0], m[2])))
        at = m.end()
    return turns


def typed_text(rows: DataFrame) -> DataFrame:
    """rows whose text, where it is not null, becomes the typed content of one text part; `plain` keeps it for the order of ties."""
    part = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))))
    return rows.withColumns({"plain": F.col("text"), "text": F.when(F.col("text").isNotNull(), part)})


def format_conversations(rows: DataFrame, typed: bool = False, visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text), see SCHEMA.

    typed: text holds JSON content parts: a list, one part, or a string; null is no content. A conversation is one result string, so its rows meet
    in one group; groups are as large as single conversations.
    """
    visitor = visitor or PartVisitor()
    tie = F.col("plain") if typed and "plain" in rows.columns else F.col("text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", tie.alias("tie"), "text"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ("attachments", pa.list_(pa.struct([("position", pa.int32()), ("turn", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()),
            ]
        )
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for row in batch.slice(lo, 512).to_pylist():
                    r = render([(x["role"], json.loads(x["text"] or "null") if typed else x["text"]) for x in row["rows"]], visitor)
                    out.append({"conv_id": row["conv_id"], "n_turns": len(row["rows"]), "formatted": "".join(r.out), "loss_spans": [{"start": a, "end": b} for a, b in r.loss], "attachments": r.attachments, "expanded_tokens": sum(a["tokens"] for a in r.attachments)})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return grouped.select("conv_id", "rows").mapInArrow(run, SCHEMA)


def digest(formatted: DataFrame) -> DataFrame:
    """Read the formatted strings back: turn digest, loss text digest and lengths, per conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list[Any]] = {k: [] for k in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens")}
            for row in batch.to_pylist():
                s = row["formatted"]
                turns = parse(s)
                learnt = "".join(unescape(s[x["start"] : x["end"]]) for x in row["loss_spans"])
                out["conv_id"].append(row["conv_id"])
                out["n_turns"].append(len(turns))
                out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                out["loss_chars"].append(len(learnt))
                out["loss_sha256"].append(hashlib.sha256(learnt.encode()).hexdigest())
                out["formatted_chars"].append(len(s))
                out["n_attachments"].append(len(row["attachments"]))
                out["expanded_tokens"].append(row["expanded_tokens"])
            yield pa.RecordBatch.from_pydict(out)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
