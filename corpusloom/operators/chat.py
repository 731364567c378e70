"""Chat over the corpus: grounded prompts as columns, and the stream of an answer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalars as S

MOST_SOURCES, EXCERPT_CHARS = 4, 2000
#: The marks around what documents say, which a model must not take for instructions.
BEGIN, END = "BEGIN UNTRUSTED INDEXED-DOCUMENT CONTEXT (JSON)\n", "\nEND UNTRUSTED INDEXED-DOCUMENT CONTEXT\n\nUser question:\n"
MOST_INPUT_BYTES, MOST_RECORD_BYTES, MOST_RECORDS, MOST_OUTPUT_CHARS = 512 << 10, 256 << 10, 10_000, 2_000_000
FLUSH_CHARS, FLUSH_SECONDS = 2048, 0.15


class ChatError(RuntimeError):
    pass


def json_text(value: Column) -> Column:
    """A string or number as JSON; null as null."""
    whole = F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def numbered_sources(hits: DataFrame, key: str) -> DataFrame:
    """hits (key, rank, chunk_id, path, page_number, section, text) cut to MOST_SOURCES a key, each chunk once, with
    source_id S1, S2, ... by rank, filename and excerpt."""
    once = Window.partitionBy(key, "chunk_id").orderBy("rank")
    d = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rank", "chunk_id"))).where(F.col("_n") <= MOST_SOURCES)
    named = {
        "source_id": F.concat(F.lit("S"), F.col("_n").cast("string")),
        "filename": S.basename("path"),
        "excerpt": F.substring("text", 1, EXCERPT_CHARS),
    }
    return d.withColumns(named).drop("_n")


def grounded_prompts(questions: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """questions (key, question) with prompt: the numbered sources as JSON between fixed marks, then the question.

    Text of documents stands inside JSON strings only, so no document can end the context. Without sources the context is empty.
    """
    fields = ("excerpt", "filename", "page_number", "section", "source_id")
    one = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{f}": '), json_text(F.col(f))) for f in fields]), F.lit("}"))
    n = F.substring("source_id", 2, 9).cast("int")
    packed = sources.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), one.alias("j")))).alias("s"))
    context = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("s", lambda x: x["j"]), ", "), F.lit("")), F.lit("]"))
    asked = F.coalesce("question", F.lit(""))
    d = questions.join(packed, key, "left")
    return d.select(*questions.columns, F.concat(F.lit(BEGIN), context, F.lit(END), asked).alias("prompt"))


def ask(question: str, retrieve: Callable[[str], Sequence[dict]]) -> tuple[str, list[dict]]:
    """(prompt, numbered sources) of one question, for a caller with a model; small talk is passed on without sources."""
    sources: list[dict] = []
    for hit in retrieve(question):
        if len(sources) < MOST_SOURCES and all(s["chunk_id"] != hit["chunk_id"] for s in sources):
            name = hit["path"].rsplit("/", 1)[-1]
            text = (hit.get("text") or hit.get("excerpt") or "")[:EXCERPT_CHARS]
            sources.append({**hit, "source_id": f"S{len(sources) + 1}", "filename": name, "excerpt": text})
    fields = ("excerpt", "filename", "page_number", "section", "source_id")
    context = json.dumps([{f: s.get(f) for f in fields} for s in sources], ensure_ascii=False, separators=(", ", ": "))
    return f"{BEGIN}{context}{END}{question}", sources


def request(model: str, messages: Sequence[tuple[str, str]]) -> bytes:
    """The body of a streamed chat request; ValueError where it is empty or too large."""
    if not model.strip() or not messages:
        raise ValueError("a model and at least one message are needed")
    body = {"model": model.strip(), "messages": [{"role": r, "content": c} for r, c in messages], "stream": True}
    raw = json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()
    if len(raw) > MOST_INPUT_BYTES:
        raise ValueError(f"the request has {len(raw)} bytes, more than {MOST_INPUT_BYTES}")
    return raw


def lines(parts: Iterable[bytes], most: int = MOST_RECORD_BYTES) -> Iterator[bytes]:
    """Lines of a byte stream; one longer than `most` is an error before it is held whole."""
    rest = b""
    for part in parts:
        *whole, rest = (rest + part).split(b"\n")
        for line in whole:
            if len(line) > most:
                raise ChatError("a record is too large")
            yield line
        if len(rest) > most:
            raise ChatError("a record is too large")
    if rest:
        yield rest


def deltas(parts: Iterable[bytes], stop: Callable[[], bool] = lambda: False) -> Iterator[str]:
    """Pieces of the answer from newline-delimited JSON records; the stream must end with a record that says done.

    Asked to stop, it ends without an error.
    """
    said = 0
    for n, line in enumerate(lines(parts), 1):
        if stop():
            return
        if n > MOST_RECORDS:
            raise ChatError("too many records")
        if not line.strip():
            continue
        try:
            record = json.loads(line)
        except ValueError as e:
            raise ChatError("a record is not JSON") from e
        if not isinstance(record, dict):
            raise ChatError("a record is no object")
        if record.get("error"):
            raise ChatError(f"the model failed: {str(record['error'])[:300]}")
        message = record.get("message") or {}
        text = message.get("content", "") if isinstance(message, dict) else None
        if not isinstance(text, str):
            raise ChatError("a record's message has no text")
        said += len(text)
        if said > MOST_OUTPUT_CHARS:
            raise ChatError("the answer is too long")
        if text:
            yield text
        if record.get("done") is True:
            return
    if not stop():
        raise ChatError("the stream ended before its last record")


def batched(pieces: Iterable[str], clock: Callable[[], float] = time.monotonic) -> Iterator[str]:
    """Pieces joined: the first at once, then whenever FLUSH_CHARS are waiting or FLUSH_SECONDS have passed, and the rest at the end."""
    waiting, size, last = [], 0, None
    for piece in pieces:
        waiting.append(piece)
        size += len(piece)
        now = clock()
        if last is None or size >= FLUSH_CHARS or now - last >= FLUSH_SECONDS:
            yield "".join(waiting)
            waiting, size, last = [], 0, now
    if waiting:
        yield "".join(waiting)
