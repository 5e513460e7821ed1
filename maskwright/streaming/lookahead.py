"""Streams cut anywhere: text is held back while it may be the start of a placeholder, then restored."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The buffer's limit, the longest placeholder, and the least limit.
LIMIT, LONGEST, LEAST_LIMIT = 512, 64, 128
_OPEN = re.compile(r"\[(?:[A-Z][A-Z0-9_]*)?\Z")


def cut(buffer: str, limit: int = LIMIT) -> tuple[str, str]:
    """(safe to emit, held back). An oversized buffer keeps its last 64 characters only; else everything from the
    last bracket that may still become a placeholder is held. limit: at least 128."""
    if limit < LEAST_LIMIT:
        raise ValueError(f"limit: at least {LEAST_LIMIT}")
    if len(buffer) > limit:
        return buffer[:-LONGEST], buffer[-LONGEST:]
    found = _OPEN.search(buffer, max(0, len(buffer) - LONGEST))
    return (buffer[: found.start()], buffer[found.start() :]) if found else (buffer, "")


def restore(text: str, known: dict[str, str]) -> str:
    for token in sorted(known, key=len, reverse=True):
        text = text.replace(f"[{token}]", known[token])
    return text


def _step(held: str, rows: pd.DataFrame, known: dict[str, str]) -> tuple[str, bool, list[tuple]]:
    """What is held after the rows, in order, whether the stream has ended, and (stream_id, seq, text) of each."""
    out, ended = [], False
    for sid, seq, chunk, last in rows.sort_values("seq")[["stream_id", "seq", "chunk", "last"]].itertuples(index=False):
        safe, held = cut(held + (chunk or ""))
        if last:
            safe, held, ended = safe + held, "", True
        out.append((sid, int(seq), restore(safe, known)))
    return held, ended, out


def _in_turn(waiting: list[list], next_seq: int) -> tuple[list[list], list[list], int]:
    """waiting: [seq, chunk, last], in any order. (those whose turn it is, those that wait for one before them, the seq that is next). A seq that was there already is dropped: a
    chunk that comes twice counts once."""
    ready, rest = [], []
    for row in sorted(waiting, key=lambda r: r[0]):
        if row[0] == next_seq:
            ready.append(row)
            next_seq += 1
        elif row[0] > next_seq:
            rest.append(row)
    return ready, [r for k, r in enumerate(rest) if not k or r[0] != rest[k - 1][0]], next_seq


def _as_rows(frames: Iterator[pd.DataFrame]) -> list[list]:
    """Chunks as text, whether they come as text or bytes, so that state can hold them."""
    text = lambda c: "" if c is None else c if isinstance(c, str) else bytes(c).decode("latin-1")
    return [[int(seq), text(chunk), bool(last)] for f in frames for seq, chunk, last in f[["seq", "chunk", "last"]].itertuples(index=False)]


def restored_stream(chunks: DataFrame, known: dict[str, str], *, idle_ms: int = 600_000, first_seq: int = 0) -> DataFrame:
    """chunks: stream_id, seq, chunk, last. Emits (stream_id, seq, text): per chunk what is safe, with placeholders restored; the last chunk of a stream flushes what is held, and
    its state goes. Chunks are numbered from first_seq on; one that comes before its predecessor waits for it, over micro-batches, and one that comes again is
    dropped. A stream that is idle for idle_ms is given up: what waits comes out in order, and what is held with it, in one more row if nothing waits."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, next_seq, waiting = state.get if state.exists else ("", first_seq, "[]")
        rows, gone = json.loads(waiting), state.hasTimedOut
        if gone:
            ready, rest = sorted(rows), []
        else:
            ready, rest, next_seq = _in_turn(rows + _as_rows(frames), next_seq)
        frame = pd.DataFrame([[key[0], *r] for r in ready], columns=["stream_id", "seq", "chunk", "last"])
        held, ended, out = _step(held, frame, known)
        if gone and held:
            out.append((key[0], ready[-1][0] + 1 if ready else next_seq, restore(held, known)))
        if gone or ended:
            if state.exists:
                state.remove()
        else:
            state.update((held, next_seq, json.dumps(rest)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "held string, next_seq long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def restored_batch(chunks: DataFrame, known: dict[str, str]) -> DataFrame:
    """The same over a finite table: a stream's chunks are one group."""
    return chunks.groupBy("stream_id").applyInPandas(lambda rows: pd.DataFrame(_step("", rows, known)[2], columns=["stream_id", "seq", "text"]), "stream_id string, seq long, text string")


class EventParser:
    """Server-sent events from bytes cut anywhere, also inside a character. A blank line ends an event; \\r\\n counts as \\n."""

    def __init__(self, rest: bytes = b"") -> None:
        self.rest = rest

    def feed(self, chunk: bytes) -> list[str]:
        """The events that are complete now, as they came."""
        data, out, at = self.rest + chunk, [], 0
        for end in _EVENT_END.finditer(data):
            out.append(data[at : end.end()].decode("utf-8", "replace"))
            at = end.end()
        self.rest = data[at:]
        return out

    def flush(self) -> list[str]:
        rest, self.rest = self.rest.decode("utf-8", "replace"), b""
        return [rest] if rest.strip() else []


_EVENT_END = re.compile(rb"\r\n\r\n|\n\n")


def event_fields(event: str) -> tuple[str | None, str]:
    """(type, data): data lines are joined by line feeds."""
    kind, data = None, []
    for line in event.splitlines():
        name, _, value = line.partition(":")
        if name == "event":
            kind = value.strip()
        elif name == "data":
            data.append(value.strip())
    return kind, "\n".join(data)


def _slot(provider: str | None, event: object) -> tuple[object, object] | None:
    """(holder, key) of the text that a stream event adds: of the first choice or candidate only."""

    def at(x: object, *path: object) -> object:
        for key in path:
            if isinstance(key, int):
                x = x[key] if isinstance(x, list) and len(x) > key else None
            else:
                x = x.get(key) if isinstance(x, dict) else None
        return x

    if provider == "claude":
        holder, key = at(event, "delta"), "text"
        if at(event, "type") != "content_block_delta" or at(holder, "type") != "text_delta":
            return None
    elif provider == "openai":
        holder, key = at(event, "choices", 0, "delta"), "content"
    elif provider == "gemini":
        holder, key = at(event, "candidates", 0, "content", "parts", 0), "text"
    else:
        return None
    return (holder, key) if isinstance(at(holder, key), str) else None


# An event that carries the last piece of text, by provider.
_TAIL = {
    "claude": lambda t: ("content_block_delta", {"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": t}}),
    "openai": lambda t: (None, {"choices": [{"index": 0, "delta": {"content": t}}]}),
    "gemini": lambda t: (None, {"candidates": [{"content": {"parts": [{"text": t}]}}]}),
}


def event_text(kind: str | None, body: object) -> str:
    return (f"event: {kind}\n" if kind else "") + f"data: {json.dumps(body, ensure_ascii=False)}\n\n"


class EventRehydrator:
    """Events of one response stream, with placeholders in their text restored; other events pass as they came. state is what to keep between chunks."""

    def __init__(self, known: dict[str, str], provider: str | None, state: tuple[bytes, str] = (b"", "")) -> None:
        self.known, self.provider = known, provider
        self.parser, self.held = EventParser(state[0]), state[1]

    @property
    def state(self) -> tuple[bytes, str]:
        return self.parser.rest, self.held

    def _one(self, raw: str) -> str:
        kind, data = event_fields(raw)
        try:
            body = json.loads(data)
        except (ValueError, RecursionError):
            return raw
        slot = _slot(self.provider, body)
        if slot is None:
            return raw
        holder, key = slot
        safe, self.held = cut(self.held + holder[key])
        holder[key] = restore(safe, self.known)
        return event_text(kind, body)

    def feed(self, chunk: bytes) -> str:
        return "".join(map(self._one, self.parser.feed(chunk)))

    def flush(self) -> str:
        out = "".join(map(self._one, self.parser.flush()))
        held, self.held = self.held, ""
        if held and self.provider in _TAIL:
            out += event_text(*_TAIL[self.provider](restore(held, self.known)))
        return out


def rehydrated_events(chunks: DataFrame, known: dict[str, str], *, idle_ms: int = 600_000, first_seq: int = 0) -> DataFrame:
    """chunks: stream_id, provider, seq, chunk (binary), last. Emits (stream_id, seq, out): the bytes to forward, as text. Order, repeats and idle streams are as in
    restored_stream(); the state of a stream goes with its last chunk."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest_bytes, held, provider, next_seq, waiting = state.get if state.exists else (b"", "", None, first_seq, "[]")
        rows, gone = json.loads(waiting), state.hasTimedOut
        if gone:
            ready, rest = sorted(rows), []
        else:
            frames = list(frames)
            provider = provider or next((p for f in frames for p in f["provider"] if p is not None), None)
            ready, rest, next_seq = _in_turn(rows + _as_rows(frames), next_seq)
        one, out, ended = EventRehydrator(known, provider, (bytes(rest_bytes), held)), [], gone
        for seq, chunk, last in ready:
            text = one.feed(chunk.encode("latin-1"))
            if last:
                text, ended = text + one.flush(), True
            out.append((key[0], seq, text))
        if gone:
            out.append((key[0], ready[-1][0] + 1 if ready else next_seq, one.flush()))
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((*one.state, provider, next_seq, json.dumps(rest)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["stream_id", "seq", "out"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, out string", "rest binary, held string, provider string, next_seq long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rehydrated_events_batch(chunks: DataFrame, known: dict[str, str]) -> DataFrame:
    """The same over a finite table."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        one, out = EventRehydrator(known, rows["provider"].iloc[0]), []
        for sid, seq, chunk, last in rows[["stream_id", "seq", "chunk", "last"]].itertuples(index=False):
            out.append((sid, int(seq), one.feed(bytes(chunk or b"")) + (one.flush() if last else "")))
        return pd.DataFrame(out, columns=["stream_id", "seq", "out"])

    return chunks.groupBy("stream_id").applyInPandas(whole, "stream_id string, seq long, out string")


def sse_events(chunks: DataFrame) -> DataFrame:
    """stream_id, seq, chunk (binary or text) to server-sent events: (stream_id, n, event_type, data). A stream is one group, parsed chunk by chunk."""

    def parse(rows: pd.DataFrame) -> pd.DataFrame:
        parser, events = EventParser(), []
        for chunk in rows.sort_values("seq")["chunk"]:
            events += parser.feed(chunk.encode() if isinstance(chunk, str) else bytes(chunk or b""))
        events += parser.flush()
        both = [event_fields(e) for e in events if e.strip()]
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "n": range(len(both)), "event_type": [k for k, _ in both], "data": [d for _, d in both]})

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.groupBy("stream_id").applyInPandas(parse, f"stream_id {kind}, n int, event_type string, data string")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
