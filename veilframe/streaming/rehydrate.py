"""Rehydration of chunked streams: a pseudonym may be split over chunks, so the end of the text so far is held back."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rehydrate import Rehydrator

SCHEMA = "stream_id long, block_index int, seq long, text string"


_STOP = re.compile(r"\n|[.!?]\s")


class Buffer:
    """Text of one block: push() gives what is safe, flush() the rest. Joined, they are the rehydrated whole.

    With eager, text also goes as far as the last end of a line or sentence among the held characters.
    """

    def __init__(self, back: Rehydrator, held: str = "", floor: int = 64, eager: bool = False):
        self.back, self.held, self.eager = back, held, eager
        self.suffix = max(floor, 2 * back.longest + 50)

    def push(self, chunk: str) -> str:
        self.held += chunk
        cut = len(self.held) - self.suffix
        if self.eager:
            cut = max([cut, *(m.end() for m in _STOP.finditer(self.held, max(cut, 0)))])
        if self.back.pattern is None:
            cut = len(self.held)
        elif cut > 0:
            cut = self._safe(cut)
        if cut <= 0:
            return ""
        out, self.held = self.held[:cut], self.held[cut:]
        return self.back(out) or ""

    def _safe(self, cut: int) -> int:
        """The last place up to cut over which no match, no protected original and no token stands."""
        busy = [(a, b) for a, b, _ in self.back.spans(self.held)] + ([m.span() for m in self.back.guarded.finditer(self.held)] if self.back.guarded else [])
        while cut > 0:
            to = min((a for a, b in busy if a < cut <= b), default=cut)
            while to > 0 and _token(self.held, to - 1):
                to -= 1
            if to == cut:
                break
            cut = to
        return cut

    def flush(self) -> str:
        out, self.held = self.held, ""
        return self.back(out) or ""


def _token(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] in "_@.-:*")


def rehydrate_batch(events: DataFrame, pairs: dict[str, str], eager: bool = False) -> DataFrame:
    """The batch twin: stream_id, block_index, seq, kind, text, is_end -> the same rows with rehydrated text.

    Kinds text and thinking are rewritten, others pass raw; the rest of a block comes with its end row, or, where there
    is none, as a row of its own behind the last. Blocks are dealt over tasks and come sorted: a task holds one block's
    buffer at a time, however long the block is.
    """
    given = events.sparkSession.sparkContext.broadcast(Rehydrator(pairs))

    def run(batches):
        now, buffer, last = None, None, -1

        def rest():
            if buffer is not None and buffer.held:
                yield (*now, last + 1, buffer.flush())

        for part in batches:
            out = []
            for r in part.itertuples(index=False):
                if (r.stream_id, r.block_index) != now:
                    out += rest()
                    now, buffer = (r.stream_id, r.block_index), Buffer(given.value, eager=eager)
                text = (r.text or "") if r.kind not in ("text", "thinking") else buffer.push(r.text or "")
                out.append((*now, r.seq, text + buffer.flush() if r.is_end else text))
                last = r.seq
            yield pd.DataFrame(out, columns=["stream_id", "block_index", "seq", "text"])
        yield pd.DataFrame(list(rest()), columns=["stream_id", "block_index", "seq", "text"])

    ordered = events.select("stream_id", "block_index", "seq", "kind", "text", "is_end").repartition("stream_id", "block_index").sortWithinPartitions("stream_id", "block_index", "seq")
    return ordered.mapInPandas(run, SCHEMA)


def rehydrate_stream(events: DataFrame, pairs: dict[str, str], timeout_ms: int = 30_000) -> DataFrame:
    """The same on a streaming DataFrame: one state string per block; a block without an end is flushed by timeout."""
    given = events.sparkSession.sparkContext.broadcast(Rehydrator(pairs))

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else ("", -1)
        buffer = Buffer(given.value, held)
        if state.hasTimedOut:
            state.remove()
            if buffer.held:
                yield pd.DataFrame([(key[0], key[1], last + 1, buffer.flush())], columns=["stream_id", "block_index", "seq", "text"])
            return
        out, ended = [], False
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            text = (r.text or "") if r.kind not in ("text", "thinking") else buffer.push(r.text or "")
            if r.is_end:
                text, ended = text + buffer.flush(), True
            out.append((r.stream_id, r.block_index, r.seq, text))
            last = r.seq
        if ended:
            state.remove()
        else:
            state.update((buffer.held, int(last)))
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["stream_id", "block_index", "seq", "text"])

    return events.groupBy("stream_id", "block_index").applyInPandasWithState(run, SCHEMA, "held string, last long", "append", "ProcessingTimeTimeout")


def parse_sse(text: str, max_left: int = 1 << 20) -> tuple[list[str], str]:
    """Data of the whole events of an event stream, and what is left; a leftover beyond max_left is given as data."""
    parts = text.replace("\r\n", "\n").split("\n\n")
    events = ["\n".join(x[5:].removeprefix(" ") for x in p.split("\n") if x.startswith("data:")) for p in parts[:-1]]
    left = parts[-1]
    return ([*events, left], "") if len(left) > max_left else (events, left)


def sse_events(bodies: DataFrame, id_cols: list[str], body_col: str = "body", max_left: int = 1 << 20) -> DataFrame:
    """id columns, seq, data, whole: the events of event streams, native. The text behind the last blank line is an
    event that is not whole; it comes as it is (raw) if it is longer than max_left, else only if it has data lines."""
    text = F.replace(F.col(body_col), F.lit("\r\n"), F.lit("\n"))
    parts = bodies.select(*id_cols, F.split(text, "\n\n", -1).alias("p")).select(*id_cols, F.size("p").alias("n"), F.posexplode("p").alias("seq", "part"))
    lines = F.filter(F.split("part", "\n", -1), lambda x: x.startswith("data:"))
    data = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    whole = F.col("seq") < F.col("n") - 1
    long = ~whole & (F.length("part") > max_left)
    return parts.select(*id_cols, F.col("seq").cast("long").alias("seq"), F.when(long, F.col("part")).otherwise(data).alias("data"), whole.alias("whole")).where((F.col("data") != "") | long)


def openai_chunks(events: DataFrame, stream_col: str = "stream_id") -> DataFrame:
    """Events with data in the chat-completions form as rows for rehydration: all choices share block 0, an end is a
    finish_reason or the [DONE] mark; id and model are kept for the chunk that the rest comes with."""
    done = F.trim("data") == "[DONE]"
    body = F.from_json("data", "id string, model string, choices array<struct<index:int,delta:struct<content:string>,finish_reason:string>>")
    rows = events.select(stream_col, "seq", done.alias("done"), body.alias("c"))
    text = F.array_join(F.transform(F.coalesce("c.choices", F.array().cast("array<struct<index:int,delta:struct<content:string>,finish_reason:string>>")), lambda x: F.coalesce(x["delta"]["content"], F.lit(""))), "")
    ended = F.col("done") | F.coalesce(F.exists("c.choices", lambda x: x["finish_reason"].isNotNull()), F.lit(False))
    return rows.select(F.col(stream_col).alias("stream_id"), F.lit(0).alias("block_index"), "seq", F.lit("text").alias("kind"), text.alias("text"), ended.alias("is_end"), F.col("c.id").alias("chunk_id"), F.col("c.model").alias("model"))


def openai_flush(chunk_id: str, model: str, text: str) -> str:
    """The chunk that carries held text, in front of the end mark."""
    return json.dumps({"id": chunk_id, "object": "chat.completion.chunk", "model": model, "choices": [{"index": 0, "delta": {"content": text}, "finish_reason": None}]}, ensure_ascii=False, separators=(",", ":"))


def anthropic_deltas(events: DataFrame, stream_col: str = "stream_id") -> DataFrame:
    """Events in the messages form as rows: text and thinking deltas by block, tool JSON raw, block stops as ends."""
    body = F.from_json("data", "type string, index int, delta struct<type:string,text:string,thinking:string,partial_json:string>")
    rows = events.select(stream_col, "seq", body.alias("e")).where("e.type in ('content_block_delta', 'content_block_stop')")
    kind = F.when(F.col("e.delta.type") == "text_delta", "text").when(F.col("e.delta.type") == "thinking_delta", "thinking").when(F.col("e.type") == "content_block_stop", "text").otherwise("raw")
    text = F.coalesce("e.delta.text", "e.delta.thinking", "e.delta.partial_json", F.lit(""))
    return rows.select(F.col(stream_col).alias("stream_id"), F.coalesce("e.index", F.lit(0)).alias("block_index"), "seq", kind.alias("kind"), text.alias("text"), (F.col("e.type") == "content_block_stop").alias("is_end"))


def rehydrate_events(events: DataFrame, pairs: dict[str, str], data_col: str = "data") -> DataFrame:
    """Stateless: pseudonyms that stand whole within one event."""
    from ..operators.rehydrate import rehydrate

    return rehydrate(events, pairs, data_col)
