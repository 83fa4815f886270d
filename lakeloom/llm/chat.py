"""Chat formatting from an event log.

Messages arrive as events: whole messages, streamed deltas, edits and regenerations. The
log is folded per message into final texts, conversations are put in order, and the final
messages are rendered with turn marks, control strings inside texts escaped reversibly,
and the spans that the loss covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import map_arrow

#: Fixed marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: A rendered piece holds about this many characters at most, so no conversation has to fit in a row.
PIECE = 1_000_000


def escape(text: str) -> str:
    """No "<|" is left in a text; unescape() undoes it. A backslash is doubled, "<|" becomes "<\\|"."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """Escaped, and on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


EVENT = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"


def numbered(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages (conv_id, message, role, text); numbers follow turn, then role and text.

    Rows are sorted in ranges, so a conversation of any length is numbered by many tasks.
    Numbers of one conversation ascend and differ, with gaps; rows that are equal stay apart.
    """
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    keys = [F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "role", "text")]
    # ranges are parted by a text's beginning: their bounds are sampled, and whole texts would be too much to sample
    parted = c.repartitionByRange(*keys[:3], F.substring("text", 1, 32).asc_nulls_first())
    return parted.sortWithinPartitions(*keys).select("conv_id", F.monotonically_increasing_id().alias("message"), "role", "text")


def _as_events(messages: DataFrame, events: Column) -> DataFrame:
    """``events``: an array of structs (step, kind, role, text) for each message; its steps give the sequence."""
    e = messages.select("conv_id", "message", F.explode(events).alias("e"))
    return e.select("conv_id", (F.col("message") * 16 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "message", F.col("e.role").alias("role"), F.col("e.text").alias("text"))


def _event(step: int, kind: str, role: Column | None, text: Column | None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), (null if role is None else role).alias("role"), (null if text is None else text).alias("text"))


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """Conversations as a log of whole messages."""
    return _as_events(numbered(conversations), F.array(_event(0, "message", F.col("role"), F.col("text"))))


def messages_as_stream(conversations: DataFrame) -> DataFrame:
    """Conversations as the log of a chat service that they could have come from.

    By the message's hash it was streamed in three deltas; or was drafted and edited; or
    was drafted, streamed on, and regenerated in deltas; or was announced by its first
    delta, which the log delivers twice. Folding the log gives the messages back.
    """
    role, text = F.col("role"), F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    part = [F.substring(text, F.lit(1), third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, third)]
    draft = F.upper(F.reverse(part[0]))
    streamed = F.array(_event(0, "message", role, None), *(_event(i + 1, "delta", None, part[i]) for i in range(3)))
    edited = F.array(_event(0, "message", role, draft), _event(9, "edit", None, text))
    again = F.array(
        _event(0, "message", role, draft), _event(1, "delta", None, draft), _event(2, "regenerate", None, None), *(_event(i + 3, "delta", None, part[i]) for i in range(3)),
    )
    twice = F.array(_event(1, "delta", role, part[0]), _event(1, "delta", role, part[0]), _event(2, "delta", None, part[1]), _event(3, "delta", None, part[2]))
    m = numbered(conversations).withColumn("way", F.pmod(F.xxhash64("message", "text"), F.lit(4)))
    return _as_events(m, F.when(F.col("way") == 0, streamed).when(F.col("way") == 1, edited).when(F.col("way") == 2, again).otherwise(twice))


_SORT = ["conv_id", "message", "seq", "kind", "text", "role"]


def _in_order(events: DataFrame) -> DataFrame:
    """The log's events by conversation, message and sequence; a message's are together, a conversation's may be in many tasks."""
    e = events.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in EVENT.split(", ")))
    e = e.where(F.col("message").isNotNull() & F.col("kind").isin("message", "delta", "edit", "regenerate", "delete"))
    keys = [F.col(c).asc_nulls_first() for c in _SORT]
    return e.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str]]:
    """Final messages of sorted events, one at a time."""
    now, last, parts, dead, role, role_at = None, None, [], False, None, None
    for b in batches:
        for e in zip(*(b[c].to_pylist() for c in ("conv_id", "message", "seq", "kind", "text", "role"))):
            if e == last:
                continue
            last = e
            conv, message, seq, kind, text, who = e
            if (conv, message) != now:
                if now and not dead:
                    yield *now, role or "", "".join(parts)
                now, parts, dead, role, role_at = (conv, message), [], False, None, None
            if kind == "delta":
                parts.append(text or "")
            else:
                parts, dead = [text or ""] if kind in ("message", "edit") else [], kind == "delete"
            if who is not None and (role is None or (seq is not None, seq or 0, who) >= role_at):
                role, role_at = who, (seq is not None, seq or 0, who)
    if now and not dead:
        yield *now, role or "", "".join(parts)


_MESSAGE = "conv_id bigint, message bigint, role string, text string"


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, held = [c.split()[0] for c in _MESSAGE.split(", ")], []
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    size = 0
    for m in _fold(batches):
        held.append(m)
        size += len(m[3]) + 50
        if size > PIECE:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log.

    kinds: ``message`` sets a message's role and text; ``delta`` appends text; ``edit``
    replaces the text; ``regenerate`` empties it, and later deltas build it anew; ``delete``
    removes the message, unless a later event but a delta sets it again. Each concerns its
    own message only: a regenerated or edited message leaves those after it as they are.
    Events count in the order of seq, ties by kind, text and role. A log may deliver an
    event twice: equal rows of one seq count once. Unknown kinds and events without message
    number are ignored, a null text is empty, a null role becomes the last role known and
    else empty. A message that has only deltas has their role. A null conv_id is a
    conversation of its own. An empty log has no messages. Other columns are not read.

    Events are dealt and sorted by conversation, message and sequence and folded as they
    pass; a conversation of any length spreads over tasks, and a task holds one message.
    """
    return map_arrow(_in_order(events), _messages, _MESSAGE)


_PIECE = "conv_id bigint, piece bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _render(loss_role: str, messages: Iterator[tuple[int | None, int, str, str]]) -> Iterator[pa.RecordBatch]:
    """Pieces of rendered messages; a piece holds messages of one conversation, in order."""
    names = [c.split()[0] for c in _PIECE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    out: list[list] = [[] for _ in names]
    none = object()
    conv, piece, parts, spans, size, held = none, 0, [], [], 0, 0

    def close() -> None:
        if parts:
            for c, v in zip(out, (conv, piece, "".join(parts), [{"start": a, "end": z} for a, z in spans])):
                c.append(v)

    for c, number, role, text in messages:
        if c != conv or size > PIECE:
            close()
            held += size
            if held > PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                out, held = [[] for _ in names], 0
            conv, piece, parts, spans, size = c, number, [], [], 0
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == loss_role:
            spans.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        size += len(head) + len(body) + len(END) + 1
    close()
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, str, str]]:
    for b in batches:
        yield from zip(b["conv_id"].to_pylist(), b["message"].to_pylist(), b["role"].to_pylist(), b["text"].to_pylist())


def _render_rows(loss_role: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _render(loss_role, _rows(batches))


def _render_log(loss_role: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _render(loss_role, _fold(batches))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, piece, formatted, loss): the conversations as text with the loss mask's spans.

    A message is ``<|im_start|>role\\ntext<|im_end|>\\n`` with role and text escaped. A loss
    span covers the escaped text of one message of ``loss_role``, in characters of its
    piece; end marks are not under the loss. Nearly every conversation is one piece; a
    very long one is several, perhaps of several tasks, and ``piece``, the number of its
    first message, gives their order. A null conv_id is a conversation of its own, null
    roles and texts are empty. An empty table gives no rows.
    """
    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("message").cast("bigint").alias("message"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "message", "role", "text")]
    return map_arrow(m.repartitionByRange(*keys[:2]).sortWithinPartitions(*keys), partial(_render_rows, loss_role), _PIECE)


def format_log(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """render(fold_events(events)) in one pass over the sorted log."""
    return map_arrow(_in_order(events), partial(_render_log, loss_role), _PIECE)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered piece."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    none = object()
    conv, n, turns, loss, loss_n, chars = none, 0, None, None, 0, 0
    for b in batches:
        out: list[list] = [[] for _ in names]
        for c, text, spans in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), b["loss"].to_pylist()):
            if c != conv:
                if conv is not none:
                    for x, v in zip(out, (conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)):
                        x.append(v)
                conv, n, turns, loss, loss_n, chars = c, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s in spans:
                said = unescape(text[s["start"] : s["end"]])
                loss.update(said.encode("utf-8", "surrogatepass"))
                loss_n += len(said)
            chars += len(text)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)
    if conv is not none:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars), kinds)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, from the rendered text and its loss spans alone.

    A digest is one stream in order, so one task reads a conversation's pieces, one at a time.
    """
    d = formatted.select("conv_id", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return map_arrow(d, _digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
