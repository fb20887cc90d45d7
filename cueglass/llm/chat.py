"""Chat transcripts rebuilt from event logs, rendered with a loss mask and read back.

Template of one turn::

    ### <role>: <text></turn>\\n

Inside roles and texts a backslash goes before each ``\\``, ``#`` and ``<``, inside roles
also before ``:``, so no control string can arise from a text; reading back takes the
backslashes away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of events. A message opens a turn with a text, a delta adds to it, an edit
#: replaces it and a regeneration empties it; the last two also end all later turns.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"

_ESCAPED = re.compile(r"[\\#<]")
_UNESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)

RENDERED = "conv_id {kind}, part long, start long, chunk string, loss_from long, loss_to long"
DIGEST = (
    "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A message event for each (conv_id, turn, role, text) row."""
    return rows.select(
        "conv_id", "turn", F.col("turn").alias("seq"), F.lit(MESSAGE).alias("kind"), "role", "text"
    )


def _messages(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of the messages that stand at the end of each log.

    Events arrive by (conv_id, turn, seq). An edit or regeneration wipes what was said
    before it in later turns, so the latest one seen so far in earlier turns tells which
    events still count; only one turn is held at a time.
    """
    conv, cut, reset, turn = object(), None, None, object()
    role, texts = None, []

    def older(seq, than) -> bool:
        return than is not None and seq is not None and seq < than

    for conv_id, at, seq, kind, who, text in events:
        fresh = conv_id != conv
        if fresh or at != turn or kind == MESSAGE:
            if texts:
                yield conv, role, "".join(texts)
            role, texts = None, []
        if fresh:
            conv, cut, reset = conv_id, None, None
        if fresh or at != turn:
            if reset is not None and (cut is None or reset > cut):
                cut = reset
            turn, reset = at, None
        if older(seq, cut):
            continue
        if kind in (EDIT, REGENERATE):
            texts = []
            if seq is not None:
                reset = seq
        role = who if role is None else role
        texts.append((text or "") if kind != REGENERATE else "")
    if texts:
        yield conv, role, "".join(texts)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in columns], names=names)


def render(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row for each turn of the formatted conversations, in order of ``part``.

    A conversation's formatted text is its chunks one after the other; ``start`` is a
    chunk's place in it, ``loss_from`` and ``loss_to`` bound the masked part (the texts
    of role ``learn``), null for other roles. All places count code points.

    ``events`` has conv_id, turn, seq, kind, role and text. Events of a conversation are
    taken by turn and, inside a turn, by seq (nulls first), then kind, role and text;
    events of unknown kind count as deltas. A null role or text is empty; null
    conv_ids form one conversation. Conversations are streamed turn by turn, so a very
    long one needs the memory of one turn only. Other columns are ignored.
    """
    kind = events.schema["conv_id"].dataType.simpleString()
    columns = ["conv_id", "turn", "seq", "kind", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, string = pa.int64(), pa.string()
        names = ["conv_id", "part", "start", "chunk", "loss_from", "loss_to"]
        kinds = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field("conv_id").type, long, long, string, long, long]
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

        out, conv, part, at = [], object(), 0, 0
        for conv_id, role, text in _messages(rows()):
            if conv_id != conv:
                conv, part, at = conv_id, 0, 0
            name = escape(role or "").replace(":", r"\:")
            head, body = f"### {name}: ", escape(text)
            chunk = f"{head}{body}</turn>\n"
            masked = (at + len(head), at + len(head) + len(body)) if role == learn else (None, None)
            out.append((conv_id, part, at, chunk, *masked))
            part, at = part + 1, at + len(chunk)
            if len(out) == 1000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)

    return (
        events.select(*columns)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
        .mapInArrow(run, RENDERED.format(kind=kind))
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Turns are parsed from the formatted text and unescaped; the masked text is cut out
    by its places. ``turns_sha256`` covers role, line end, text, line end of every turn.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, string = pa.int64(), pa.string()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        fields = ("conv_id", "start", "chunk", "loss_from", "loss_to")
        conv = turns = None
        for batch in batches:
            kinds = [batch.schema.field("conv_id").type, long, string, long, string, long]
            done = []
            for conv_id, start, chunk, low, high in zip(
                *(batch.column(c).to_pylist() for c in fields), strict=True
            ):
                if turns is None or conv_id != conv:
                    if turns:
                        done.append((conv, count, turns.hexdigest(), masked, loss.hexdigest(), length))
                    conv, count, masked, length = conv_id, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in _TURN.findall(chunk):
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    count += 1
                if low is not None:
                    own = unescape(chunk[low - start : high - start])
                    loss.update(own.encode())
                    masked += len(own)
                length += len(chunk)
            if done:
                yield _batch(done, names, kinds)
        if turns:
            last = (conv, count, turns.hexdigest(), masked, loss.hexdigest(), length)
            yield _batch([last], names, kinds)

    return (
        rendered.repartition("conv_id")
        .sortWithinPartitions("conv_id", "part")
        .mapInArrow(run, DIGEST.format(kind=kind))
    )
