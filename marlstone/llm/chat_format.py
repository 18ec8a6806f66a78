"""Chat formatting: conversations rendered by a compiled template, with a loss mask, and read back from the output.

A ChatFormat is a template with its control strings: what begins a turn, what ends it and what follows the end.  In
CHATML a turn is `<|im_start|>role`, a newline, the text, `<|im_end|>` and a newline; what the template puts inside
generation markers (assistant texts) carries loss.  All control strings begin with the same two characters; inside texts
and roles these are escaped: `<|` never appears in an escaped text, and one backslash more or less tells an escape from
its like in the source.

Reading back knows the output alone: the characters and which of them are under the mask.  It looks for control
strings, cuts turns and masked texts at them, and then takes the escapes back; a control string where none may be is
an error.

A conversation's rows arrive sorted and stream through the template and the reader, so that a conversation of any
length takes the memory of a turn; its digests are kept incrementally.

Defined cases: null texts and roles are empty; rows go by turn (null first), ties by role, then text; repeated rows
are turns each; very long texts are read whole; a null conv_id is a conversation of its own; an empty table has the added
conversations alone; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, sorted_groups
from marlstone.llm.templates import Template


class ChatFormat(NamedTuple):
    """A template's source, its control strings, and the two different characters that these begin with."""

    source: str
    start: str
    end: str
    after: str
    control: str

    def escape(self, text: str) -> str:
        a, b = map(re.escape, self.control)
        return re.sub(rf"{a}(\\*){b}", lambda m: f"{self.control[0]}{m[1]}\\{self.control[1]}", text)

    def unescape(self, text: str) -> str:
        a, b = map(re.escape, self.control)
        return re.sub(rf"{a}(\\*)\\{b}", lambda m: f"{self.control[0]}{m[1]}{self.control[1]}", text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def template(self) -> Template:
        return Template(self.source, {"escape": self.escape, "escape_role": self.escape_role})


CHATML = ChatFormat(
    """{%- for message in messages -%}
{{ '<|im_start|>' + (message.role | escape_role) + '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '<|im_end|>' + '\\n' }}
{%- endfor -%}""",
    "<|im_start|>",
    "<|im_end|>",
    "\n",
    "<|",
)


class Turn(NamedTuple):
    formatted: str
    role: str
    text: str
    loss: list[tuple[int, int]]  # [start, end) in formatted under the mask
    learned: str  # the masked part of the text


class Reader:
    """Turns of formatted text that comes in pieces, of which nothing is known but whether the mask covers them."""

    def __init__(self, chat: ChatFormat = CHATML):
        self.chat, self.held, self.mask = chat, "", []

    def feed(self, piece: str, masked: bool) -> Iterator[Turn]:
        chat, size = self.chat, len(self.held)
        if masked and piece:
            if self.mask and self.mask[-1][1] == size:
                self.mask[-1] = self.mask[-1][0], size + len(piece)
            else:
                self.mask.append((size, size + len(piece)))
        self.held += piece
        seen = max(0, size - len(chat.end) - len(chat.after))
        while (at := self.held.find(chat.end, seen)) >= 0 and len(self.held) >= at + len(chat.end) + len(chat.after):
            yield self._turn(at)
            seen = 0

    def _turn(self, at: int) -> Turn:
        """The turn whose end mark is at this place; it leaves the buffer."""
        chat, stop = self.chat, at + len(self.chat.end) + len(self.chat.after)
        turn, begin = self.held[:stop], len(chat.start)
        if not turn.startswith(chat.start) or not turn.endswith(chat.after) or chat.start in turn[begin:]:
            raise ValueError("a control string inside a text, or a text outside a turn")
        line = turn.find("\n", begin, at)
        line = at if line < 0 else line
        loss = [(a, min(b, stop)) for a, b in self.mask if a < stop]
        self.held, self.mask = self.held[stop:], [(max(0, a - stop), b - stop) for a, b in self.mask if b > stop]
        learned = "".join(turn[max(a, line + 1) : min(b, at)] for a, b in loss)
        return Turn(turn, chat.unescape_role(turn[begin:line]), chat.unescape(turn[line + 1 : at]), loss, chat.unescape(learned))

    def close(self) -> None:
        if self.held:
            raise ValueError("a turn without an end")


def read_pieces(pieces: Iterable[tuple[str, bool]], chat: ChatFormat = CHATML) -> Iterator[Turn]:
    """The turns of an output: its characters in pieces, each with whether the mask covers it."""
    reader = Reader(chat)
    for piece, masked in pieces:
        yield from reader.feed(piece, masked)
    reader.close()


def digest(messages: Iterable[dict], chat: ChatFormat = CHATML, template: Template | None = None) -> dict:
    """What the output of one conversation says when it is read back."""
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n = loss_chars = chars = 0
    for t in read_pieces((template or chat.template()).render(messages=messages), chat):
        turns.update(f"{t.role}\n{t.text}\n".encode())
        loss.update(t.learned.encode())
        n, loss_chars, chars = n + 1, loss_chars + len(t.learned), chars + len(t.formatted)
    return {"n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}


def _stream(conversations: DataFrame, schema: str, arrow: pa.Schema, per_conversation, chat: ChatFormat) -> DataFrame:
    """per_conversation(conv_id, messages, template) yields rows; conversations stream by conv_id in turn order."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    bounded_batches(conversations.sparkSession)

    def run(batches):
        template, out = chat.template(), []
        for (conv_id,), messages in sorted_groups(batches, ["conv_id"]):
            for row in per_conversation(conv_id, messages, template):
                out.append(row)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def format_conversations(conversations: DataFrame, chat: ChatFormat = CHATML) -> DataFrame:
    """conv_id, nth, formatted (one turn), loss (array of [start, end) in it under the loss mask): the real output."""
    arrow = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.int64()))])

    def rows(conv_id, messages, template):
        for nth, t in enumerate(read_pieces(template.render(messages=messages), chat)):
            yield {"conv_id": conv_id, "nth": nth, "formatted": t.formatted, "loss": [x for span in t.loss for x in span]}

    return _stream(conversations, "conv_id long, nth long, formatted string, loss array<long>", arrow, rows, chat)


def digest_conversations(conversations: DataFrame, chat: ChatFormat = CHATML) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for each conversation."""
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def rows(conv_id, messages, template):
        yield {"conv_id": conv_id, **digest(messages, chat, template)}

    return _stream(conversations, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", arrow, rows, chat)
