"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are brought together sorted by turn and stream through the machine: it checks
the turn order and emits text segments with a loss flag each. Conversations are never held whole;
memory is bounded by one Arrow batch, so a conversation of any number of turns works.

``read_back`` parses the formatted segments again: it finds the turns by the template's control
strings and unescapes the texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelspark.llm.store import arrow_rows


@dataclass(frozen=True)
class Template:
    """Control strings per role as (open, close), the roles that are learned, and allowed role changes.

    Roles without an entry are written as ``other[0] role other[1] text other[2]``. A transition
    lists the roles that may follow a state; the state after a turn is its role.
    """

    turns: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("<s>", "</s>"),
    })
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })

    def controls(self) -> list[str]:
        return [c for pair in self.turns.values() for c in pair] + list(self.other)


class Codec:
    """Escaping of control strings inside texts.

    A control string with k >= 0 backslashes after its first character gets one more, so no control
    string remains in a text; reading takes one away again.
    """

    def __init__(self, template: Template):
        self.template = template
        heads: dict[str, list[str]] = {}
        for control in sorted(template.controls(), key=len, reverse=True):
            heads.setdefault(control[0], []).append(re.escape(control[1:]))
        rests = {h: "|".join(r) for h, r in heads.items()}
        self._escape = [(re.compile(re.escape(h) + r"(\\*)(?=" + r + ")"), h) for h, r in rests.items()]
        self._unescape = [(re.compile(re.escape(h) + r"\\(\\*)(?=" + r + ")"), h) for h, r in rests.items()]
        self.control = re.compile("|".join(re.escape(c) for c in sorted(template.controls(), key=len, reverse=True)))

    def escape(self, text: str) -> str:
        for pattern, head in self._escape:
            text = pattern.sub(lambda m, h=head: f"{h}\\{m[1]}", text)
        return text

    def unescape(self, text: str) -> str:
        for pattern, head in self._unescape:
            text = pattern.sub(lambda m, h=head: f"{h}{m[1]}", text)
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss flag) pieces of one turn."""
        body = (self.escape(text), role in self.template.learned)
        if role in self.template.turns:
            opened, closed = self.template.turns[role]
            return [(opened, False), body, (closed, False)]
        first, second, closed = self.template.other
        return [(first + self.escape(role) + second, False), body, (closed, False)]


SEGMENTS = "conv_id long, turn long, piece int, role string, segment string, loss boolean, in_order boolean"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of ``turns(conv_id, turn, role, text)``: one row per piece of a turn, in order.

    Null texts and roles are empty strings. Turns that are equal in (conv_id, turn) are ordered by
    role and text; repeated rows are turns of their own. Rows with a null conv_id form one
    conversation; null turns come first. ``in_order`` tells whether the state machine allowed the
    turn; turns out of order are flagged and still written. An empty table gives no segments. Rows
    of a conversation lie together, in order, inside their partition. Other columns are ignored.
    """
    arrow_rows(turns.sparkSession)
    chosen = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, state, place = Codec(chosen), object(), chosen.start, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                role, text = role or "", text or ""
                if conv != current:
                    current, state, place = conv, chosen.start, 0
                allowed = role in chosen.follows.get(state, ())
                state = role
                for piece, loss in codec.segments(role, text):
                    out.append((conv, turn, place, role, piece, loss, allowed))
                    place += 1
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=["conv_id", "turn", "piece", "role", "segment", "loss", "in_order"])

    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                            F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(run, SEGMENTS)


class _Reader:
    """Digests of one conversation, read from its formatted text piece by piece."""

    def __init__(self, conv: int | None, codec: Codec):
        self.conv, self.codec, self.template = conv, codec, codec.template
        self.opens = {o: (role, c) for role, (o, c) in self.template.turns.items()}
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid = True
        self.closing: str | None = None      # control string that ends the text being read
        self.role, self.body, self.in_role = "", "", False

    def feed(self, segment: str, loss: bool, in_order: bool) -> None:
        self.chars += len(segment)
        self.valid &= in_order
        if loss:
            learned = self.codec.unescape(segment)
            self.loss_chars += len(learned)
            self.learned.update(learned.encode("utf-8", "surrogatepass"))
        at = 0
        for found in self.codec.control.finditer(segment):
            self.body += segment[at:found.start()]
            at = found.end()
            self.token(found[0])
        self.body += segment[at:]

    def token(self, control: str) -> None:
        first, second, closed = self.template.other
        if control == self.closing:
            text = self.codec.unescape(self.body)
            self.turns.update(f"{self.role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            self.closing, self.body = None, ""
        elif control in self.opens and self.closing is None:
            self.role, self.closing = self.opens[control]
            self.body = ""
        elif control == first and self.closing is None:
            self.in_role, self.body = True, ""
        elif control == second and self.in_role:
            self.role, self.in_role, self.closing, self.body = self.codec.unescape(self.body), False, closed, ""
        else:
            raise ValueError(f"unexpected control string {control!r} in conversation {self.conv}")

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars,
                self.valid)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, from the formatted text: turns found and the digest of their roles and texts,
    size and digest of the learned text, formatted size, and whether the turn order is valid.

    ``segments`` must hold each conversation in order inside one partition, as
    ``format_conversations`` returns it.
    """
    chosen = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reader = Codec(chosen), None
        for batch in batches:
            done: list[tuple] = []
            for conv, segment, loss, in_order in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "in_order"))):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv, codec)
                reader.feed(segment, loss, in_order)
            yield _read_rows(done)
        yield _read_rows([reader.row()] if reader is not None else [])

    return segments.mapInArrow(run, READ)


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                             "formatted_chars", "valid"])
