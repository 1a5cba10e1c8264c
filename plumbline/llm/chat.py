"""Chat formatting by a finite-state machine over roles.

A template declares how each role's turn is written, which parts count for the loss, and which role may follow which.
The machine runs over the turns of a conversation in order and emits text segments with a loss flag each; turns out of
order are marked, never dropped.  Control strings inside texts are escaped so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks an escaped control string or itself; no control string may hold it.
ESCAPE = "\\"
#: The form of every role that has none of its own.
OTHER = None
START = "start"
#: Turns handed on at once.
ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Field:
    """A place for the turn's ``text`` or ``role``; ``loss`` puts it under the loss mask."""

    name: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``begin`` opens a conversation; a form is control strings and fields in turn, with control strings at both ends.

    ``moves`` is the machine: state to role to next state, from :data:`START`.  ``ends`` are the states a
    conversation may end in.  Control strings have two characters at least, none begins another, and the first
    character of one stands inside none; so an escaped text can neither hold one nor make one with its neighbours.
    """

    begin: str
    forms: Mapping[str | None, tuple[str | Field, ...]]
    moves: Mapping[str, Mapping[str, str]]
    ends: tuple[str, ...]

    def __post_init__(self):
        first = [form[0] for form in self.forms.values()]
        for form in self.forms.values():
            if len(form) % 2 == 0 or any(isinstance(p, str) != (i % 2 == 0) for i, p in enumerate(form)):
                raise ValueError("a form is control strings and fields in turn")
        if OTHER not in self.forms or not any(isinstance(p, Field) and p.name == "role" for p in self.forms[OTHER]):
            raise ValueError("the form of other roles must write the role")
        if len({*first, self.begin}) < len(first) + 1:
            raise ValueError("forms must open with different control strings")
        heads = {c[0] for c in self.controls}
        for c in self.controls:
            if len(c) < 2 or ESCAPE in c or heads & set(c[1:]) or any(o != c and o.startswith(c) for o in self.controls):
                raise ValueError(f"unfit control string {c!r}")

    @cached_property
    def controls(self) -> list[str]:
        return sorted({self.begin, *(p for form in self.forms.values() for p in form if isinstance(p, str))})

    @cached_property
    def _to_escape(self) -> re.Pattern:
        each = [f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls]
        return re.compile("|".join([re.escape(ESCAPE), *each]))

    @cached_property
    def _tokens(self) -> re.Pattern:
        return re.compile("(" + "|".join(map(re.escape, self.controls)) + ")")

    def escape(self, text: str) -> str:
        return self._to_escape.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0]}{ESCAPE}.", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn and whether the turn was in order; a refused turn of a known role still sets the state."""
        allowed = self.moves.get(state, {}).get(role)
        if allowed is not None:
            return allowed, True
        return (role if role in self.moves else state), False

    def segments(self, role: str, text: str, opening: bool) -> list[tuple[str, bool]]:
        made = [(self.begin, False)] if opening else []
        values = {"role": role, "text": text}
        for piece in self.forms.get(role or OTHER, self.forms[OTHER]):
            made.append((piece, False) if isinstance(piece, str) else (self.escape(values[piece.name]), piece.loss))
        return made

    def read(self, text: str) -> Iterator[tuple[str, str]]:
        """The turns (role, text) of formatted text; raises ValueError where the template could not have written it."""
        by_first = {form[0]: (role, form) for role, form in self.forms.items()}
        tokens = self._tokens.split(text)  # plain, control, plain, control, ...
        at = 1
        while at < len(tokens):
            if tokens[at - 1]:
                raise ValueError("text outside a turn")
            if tokens[at] == self.begin:
                at += 2
                continue
            role, form = by_first.get(tokens[at], (None, ()))
            pieces = tokens[at : at + len(form)]
            if not form or [p for p in pieces[::2]] != list(form[::2]):
                raise ValueError("broken turn")
            values = {f.name: self.unescape(v) for f, v in zip(form[1::2], pieces[1::2], strict=True)}
            yield (values.get("role", "") if role is OTHER else role), values.get("text", "")
            at += len(form) + 1
        if tokens[-1]:
            raise ValueError("text outside a turn")


#: Fixed values of the default template.
DEFAULT = Template(
    begin="<s>",
    forms={
        "system": ("[SYS]", Field("text"), "[/SYS]"),
        "user": ("[INST]", Field("text"), "[/INST]"),
        "assistant": ("[OUT]", Field("text", loss=True), "</s>"),
        OTHER: ("[ROLE]", Field("role"), "[SAYS]", Field("text"), "[/ROLE]"),
    },
    moves={
        START: {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    ends=("assistant",),
)

FORMATTED = "position long, state string, in_order boolean, segments array<struct<text: string, loss: boolean>>"


def format_conversations(
    conversations: DataFrame,
    template: Template = DEFAULT,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row a turn: ``conv_id``, ``position`` (from 0), ``state`` after it, ``in_order``, ``segments`` (text, loss).

    Rows of a conversation come out together and in order.  Turns are ordered by ``turn`` (null first), equal turns by
    role and text; a repeated row is a turn of its own.  Null roles and texts are empty; roles without a form are
    written with their name and are never in order; rows without an id are one conversation.  An empty table gives no
    rows; other columns are left behind, whatever their names.

    One shuffle by conversation; tasks stream their sorted rows through the machine, so a conversation of any length
    takes the memory of one batch.
    """
    named = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    kind = named.schema["conv_id"].dataType.simpleString()
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    segment = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unset = object()
        current, state, position = unset, START, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids, roles, texts = (part.column(i).to_pylist() for i in range(3))
                positions, states, orders, segments = [], [], [], []
                for key, who, said in zip(ids, roles, texts, strict=True):
                    if key != current:
                        current, state, position = key, START, 0
                    state, allowed = template.step(state, who)
                    made = template.segments(who, said, position == 0)
                    segments.append([{"text": t, "loss": loss} for t, loss in made])
                    positions.append(position)
                    states.append(state)
                    orders.append(allowed)
                    position += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(positions, pa.int64()), pa.array(states, pa.string()), pa.array(orders, pa.bool_()), pa.array(segments, segment)],
                    names=["conv_id", "position", "state", "in_order", "segments"],
                )

    return dealt.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def read_back(formatted: DataFrame, template: Template = DEFAULT, *, shuffle: bool = True) -> DataFrame:
    """What each conversation says, read from its segments alone.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (of role, newline, text, newline a turn), ``loss_chars`` and
    ``loss_sha256`` (text under the loss mask, unescaped), ``formatted_chars``, ``n_refused`` (turns out of order),
    ``complete`` (ends where the template allows).  ``shuffle=False`` takes rows as :func:`format_conversations`
    yields them, together and in order, without another shuffle.  Text that the template cannot have written raises.
    """
    if shuffle:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    formatted = formatted.select("conv_id", "state", "in_order", "segments")
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_refused", "complete"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unset = object()
        current, held = unset, None
        done: list[tuple] = []

        def flush(id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(names)
            made = [pa.array(c, k) for c, k in zip(columns, [id_type, *kinds], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        def finish() -> None:
            if held is not None:
                turns, loss = held["turns"].hexdigest(), held["loss"].hexdigest()
                ends = held["state"] in template.ends
                done.append((current, held["n"], turns, held["loss_chars"], loss, held["chars"], held["refused"], ends))

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                for row in part.to_pylist():
                    if row["conv_id"] != current:
                        finish()
                        current = row["conv_id"]
                        held = dict.fromkeys(("n", "loss_chars", "chars", "refused"), 0)
                        held |= {"turns": hashlib.sha256(), "loss": hashlib.sha256()}
                    written = "".join(s["text"] for s in row["segments"])
                    for who, said in template.read(written):
                        held["n"] += 1
                        held["turns"].update(f"{who}\n{said}\n".encode())
                    for segment in row["segments"]:
                        if segment["loss"]:
                            plain = template.unescape(segment["text"])
                            held["loss_chars"] += len(plain)
                            held["loss"].update(plain.encode())
                    held["chars"] += len(written)
                    held["refused"] += not row["in_order"]
                    held["state"] = row["state"]
                if len(done) >= ROWS_AT_ONCE:
                    yield flush(id_type)
        finish()
        if done:
            yield flush(id_type)

    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "n_refused long, complete boolean"
    )
    return formatted.mapInArrow(run, schema)
