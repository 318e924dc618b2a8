"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

``segments`` runs the machine over each conversation's turns.  Every step moves
it from its state by the turn's role and emits the turn's three text segments
(opening mark, text, closing mark), each with a loss flag and the state reached;
control strings inside texts are escaped reversibly.  A role that the state does
not allow moves the machine to no state, in which it stays: the text is still
emitted, so nothing is lost, and the conversation is invalid.  ``read_back``
parses segments again, runs the machine over what it reads, and digests the
turns.

Rows of a conversation stream through one sorted partition with constant state,
so a very long conversation is never held in memory; since a digest needs its
turns in order, it is the work of one task.

Defined results: a null or absent text counts as empty; a null role as the empty
role (an order error); rows that tie on (conv_id, turn) go by role, then text;
repeated rows are turns like any other; a null conv_id is one conversation with
id null; a conv_id of any type keeps it; an empty table gives an empty result;
other columns are ignored.  The template's marks must start with ``<|``, which
no escaped text holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and which roles' texts carry loss.  Marks start with ``<|``."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; "" is the start.  Ends are valid in final states only.
    machine: dict = field(default_factory=lambda: {"": {"system": "s", "user": "u"}, "s": {"user": "u"}, "u": {"assistant": "a"}, "a": {"user": "u"}})
    final: tuple[str, ...] = ("a", "u", "s")

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("marks must start with <|: only that is escaped in texts")

    def step(self, state: str | None, role: str) -> str | None:
        """The state after a turn of this role, or None if it may not come here."""
        return self.machine.get(state, {}).get(role)


CHATML = Template()


def escaped(text: str) -> str:
    """``<|`` with k backslashes between becomes k + 1: no control string is left, and ``unescaped`` inverts it."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def segments(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, turn, role, seq, text, loss, state): a conversation's formatted text is its texts in order of seq; state is null from an order error on."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    fields = [*rows.schema.fields[:3], T.StructField("seq", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType()), T.StructField("state", T.StringType())]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, begun = None, "", 0, False
        for batch, texts in slices(batches, "text"):
            out: list[tuple] = []
            for conv, role_, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts):
                if not begun or conv != now:
                    now, state, n, begun = conv, "", 0, True
                state = template.step(state, role_)
                for part, loss in ((template.start + escaped(role_) + template.after_role, False), (escaped(raw.decode("utf-8", "replace")), role_ in template.loss_roles), (template.end, False)):
                    out.append((n, part, loss, state))
                    n += 1
            take = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), 3)))
            yield pa.RecordBatch.from_arrays([*take.columns[:3], *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.bool_(), pa.string())))], names=[f.name for f in fields])

    small_batches(turns.sparkSession)
    return rows.mapInArrow(kernel, T.StructType(fields))


READ = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


class _Reader:
    """Parses the formatted text of one conversation piece by piece."""

    def __init__(self, conv, template: Template):
        self.conv, self.t = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.role, self.state, self.ok = None, "", True

    def take(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if self.role is None and text.startswith(self.t.start):
            self.role = unescaped(text[len(self.t.start) : len(text) - len(self.t.after_role)])
            self.turns.update(f"{self.role}\n".encode())
            self.state = self.t.step(self.state, self.role)
            self.ok &= self.state is not None
        elif text == self.t.end:  # no escaped text can hold it
            self.turns.update(b"\n")
            self.n, self.role = self.n + 1, None
        else:
            plain = unescaped(text)
            self.turns.update(plain.encode())
            if loss:
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.ok and self.state in self.t.final


def read_back(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, read from its formatted segments; valid: the role machine accepts the turns."""
    kinds = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, schema = None, [], None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *kinds])
            for conv, text, loss in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Reader(conv, template)
                now.take(text, loss)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.select("conv_id", "text", "loss").mapInArrow(kernel, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, {READ}")


def turn_order(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, n_turns, valid) of the role machine alone."""
    return read_back(segments(turns, template), template).select("conv_id", "n_turns", "valid")
