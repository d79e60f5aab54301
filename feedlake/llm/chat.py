r"""Chat formatting by a declarative template and a finite-state machine.

The rows of a conversation meet in one sorted run and stream through the
machine, a row at a time: memory holds one turn, also for a conversation that
has a third of all rows. Each turn becomes one output row of segments (text,
loss flag); the formatted conversation is the segments of its rows in order.

The machine's states are roles; the template lists which may follow which and
which may end a conversation. Invalid turns are formatted like others and
marked: ``valid_so_far`` per row.

Control strings inside texts are escaped by a backslash before them, and
backslashes by another; ``unescape`` is the exact inverse. Role names other
than lower-case letters are percent-encoded.

Defined cases: NULL text is empty; NULL role is an empty name (always
invalid); NULL conv_id is a conversation of its own; turns that tie are
ordered by role, then text; repeated rows are turns of their own; a text of any
length is one turn, formatted whole; extra columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import slices


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles whose texts are learned, and the machine."""

    head: str = "### {role}:\n"
    tail: str = "</turn>\n"
    control: tuple[str, ...] = ("\\", "###", "</turn>")
    loss_roles: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.control)), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(" + "|".join(map(re.escape, self.control)) + ")", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.head.format(role=quote(role, safe="")), False), (self.escape(text), role in self.loss_roles),
                (self.tail, False)]

    def parse(self, turn: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        before, after = self.head.split("{role}")
        if not turn.startswith(before) or not turn.endswith(self.tail):
            raise ValueError("not a formatted turn")
        role, _, body = turn[len(before):-len(self.tail)].partition(after)
        return unquote(role), self.unescape(body)


TEMPLATE = Template()
_SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def _changes(ids: list, last) -> Iterator[tuple[int, bool]]:
    for i, x in enumerate(ids):
        yield i, last is None or x != last[0]
        last = (x,)


def format_turns(conversations: DataFrame, template: Template = TEMPLATE, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in order within its conversation: conv, seq (from 0),
    segments and valid_so_far. The partitioning by conv and the order are kept
    for readers."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"),
                                F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    placed = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, valid, seq = None, "", True, 0
        for batch in slices(batches):
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            seqs, parts, oks = [], [], []
            for i, new in _changes(ids, last):
                if new:
                    state, valid, seq = "", True, 0
                valid = valid and roles[i] in template.follows.get(state, ())
                state, last = roles[i], (ids[i],)
                seqs.append(seq)
                parts.append([{"text": t, "loss": loss} for t, loss in template.segments(roles[i], texts[i])])
                oks.append(valid)
                seq += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.int64()), pa.array(parts, pa.list_(_SEGMENT)),
                                              pa.array(oks, pa.bool_())], names=["conv", "seq", "segments", "valid_so_far"])

    kind = rows.schema["conv"].dataType.simpleString()
    return placed.mapInArrow(run, f"conv {kind}, seq long, segments array<struct<text:string,loss:boolean>>, valid_so_far boolean")


class _Digest:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.chars, self.loss, self.valid, self.role = conv, 0, 0, 0, True, ""
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, segments: list[dict], valid: bool, template: Template) -> None:
        whole = "".join(s["text"] for s in segments)
        self.role, text = template.parse(whole)
        learned = template.unescape("".join(s["text"] for s in segments if s["loss"]))
        self.all.update(f"{self.role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.learned.update(learned.encode("utf-8", "surrogatepass"))
        self.turns, self.chars, self.loss, self.valid = self.turns + 1, self.chars + len(whole), self.loss + len(learned), valid

    def row(self, template: Template) -> tuple:
        return (self.conv, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars,
                self.valid and self.role in template.ends)


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, parsed from the segments of ``format_turns``: conv,
    n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    kinds = [formatted.schema["conv"].dataType.simpleString(), "long", "string", "long", "string", "long", "boolean"]
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), schema)], names=names)

        for batch in slices(batches):
            schema = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            done, ids, parts, oks = [], batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, new in _changes(ids, None if now is None else (now.conv,)):
                if new:
                    if now is not None:
                        done.append(now.row(template))
                    now = _Digest(ids[i])
                now.add(parts[i], oks[i], template)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.row(template)])

    return formatted.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
