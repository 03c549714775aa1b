"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A template lists the segments of a turn (control strings, the role, the text) and the roles whose text the
loss counts; an order lists which role may follow which.  Texts and roles are escaped reversibly, so a control
string inside them never looks like one of the template's.  Conversations are streamed in order through their
task: what it holds is one chunk of formatted text, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions

#: Code points of formatted text in a row; a conversation that needs more takes several rows.
CHUNK_CHARS = 1 << 22
START, ROLE, TEXT = "start", "{role}", "{text}"


@dataclass(frozen=True)
class Template:
    """Segments of one turn in order; control strings begin with ``<|`` and the role ends at a line break."""

    segments: tuple[str, ...] = ("<|im_start|>", ROLE, "\n", TEXT, "<|im_end|>\n")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state -> role that may come next -> state after it
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {START: {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: frozenset[str] = frozenset({"assistant"})


CHATML = Template()

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""One more backslash between ``<`` and ``|`` wherever only backslashes stand between them."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    r"""A role on one line: backslash and line break as ``\\`` and ``\n``, then as texts."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return "\\".join(part.replace("\\n", "\n") for part in unescape(role).split("\\\\"))


class Machine:
    """Walks the roles of one conversation; ``fault`` is the first turn out of order."""

    def __init__(self, template: Template) -> None:
        self.template, self.state, self.turns, self.fault = template, START, 0, None

    def step(self, role: str) -> None:
        after = self.template.order.get(self.state, {}).get(role) if self.fault is None else None
        if after is None and self.fault is None:
            self.fault = self.turns
        self.state = after or self.state
        self.turns += 1

    @property
    def valid(self) -> bool:
        return self.fault is None and self.state in self.template.final


def turn_segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(formatted text, loss flag) of each segment of a turn."""
    filled = {ROLE: escape_role, TEXT: escape}
    given = {ROLE: role, TEXT: text}
    return [(filled[s](given[s]), s == TEXT and role in template.loss_roles) if s in filled else (s, False) for s in template.segments]


_OUT = "conv_id long, chunk long, last boolean, text string, starts array<int>, loss array<boolean>, n_turns long, valid boolean, fault long"


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Formatted conversations: text, the start of each segment in it and the segment's loss flag.

    A conversation's rows are ordered by turn (nulls first), then role and text; null roles and texts are empty;
    rows without a conv_id form one conversation, whose conv_id stays null.  Rows that break the order are
    formatted like any other: ``valid`` and ``fault`` (the first such turn, from 0) say so on the last row.
    A conversation of more than ``CHUNK_CHARS`` takes several rows (``chunk``, ``last``), cut between segments,
    which follow one another in their partition.  Repeated rows are turns of their own; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = conversations.sparkSession
    bounded_batches(spark)
    schema = to_arrow_schema(_parse_datatype_string(_OUT))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    ordered = turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {f.name: [] for f in schema}
        conv, machine, chunk, parts, starts, flags, size, held = None, None, 0, [], [], [], 0, 0

        def close(last: bool) -> None:
            row = (conv, chunk, last, "".join(parts), list(starts), list(flags), machine.turns, machine.valid if last else None, machine.fault if last else None)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for v in out.values():
                v.clear()
            return got

        for batch in batches:
            for c, role, said in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text")], strict=True):
                if machine is None or c != conv:
                    if machine is not None:
                        close(True)
                        held += size
                    conv, machine, chunk, parts, starts, flags, size = c, Machine(template), 0, [], [], [], 0
                machine.step(role)
                for piece, loss in turn_segments(role, said, template):
                    if size and size + len(piece) > CHUNK_CHARS:
                        close(False)
                        held += size
                        chunk, parts, starts, flags, size = chunk + 1, [], [], [], 0
                    parts.append(piece)
                    starts.append(size)
                    flags.append(loss)
                    size += len(piece)
                if held > CHUNK_CHARS:
                    yield flush()
                    held = 0
        if machine is not None:
            close(True)
        yield flush()

    return ordered.select("conv_id", "role", "text").mapInArrow(run, _OUT)


class Reader:
    """Reads one formatted conversation back from its chunks: turns by the marks, loss text by the mask.

    What is held is the unfinished turn, so memory is bounded by the longest text.
    """

    def __init__(self, template: Template) -> None:
        t = template.segments
        role, text = t.index(ROLE), t.index(TEXT)
        between = re.escape("".join(t[role + 1 : text]))
        self.turn = re.compile(re.escape("".join(t[:role])) + "(.*?)" + between + "(.*?)" + re.escape("".join(t[text + 1 :])), re.S)
        self.closing = "".join(t[text + 1 :])
        self.rest, self.n_turns, self.n_chars, self.n_loss = "", 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.scanned = 0

    def feed(self, text: str, starts: list[int], loss: list[bool]) -> None:
        self.n_chars += len(text)
        for k, (at, counts) in enumerate(zip(starts, loss, strict=True)):
            if counts:
                said = unescape(text[at : starts[k + 1] if k + 1 < len(starts) else len(text)])
                self.n_loss += len(said)
                self.loss.update(said.encode())
        self.rest += text
        at = 0
        while m := self.turn.match(self.rest, at):
            self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
            self.n_turns += 1
            at = m.end()
        self.rest = self.rest[at:]

    def result(self) -> tuple:
        if self.rest:
            raise ValueError("formatted text ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.n_chars


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of what formatted conversations hold, read back from their text, starts and flags alone.

    The chunks of a conversation must follow one another in a partition, as ``format_chats`` gives them; of rows read
    from files, ``repartition("conv_id").sortWithinPartitions("conv_id", "chunk")`` restores that.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(formatted.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(_READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for c, last, text, starts, loss, valid in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "last", "text", "starts", "loss", "valid")], strict=True):
                reader = reader or Reader(template)
                reader.feed(text, starts, loss)
                if last:
                    done.append((c, *reader.result(), valid))
                    reader = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
        if reader is not None:
            raise ValueError("a conversation has no last chunk in its partition")

    return formatted.select("conv_id", "last", "text", "starts", "loss", "valid").mapInArrow(run, _READ)
