"""Conversations as training text: a finite-state machine over roles, and segments with loss flags from a template.

A ``Template`` declares for each role the segments of a turn: literals, the text, and whether it counts for the loss. Its
machine says which role may follow; a conversation is valid if every move is allowed and it ends in an accepting state. Turns that are out of
order are formatted all the same and marked, none is dropped. Roles that the template does not know are written out.

Control strings (the bracketed marks of the literals) are escaped inside texts and roles: a backslash goes behind the first
character, and one more where backslashes already stand there. No escaped text holds a control string, and unescaping
takes one backslash away, so any text comes back.

Rows are dealt by ranges of (conversation, turn), so that a conversation with a third of all rows spreads over a third of the
tasks. A task writes *blocks*: up to ``BLOCK_CHARS`` of formatted text (one longer turn is a block of its own), the spans of its
segments with their flags, and what the block does to *every* state of the machine. These functions are joined
in order, so no task needs the turns before its own. ``read_back`` parses the blocks alone. Conversations that lie in one block are
digested where they are; blocks of the others meet per conversation and stream through the digests, one block in
memory at a time (a digest over a whole conversation is sequential by definition).

Null texts, roles and conversation ids: an empty text, an empty role, one conversation with null id. Turns sort by turn (nulls
first), then role, then text; repeated rows are turns each. An empty table gives no rows. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 20
#: Characters of a text that take part in finding range bounds; the order inside a task uses all of it.
BOUND_CHARS = 64
_MARK = re.compile(r"<[^<>\[\]\s\\]+>|\[[^<>\[\]\s\\]+\]")


@dataclass(frozen=True)
class Part:
    """A piece of a turn that comes from its row: ``text`` or ``role``."""

    source: str
    loss: bool = False


TEXT, LEARNT, ROLE = Part("text"), Part("text", loss=True), Part("role")
START = "start"


@dataclass(frozen=True)
class Template:
    """Segments of a turn by role, segments for any other role, allowed moves and accepting states.

    Literals and parts alternate; the first literal starts with a control string that no other role starts with, and every
    later literal holds one, so that the formatted text can be parsed.
    """

    turns: dict[str, tuple[str | Part, ...]]
    other: tuple[str | Part, ...]
    moves: dict[str, dict[str, str]]
    accepting: frozenset[str]
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        shapes = [*self.turns.values(), self.other]
        for shape in shapes:
            kinds = [isinstance(s, Part) for s in shape]
            if len(shape) % 2 == 0 or kinds != [i % 2 == 1 for i in range(len(shape))]:
                raise ValueError("literals and parts must alternate, with literals at both ends")
            if not _MARK.match(shape[0]) or not all(_MARK.search(s) for s in shape[2::2]):
                raise ValueError("every literal must hold a control string, the first at its start")
        if len({_MARK.match(s[0])[0] for s in shapes}) < len(shapes):
            raise ValueError("turns must start with different control strings")
        # The last state takes every move that is not allowed, and is never left.
        object.__setattr__(self, "states", (START, *sorted(set(self.moves) - {START}), ""))

    @property
    def controls(self) -> list[str]:
        return sorted({m for shape in [*self.turns.values(), self.other] for s in shape[::2] for m in _MARK.findall(s)})

    def escapes(self) -> tuple[re.Pattern, re.Pattern]:
        """Places behind which a backslash goes, and backslashes to take away."""
        tails: dict[str, list[str]] = {}
        for c in self.controls:
            tails.setdefault(c[0], []).append(re.escape(c[1:]))
        one = [(re.escape(c), rf"(?=\\*(?:{'|'.join(t)}))") for c, t in sorted(tails.items())]
        return re.compile("|".join(c + t for c, t in one)), re.compile("|".join(rf"(?<={c})\\{t}" for c, t in one))

    def table(self) -> dict[str, list[int]]:
        """For each role the next state of every state; a role without an entry leads to the last."""
        number = {s: i for i, s in enumerate(self.states)}
        roles = {r for m in self.moves.values() for r in m}
        return {r: [number[self.moves.get(s, {}).get(r, "")] for s in self.states] for r in roles}


INSTRUCT = Template(
    turns={
        "system": ("[SYS] ", TEXT, " [/SYS]\n"),
        "user": ("[INST] ", TEXT, " [/INST]\n"),
        "assistant": ("<s> ", LEARNT, " </s>\n"),
    },
    other=("[ROLE] ", ROLE, " [/ROLE] ", TEXT, " </s>\n"),
    moves={
        START: {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    accepting=frozenset({"answered"}),
)

_SEGMENT = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("loss", pa.bool_())])
_BLOCK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), ("text", pa.string()),
    ("segments", pa.list_(_SEGMENT)), ("ends", pa.list_(pa.int32())), ("faults", pa.list_(pa.int64())),
])
BLOCK_SCHEMA = (
    "conv_id long, part int, block int, whole boolean, text string, "
    "segments array<struct<begin:int,end:int,loss:boolean>>, ends array<int>, faults array<long>"
)
READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "valid boolean, fault_turn long"
)


class _Block:
    """Text, segments and state function of consecutive turns of one conversation."""

    def __init__(self, template: Template, conv_id: int | None, part: int, number: int):
        self.conv_id, self.part, self.number = conv_id, part, number
        self.texts: list[str] = []
        self.segments: list[tuple[int, int, bool]] = []
        self.size = self.turns = 0
        self.ends = list(range(len(template.states)))
        self.faults: list[int | None] = [None] * len(template.states)

    def put(self, piece: str, loss: bool) -> None:
        if piece:
            self.segments.append((self.size, self.size + len(piece), loss))
            self.texts.append(piece)
            self.size += len(piece)

    def move(self, step: list[int]) -> None:
        """One turn of every start state; ``faults`` counts from the block's first turn."""
        last = len(step) - 1
        for s, at in enumerate(self.ends):
            self.ends[s] = step[at]
            if step[at] == last and self.faults[s] is None and s != last:
                self.faults[s] = self.turns
        self.turns += 1

    def row(self, whole: bool) -> tuple:
        return self.conv_id, self.part, self.number, whole, "".join(self.texts), self.segments, self.ends, self.faults


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    segments = [{"begin": b, "end": e, "loss": x} for s in columns[5] for b, e, x in s]
    offsets = [0]
    for s in columns[5]:
        offsets.append(offsets[-1] + len(s))
    nested = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(segments, _SEGMENT))
    arrays = [nested if f.name == "segments" else pa.array(list(c), f.type) for f, c in zip(_BLOCK, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_BLOCK)


def format_conversations(
    df: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Blocks of formatted text: ``conv_id, part, block`` (their order), ``whole`` (the conversation's only block),
    ``text``, ``segments`` (code points, with loss flags), and per state where the block leads and its first bad turn."""
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, BOUND_CHARS))
    ordered = ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape, table, never = template.escapes()[0], template.table(), [len(template.states) - 1] * len(template.states)
        part = TaskContext.get().partitionId()
        now: _Block | None = None
        first, out, held = True, [], 0  # the first and the last conversation of a task may go on in another
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None:
                    now = _Block(template, conv_id, part, 0)
                elif now.conv_id != conv_id or now.size >= block_chars:
                    other = now.conv_id != conv_id
                    out.append(now.row(other and not first and now.number == 0))
                    held += now.size
                    first = first and not other
                    now = _Block(template, conv_id, part, 0 if other else now.number + 1)
                    if held >= block_chars:
                        yield _batch(out)
                        out, held = [], 0
                for s in template.turns.get(role, template.other):
                    if isinstance(s, Part):
                        now.put(escape.sub(r"\g<0>\\", text if s.source == "text" else role), s.loss)
                    else:
                        now.put(s, False)
                now.move(table.get(role, never))
        if now is not None:
            yield _batch([*out, now.row(False)])

    return ordered.mapInArrow(write, BLOCK_SCHEMA)


class _Reader:
    """Digests of one conversation from its blocks in order."""

    def __init__(self, template: Template):
        self.template, self.unescape = template, template.escapes()[1]
        self.shapes = [(r, s) for r, s in template.turns.items()] + [(None, template.other)]
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.state = 0
        self.fault: int | None = None

    def parse(self, text: str) -> Iterator[tuple[str, str]]:
        """Role and text of every turn, from the formatted text alone."""
        at = 0
        while at < len(text):
            role, shape = next((r, s) for r, s in self.shapes if text.startswith(s[0], at))
            at += len(shape[0])
            got = {"role": role}
            for part, literal in zip(shape[1::2], shape[2::2], strict=True):
                end = text.index(literal, at)
                got[part.source] = self.unescape.sub("", text[at:end])
                at = end + len(literal)
            yield got["role"], got["text"]

    def feed(self, text: str, segments: list[dict], ends: list[int], faults: list[int | None]) -> None:
        before = self.n_turns
        for role, said in self.parse(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for s in segments:
            if s["loss"]:
                learnt = self.unescape.sub("", text[s["begin"]:s["end"]])
                self.loss.update(learnt.encode())
                self.loss_chars += len(learnt)
        self.chars += len(text)
        if self.fault is None and faults[self.state] is not None:
            self.fault = before + faults[self.state]
        self.state = ends[self.state]

    def row(self, conv_id: int | None) -> dict:
        ended = self.template.states[self.state] in self.template.accepting
        fault = self.fault if ended or self.fault is not None else self.n_turns
        return {
            "conv_id": conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "valid": ended, "fault_turn": fault,
        }


def read_back(blocks: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation what its blocks say: turns, text under the loss mask, length, validity.

    ``fault_turn`` is the place (from 0) of the first turn that may not stand there, the number of turns where only an end is missing.
    """
    done = [f.name for f in blocks.sparkSession.createDataFrame([], READ_SCHEMA).schema]
    empty = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                       ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("fault_turn", pa.int64())])
    rest = [f for f in _BLOCK if f.name not in ("conv_id", "whole")]
    both = pa.schema([*empty, *rest])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations of one block become digests, other blocks go on as they are."""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r.pop("whole"):
                    reader = _Reader(template)
                    reader.feed(r["text"], r["segments"], r["ends"], r["faults"])
                    r = reader.row(r["conv_id"])
                rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, schema=both)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if reader is not None and (r["text"] is None or r["conv_id"] != conv):
                    rows.append(reader.row(conv))
                    reader = None
                if r["text"] is None:
                    rows.append({k: r[k] for k in done})
                    continue
                if reader is None:
                    reader, conv = _Reader(template), r["conv_id"]
                reader.feed(r["text"], r["segments"], r["ends"], r["faults"])
            yield pa.RecordBatch.from_pylist(rows, schema=empty)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row(conv)], schema=empty)

    spread = ", ".join(f"{name} {kind}" for name, kind in (f.split(" ") for f in READ_SCHEMA.split(", ")))
    carried = ", ".join(f for f in BLOCK_SCHEMA.split(", ") if f.split(" ")[0] not in ("conv_id", "whole"))
    partly = blocks.mapInArrow(here, f"{spread}, {carried}")
    return partly.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(join, READ_SCHEMA)
