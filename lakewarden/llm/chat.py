"""Chat formatting by a finite-state machine over roles and a declarative template.

Turns of a conversation are brought into order by (turn, role, text). The
machine checks that order and every turn is emitted as text segments with a
loss flag: the marks of its role from the template, and its text, in which the
template's control strings are escaped. ``read_back`` restores the turns from
the formatted text alone. Marks open with ``[`` or ``<`` and hold neither
further on, so no control string can arise across a border.

A conversation is streamed through one sorted partition with the memory of one
turn, as its digests are sequential by definition; it is never gathered.

Defined results: null text counts as empty, null role as the empty role; roles
without a template of their own carry their name; an assistant turn that the
machine does not expect is formatted all the same and its conversation marked
invalid; null conv_id is a conversation of its own; repeated rows are repeated
turns; a very long text is held in memory as one turn; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, whole


@dataclass(frozen=True)
class Template:
    """Marks around the text of each role, whether its text is learnt, and the order of roles."""

    begin: str = "<s>"
    roles: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("", "</s>", True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    escape: str = "\\"

    def controls(self) -> list[str]:
        marks = {self.begin, *self.other, *(m for a, b, _ in self.roles.values() for m in (a, b))} - {""}
        return sorted(marks, key=lambda m: (-len(m), m))


class Formatter:
    """Segments of turns, and turns of segments."""

    def __init__(self, template: Template):
        self.template = template
        controls = "|".join(map(re.escape, template.controls()))
        esc = re.escape(template.escape)
        self._special = re.compile(f"{esc}|{controls}")
        self._escaped = re.compile(f"{esc}({esc}|{controls})")
        self._token = re.compile(f"{esc}(?:{esc}|{controls})|({controls})")
        self._openers = {a: (role, b) for role, (a, b, _) in template.roles.items() if a}
        self._bare = next((role, b) for role, (a, b, _) in template.roles.items() if not a)

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: self.template.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if role in self.template.roles:
            opening, closing, loss = self.template.roles[role]
            parts = [(opening, False), (self.escape(text), loss), (closing, False)]
        else:
            a, b, c = self.template.other
            parts = [(a, False), (self.escape(role), False), (b, False), (self.escape(text), False), (c, False)]
        return [p for p in parts if p[0] or p[1]]

    def next_state(self, state: str | None, role: str) -> str | None:
        """The state after a turn; None once the order was broken."""
        return role if state is not None and role in self.template.follows.get(state, ()) else None

    def _upto(self, text: str, at: int, mark: str) -> tuple[str, int] | None:
        for m in self._token.finditer(text, at):
            if m[1] is not None:
                if m[1] != mark:
                    raise ValueError(f"{m[1]} where {mark} was due")
                return self.unescape(text[at : m.start()]), m.end()
        return None

    def turns(self, text: str) -> tuple[list[tuple[str, str]], str]:
        """The complete turns at the front of a formatted text, and the rest."""
        out, at = [], 0
        while at < len(text):
            head = self._token.match(text, at)
            mark = head[1] if head else None
            if mark == self.template.begin:
                at = head.end()
                continue
            if mark == self.template.other[0]:
                named = self._upto(text, head.end(), self.template.other[1])
                body = named and self._upto(text, named[1], self.template.other[2])
                role = named and named[0]
            else:
                role, closing = self._openers.get(mark, self._bare)
                body = self._upto(text, head.end() if mark in self._openers else at, closing)
            if not body:
                break
            out.append((role, body[0]))
            at = body[1]
        return out, text[at:]


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), whole("text").alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments in order: conv_id, nth (from 0), text, loss, valid (no turn so far broke the order).

    The rows of a conversation are adjacent and in order within a partition.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, now, begun, state, nth = Formatter(template), None, False, "", 0
        for batch in batches:
            convs = batch.column(0).to_pylist()
            owner, texts, losses, places, valid = [], [], [], [], []
            for i, (conv, role, text) in enumerate(zip(convs, batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                parts = form.segments(role, text)
                if not begun or conv != now:
                    now, begun, state, nth = conv, True, "", 0
                    parts = [(template.begin, False), *parts]
                state = form.next_state(state, role)
                for part, loss in parts:
                    owner.append(i)
                    texts.append(part)
                    losses.append(loss)
                    places.append(nth)
                    valid.append(state is not None)
                    nth += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int64()), pa.array(texts, pa.string()), pa.array(losses, pa.bool_()), pa.array(valid, pa.bool_())],
                ["conv_id", "nth", "text", "loss", "valid"],
            )

    arrow_rows(conversations.sparkSession)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return _sorted_turns(conversations).mapInArrow(run, f"conv_id {kind}, nth bigint, text string, loss boolean, valid boolean")


def digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Read the turns back from formatted segments, as ``format_conversations`` deals them out.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = Formatter(template)
        open_, now, rest, n, chars, loss_chars, valid = False, None, "", 0, 0, 0, True
        turns, learnt = hashlib.sha256(), hashlib.sha256()

        def take() -> None:
            nonlocal rest, n
            found, rest = form.turns(rest)
            for role, text in found:
                turns.update(f"{role}\n{text}\n".encode())
                n += 1

        for batch in batches:
            done: list[tuple] = []
            kind = batch.schema.field(0).type
            for conv, text, loss, ok in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if open_ and conv != now:
                    done.append((now, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars, valid))
                if not open_ or conv != now:
                    open_, now, rest, n, chars, loss_chars, valid = True, conv, "", 0, 0, 0, True
                    turns, learnt = hashlib.sha256(), hashlib.sha256()
                rest += text
                chars += len(text)
                valid = valid and ok
                if loss:
                    plain = form.unescape(text)
                    loss_chars += len(plain)
                    learnt.update(plain.encode())
                elif text in template.controls():
                    take()
            cols = list(zip(*done)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()])], names)
        if open_:
            last = (now, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars, valid)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()])], names)

    kind = segments.schema["conv_id"].dataType.simpleString()
    return segments.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
