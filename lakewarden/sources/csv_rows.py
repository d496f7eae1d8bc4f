"""The rows of a CSV file, cut at byte ranges.

Whether a line end closes a row hangs on the quotes before it. A task finds for its
range what either beginning (within a quoted field or not) makes of it: whether it
ends within one, and how many rows begin in it. The driver adds these up, a few
numbers per range, and then each range knows its beginning and the number of its
first row. A row belongs to the range it begins in, whose task reads on to its end.

A quote opens a field only at its beginning, and a doubled one is a character; so a
range never begins at a quote but behind the last of a run of them, and the byte
before a range tells whether a field begins with it.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range, and what is read at a time beyond it.
RANGE, STEP = 8 << 20, 1 << 16
_MARK = codecs.BOM_UTF8
#: A file that is no UTF-8 is taken for this.
OTHER = "cp1252"


class Form(NamedTuple):
    """What the ranges of a file share: where its rows begin and end, and the byte that ends a row."""

    path: str
    begin: int
    size: int
    end: bytes


class Range(NamedTuple):
    start: int
    stop: int
    quoted: int
    first: int


@cache
def _patterns(end: bytes) -> tuple[re.Pattern, re.Pattern]:
    """A quoted field from its opening quote, and the rest of one from within; either ends at its quote or with the bytes."""
    rest = rb'[^"]*+(?:""[^"]*+)*+(?:"|\Z)'
    return re.compile(rb"(?<=[," + re.escape(end) + rb'])"' + rest), re.compile(rest)


def _read(form: Form, start: int, stop: int) -> bytes:
    """The bytes of a range behind the one before it; before the first row stands the end of one."""
    with open(form.path, "rb") as f:
        f.seek(max(start - 1, form.begin))
        data = f.read(max(0, min(stop, form.size) - max(start - 1, form.begin)))
    return form.end + data if start <= form.begin else data


def _edge(form: Form, at: int) -> int:
    """The first place from ``at`` on that holds no quote."""
    if at <= form.begin:
        return form.begin
    with open(form.path, "rb") as f:
        f.seek(at)
        while data := f.read(STEP):
            left = data.lstrip(b'"')
            if left:
                return at + len(data) - len(left)
            at += len(data)
    return form.size


def _ends(data: bytes, quoted: int, form: Form) -> tuple[np.ndarray, int]:
    """Places in ``data`` (as ``_read`` gives it) of line ends outside quotes, and whether it ends within quotes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == form.end[0])
    if quoted:
        ends = ends[ends > 0]
    if not quoted and b'"' not in data:
        return ends, 0
    field, rest = _patterns(form.end)
    spans, at = [], 1
    if quoted:
        spans.append(rest.match(data, 1).span())
        at = spans[0][1]
    spans += [m.span() for m in field.finditer(data, at)]
    if not spans:
        return ends, 0
    a, b = np.array(spans).T
    # A field that goes on has, behind its opening quote, an even number of quotes at the end of the bytes, or none.
    last = data[a[-1] + (len(spans) > quoted) : b[-1]]
    opened = b[-1] == len(data) and (len(last) - len(last.rstrip(b'"'))) % 2 == 0
    return ends[np.searchsorted(a, ends, "right") == np.searchsorted(b, ends, "right")], int(opened)


def _starts(data: bytes, ends: np.ndarray, length: int, form: Form) -> np.ndarray:
    """Places in ``data``, up to ``length``, where rows begin: behind line ends, where the line is not empty."""
    starts = ends[ends + 1 < min(length, len(data))] + 1
    b = np.frombuffer(data + b"\n\n", np.uint8)
    return starts[(b[starts] != form.end[0]) & ~((b[starts] == ord("\r")) & (b[starts + 1] == ord("\n")))]


def _facts(form: Form, start: int, stop: int) -> tuple[list[tuple[int, int]], bool]:
    """For either beginning: whether the range ends in quotes, and the rows begun. And whether its characters are UTF-8."""
    start, stop = _edge(form, start), _edge(form, stop)
    if start >= stop:
        return [(0, 0), (1, 0)], True
    more = _read(form, start, stop + 3)
    length = stop - start + 1
    data, out = more[:length], []
    for quoted in (0, 1):
        ends, after = _ends(data, quoted, form)
        out.append((after, len(_starts(more, ends, length, form))))
    # What continues a character belongs to the range before, which reads three bytes on.
    text = more[1:]
    skip = next((i for i, c in enumerate(text[:3]) if c & 0xC0 != 0x80), min(3, len(text))) if start > form.begin else 0
    try:
        codecs.getincrementaldecoder("utf-8")().decode(text[skip:], final=stop + 3 >= form.size)
    except UnicodeDecodeError:
        return out, False
    return out, True


def _rows_of(form: Form, r: Range) -> list[bytes]:
    """The rows that begin in a range, without their line ends."""
    start, stop = _edge(form, r.start), _edge(form, r.stop)
    if start >= stop:
        return []
    length, more = stop - start + 1, STEP
    while True:
        data = _read(form, start, stop + more)
        ends, _ = _ends(data, r.quoted, form)
        starts = _starts(data, ends, length, form)
        if not len(starts):
            return []
        closes = ends[np.searchsorted(ends, starts[0]) :]
        if stop + more >= form.size:
            closes = np.append(closes, len(data))
        at = np.searchsorted(closes, starts)
        if at[-1] < len(closes):
            return [data[a:b].removesuffix(b"\r") for a, b in zip(starts.tolist(), closes[at].tolist())]
        more *= 2


def form_of(path: str) -> Form:
    """Where the rows begin, and what ends them: the first line end outside quotes; a carriage return only where no line feed follows it."""
    size = Path(path).stat().st_size
    with open(path, "rb") as f:
        begin = len(_MARK) if f.read(len(_MARK)) == _MARK else 0
        f.seek(begin)
        data = b""
        while more := f.read(max(STEP, len(data))):
            data += more
            for end in (b"\n", b"\r"):
                form = Form(path, begin, size, end)
                ends, _ = _ends(end + data, 0, form)
                first = ends[1].item() - 1 if len(ends) > 1 else None
                if end == b"\n":
                    feed = first
                elif first is not None and (feed is None or first + 1 < feed) and first + 1 < len(data):
                    return form
            if feed is not None:
                return Form(path, begin, size, b"\n")
    return Form(path, begin, size, b"\n")


def _plan(spark: SparkSession, form: Form) -> tuple[list[Range], str]:
    """The ranges and the encoding."""
    spans = [(a, min(a + RANGE, form.size)) for a in range(form.begin, form.size, RANGE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                ((q0, n0), (q1, n1)), plain = _facts(form, *spans[i])
                yield pa.RecordBatch.from_pydict({"i": [i], "q0": [q0], "n0": [n0], "q1": [q1], "n1": [n1], "plain": [plain]})

    if len(spans) <= 1:
        facts = [_facts(form, *s) for s in spans]
    else:
        told = spark.range(0, len(spans), 1, len(spans)).mapInArrow(run, "i bigint, q0 bigint, n0 bigint, q1 bigint, n1 bigint, plain boolean").orderBy("i").collect()  # a row per range
        facts = [([(t["q0"], t["n0"]), (t["q1"], t["n1"])], t["plain"]) for t in told]
    out, quoted, rows = [], 0, 0
    for (a, b), (two, _) in zip(spans, facts):
        out.append(Range(a, b, quoted, rows + 1))
        quoted, n = two[quoted]
        rows += n
    if quoted:
        raise ValueError(f"{Path(form.path).name} ends within a quoted field")
    return out, "utf-8" if all(plain for _, plain in facts) else OTHER


def read_rows(spark: SparkSession, path: str | Path) -> tuple[str | None, DataFrame]:
    """The header's text (None without rows), and the rows below it: value, the text of a row; record, from 1."""
    form = form_of(str(path))
    ranges, encoding = _plan(spark, form)
    head = next((rows[0] for r in ranges if (rows := _rows_of(form, r))), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = _rows_of(form, ranges[i])
                records = np.arange(len(rows), dtype=np.int64) + ranges[i].first - 1
                below = int(len(rows) > 0 and records[0] == 0)
                texts = pa.array([x.decode(encoding, "replace") for x in rows[below:]], pa.string())
                yield pa.RecordBatch.from_arrays([texts, pa.array(records[below:])], ["value", "record"])

    df = spark.range(0, len(ranges), 1, max(len(ranges), 1)).mapInArrow(run, "value string, record bigint")
    return None if head is None else head.decode(encoding, "replace"), df
