"""The rows of a JSON document, cut at byte ranges.

Whether a byte lies in a text, and how deep it is nested, hangs on all bytes
before it. A task finds for its range what either beginning (within a text or
not) makes of it: the change of depth, the lowest depth, the rows begun at each
depth. The driver adds these up, a few numbers per range, and then each range
knows its beginning and the number of its first row. A row belongs to the range
it begins in, whose task reads on to its end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a range; what is read of a document's head, and beyond a range, at a time.
RANGE, STEP = 8 << 20, 1 << 16
#: Rows lie at this depth: in the list, in the document.
ROWS = 2
#: Deeper than this a range may not begin.
DEEPEST = 64
_KEY = re.compile(rb'"rows"\s*:\s*\[')


class Range(NamedTuple):
    start: int
    end: int
    depth: int
    quoted: int
    first: int


def _quotes(b: np.ndarray, slashes: int) -> np.ndarray:
    """Where texts begin and end: quotes behind an even number of backslashes, ``slashes`` of which may stand before the range."""
    quote, slash = np.flatnonzero(b == ord('"')), np.flatnonzero(b == ord("\\"))
    if not len(slash):
        return quote[(quote > 0) | (slashes % 2 == 0)]
    # Where the run of backslashes around each one begins; one from the first byte on goes on from before the range.
    head = np.concatenate(([True], np.diff(slash) > 1))
    begin = slash[head][np.cumsum(head) - 1]
    begin = np.where(begin == 0, -slashes, begin)
    at = np.searchsorted(slash, quote) - 1
    near = (at >= 0) & (slash[np.maximum(at, 0)] == quote - 1)
    run = np.where(near, quote - begin[np.maximum(at, 0)], np.where(quote == 0, slashes, 0))
    return quote[run % 2 == 0]


def _steps(data: bytes, slashes: int, quoted: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and the depth after each, from 0. Only the depth takes more than a byte for each of them."""
    b = np.frombuffer(data, np.uint8)
    within = np.zeros(len(b), np.uint8)
    within[_quotes(b, slashes)] = 1
    np.bitwise_xor.accumulate(within, out=within)
    step = ((b == ord("[")) | (b == ord("{"))).view(np.int8) - ((b == ord("]")) | (b == ord("}"))).view(np.int8)
    step[within != quoted] = 0
    return b, np.cumsum(step, dtype=np.int32)


def _turned(depth: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By how much the depth changes at some bytes."""
    return depth[at] - np.where(at > 0, depth[at - 1], 0)


def _begins(b: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where lists begin outside texts."""
    at = np.flatnonzero(b == ord("["))
    return at[_turned(depth, at) > 0]


def _read(path: str, start: int, end: int) -> tuple[bytes, int]:
    """The bytes of a range and the number of backslashes just before it."""
    with open(path, "rb") as f:
        slashes = 0
        while slashes < start and (f.seek(start - slashes - 1), f.read(1))[1] == b"\\":
            slashes += 1
        f.seek(start)
        return f.read(end - start), slashes


def _facts(path: str, start: int, end: int) -> list[tuple[int, int, int, list[int]]]:
    """For either beginning: whether the range ends in a text, the change of depth, the lowest one, lists begun per depth (from -DEEPEST to ROWS)."""
    data, slashes = _read(path, start, end)
    odd, out = len(_quotes(np.frombuffer(data, np.uint8), slashes)) & 1, []
    for quoted in (0, 1):
        b, depth = _steps(data, slashes, quoted)
        begun = depth[_begins(b, depth)] - 1
        begun = begun[(begun >= -DEEPEST) & (begun <= ROWS)]
        out.append((odd ^ quoted, depth[-1].item(), min(0, depth.min().item()), np.bincount(begun + DEEPEST, minlength=DEEPEST + ROWS + 1).tolist()))
    return out


def head(path: str) -> tuple[bytes, bool]:
    """The document up to the beginning of its rows, or all of it if it has none."""
    data = b""
    with open(path, "rb") as f:
        while more := f.read(max(STEP, len(data))):
            data += more
            for m in _KEY.finditer(data):
                before = data[: m.start()]
                _, depth = _steps(before, 0, 0)
                if len(depth) and depth[-1] == 1 and len(_quotes(np.frombuffer(before, np.uint8), 0)) % 2 == 0:
                    return data[: m.end()], True
    return data, False


def _plan(spark: SparkSession, path: str, begin: int) -> tuple[list[Range], int, int]:
    """The ranges of the rows, where their list ends, and how many they are."""
    size = Path(path).stat().st_size
    spans = [(a, min(a + RANGE, size)) for a in range(begin, size, RANGE)]
    if len(spans) == 1:
        facts = [_facts(path, *spans[0])]
    else:
        kind = "i bigint, facts array<struct<quoted: int, change: int, lowest: int, begun: array<bigint>>>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    found = [dict(zip(("quoted", "change", "lowest", "begun"), f)) for f in _facts(path, *spans[i])]
                    yield pa.RecordBatch.from_pylist([{"i": i, "facts": found}], pa.schema([("i", pa.int64()), ("facts", pa.list_(pa.struct([("quoted", pa.int32()), ("change", pa.int32()), ("lowest", pa.int32()), ("begun", pa.list_(pa.int64()))])))]))

        facts = [[tuple(x) for x in r["facts"]] for r in spark.range(0, len(spans), 1, len(spans)).mapInArrow(run, kind).orderBy("i").collect()]  # a row per range
    out, depth, quoted, rows = [], ROWS, 0, 0
    for (a, b), two in zip(spans, facts):
        after, change, lowest, begun = two[quoted]
        if depth + lowest < ROWS:
            data, slashes = _read(path, a, b)
            chars, depths = _steps(data, slashes, quoted)
            end = int(np.argmax(depth + depths < ROWS))
            out.append(Range(a, a + end, depth, quoted, rows + 1))
            starts = _begins(chars, depths)
            return out, a + end, rows + int((depth + depths[starts[starts < end]] == ROWS + 1).sum())
        if not ROWS <= depth <= DEEPEST:
            raise ValueError(f"{Path(path).name} is nested too deep")
        out.append(Range(a, b, depth, quoted, rows + 1))
        rows, depth, quoted = rows + begun[ROWS - depth + DEEPEST], depth + change, after
    raise ValueError(f"{Path(path).name} ends within its rows")


def _rows_of(path: str, r: Range) -> list[bytes]:
    """The texts of the rows that begin in a range."""
    end, more = r.end, STEP
    while True:
        data, slashes = _read(path, r.start, end)
        b, depth = _steps(data, slashes, r.quoted)
        starts = _begins(b, depth)
        starts = starts[(depth[starts] + r.depth == ROWS + 1) & (starts < r.end - r.start)]
        if not len(starts):
            return []
        ends = np.flatnonzero((b == ord("]")) | (b == ord("}")))
        ends = ends[(_turned(depth, ends) < 0) & (depth[ends] + r.depth == ROWS)]
        ends = ends[np.searchsorted(ends, starts[0]) :][: len(starts)]
        if len(ends) == len(starts):
            return [data[s : e + 1] for s, e in zip(starts, ends)]
        if len(data) < end - r.start:
            raise ValueError(f"{Path(path).name} ends within a row")
        end, more = end + more, more * 2


def read_rows(spark: SparkSession, path: str | Path) -> tuple[dict, DataFrame, int]:
    """What a document says beside its rows, the rows (value, the text of a row; record, from 1), and their number."""
    path = str(path)
    before, some = head(path)
    if not some:
        return json.loads(before.decode("utf-8-sig")), spark.createDataFrame([], "value string, record bigint"), 0
    ranges, end, n = _plan(spark, path, len(before))
    with open(path, "rb") as f:
        f.seek(end)
        about = json.loads((before + f.read()).decode("utf-8-sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows = _rows_of(path, ranges[i])
                records = np.arange(len(rows), dtype=np.int64) + ranges[i].first
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).cast(pa.string()), pa.array(records)], ["value", "record"])

    return about, spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "value string, record bigint"), n
