"""SAS transport files (version 5): a decoder in plain Python behind a Spark DataSource."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import VariableMeta

#: Marks and sizes of the transport format (fixed values).
_LIBRARY, _MEMBER, _NAMESTR, _OBS = b"HEADER RECORD*******LIBRARY HEADER RECORD", b"HEADER RECORD*******MEMBER  HEADER RECORD", b"HEADER RECORD*******NAMESTR HEADER RECORD", b"HEADER RECORD*******OBS     HEADER RECORD"
_CARD = 80
#: Observations a task decodes.
CHUNK = 200_000


def ibm_to_float(raw: np.ndarray) -> np.ndarray:
    """IBM hexadecimal floats (rows of 8 bytes) as doubles; missing values as NaN."""
    bits = raw.view(">u8").astype(np.uint64).reshape(-1)
    sign = np.where(bits >> np.uint64(63), -1.0, 1.0)
    exponent = ((bits >> np.uint64(56)) & np.uint64(0x7F)).astype(np.int64) - 64
    mantissa = (bits & np.uint64(0x00FFFFFFFFFFFFFF)).astype(np.float64)
    out = sign * mantissa * np.power(2.0, (4 * exponent - 56).astype(np.float64))
    missing = (mantissa == 0) & (raw[:, 0] != 0)
    return np.where(missing, np.nan, out)


def float_to_ibm(x: float | None) -> bytes:
    if x is None or x != x:
        return b"." + bytes(7)
    if x == 0:
        return bytes(8)
    sign, x = (0x80, -x) if x < 0 else (0, x)
    exponent = 0
    while x >= 1:
        x, exponent = x / 16, exponent + 1
    while x < 1 / 16:
        x, exponent = x * 16, exponent - 1
    return bytes([sign | (exponent + 64)]) + int(x * (1 << 56)).to_bytes(8, "big")[1:]


def header(data: bytes) -> tuple[str, str, list[tuple[VariableMeta, int]], int]:
    """Member name, label, (variable, offset) and where the observations begin, from the front of a file."""
    if not data.startswith(_LIBRARY):
        raise ValueError("not a SAS transport file")
    at = data.find(_MEMBER)
    if at < 0:
        raise ValueError("a transport file must hold one member")
    size = int(data[at + 74 : at + 78])
    descriptor = data.find(b"HEADER RECORD*******DSCRPTR", at) + _CARD
    name = data[descriptor + 8 : descriptor + 16].decode("ascii").strip()
    label = data[descriptor + _CARD + 32 : descriptor + _CARD + 72].decode("latin-1").strip()
    at = data.find(_NAMESTR)
    count = int(data[at + 54 : at + 58])
    at += _CARD
    fields = []
    for i in range(count):
        f = data[at + i * size : at + (i + 1) * size]
        if len(f) < size:
            raise ValueError("the file ends within its list of variables")
        kind, _, length, _ = struct.unpack(">hhhh", f[:8])
        position = struct.unpack(">i", f[84:88])[0]
        fields.append((VariableMeta(f[8:16].decode("ascii").strip(), f[16:56].decode("latin-1").strip(), "Num" if kind == 1 else "Char", length), position))
    at += -(-count * size // _CARD) * _CARD
    if not data[at:].startswith(_OBS):
        raise ValueError("the file has no observations record where one is due")
    return name, label, fields, at + _CARD


def head_of(path: str) -> tuple[str, str, list[tuple[VariableMeta, int]], int]:
    """The header of a file; no more of it is read than the header takes."""
    with open(path, "rb") as f:
        data = f.read(1 << 16)
        while _OBS not in data and (more := f.read(1 << 16)):
            data += more
    return header(data)


def count_rows(path: str, begin: int, width: int) -> int:
    """Observations, without the blanks that fill the last card; only the end of the file is read."""
    total = os.path.getsize(path)
    n, rest = divmod(total - begin, width)
    if total % _CARD:
        raise ValueError("the file is cut off within a card")
    with open(path, "rb") as f:
        while n and width < _CARD and (total - begin) - (n - 1) * width <= _CARD:
            f.seek(begin + (n - 1) * width)
            if f.read(width).strip(b" "):
                break
            n -= 1
    return n


def decode(data: bytes, fields: list[tuple[VariableMeta, int]]) -> list[list]:
    """Columns of the observations that ``data`` holds."""
    block = np.frombuffer(data, np.uint8).reshape(-1, max(p + v.length for v, p in fields))
    out = []
    for v, p in fields:
        part = block[:, p : p + v.length]
        if v.type == "Num":
            full = np.zeros((len(part), 8), np.uint8)
            full[:, : v.length] = part
            out.append([None if x != x else float(x) for x in ibm_to_float(full)])
        else:
            out.append([_repaired(bytes(r)) for r in part])
    return out


def _repaired(raw: bytes) -> str:
    raw = raw.rstrip(b" \x00")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


class _Reader(DataSourceReader):
    """Tasks read their own observations; a second member, which would stand among them, is refused by the task that meets it."""

    def __init__(self, path: str):
        self.path = path
        _, _, self.fields, self.begin = head_of(path)
        self.width = max(p + v.length for v, p in self.fields)

    def partitions(self) -> list[InputPartition]:
        n = count_rows(self.path, self.begin, self.width)
        return [InputPartition((i, min(i + CHUNK, n))) for i in range(0, n, CHUNK)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last = partition.value
        with open(self.path, "rb") as f:
            f.seek(self.begin + first * self.width)
            data = f.read((last - first) * self.width)
            # A mark may begin in one task's part and end in the next one's.
            if _MEMBER in data + f.read(len(_MEMBER)):
                raise ValueError("a transport file must hold one member")
        for i, row in enumerate(zip(*decode(data, self.fields))):
            yield (*row, first + i + 1)


class XptDataSource(DataSource):
    """``spark.read.format("xpt").load(path)``; the last column is the record number."""

    @classmethod
    def name(cls) -> str:
        return "xpt"

    def schema(self) -> str:
        _, _, fields, _ = head_of(self.options["path"])
        return ", ".join([*(f"`{v.name}` {'double' if v.type == 'Num' else 'string'}" for v, _ in fields), "__record bigint"])

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"])


def front(name: str, variables: list[VariableMeta], label: str = "") -> bytes:
    """What stands in a transport file before its observations."""

    def card(text: bytes) -> bytes:
        return text.ljust(_CARD, b" ")

    zeros = b"000000000000000000000000000000  "
    stamp = b"01JAN24:00:00:00"
    out = card(_LIBRARY + b"!!!!!!!" + zeros) + card(b"SAS     SAS     SASLIB  9.4     " + b" " * 32 + stamp) + card(stamp)
    out += card(_MEMBER + b"!!!!!!!000000000000000001600000000140  ") + card(b"HEADER RECORD*******DSCRPTR HEADER RECORD!!!!!!!" + zeros)
    out += card(b"SAS     " + name.encode().ljust(8) + b"SASDATA 9.4     " + b" " * 32 + stamp) + card(stamp + b" " * 16 + label.encode().ljust(40))
    out += card(_NAMESTR + b"!!!!!!!000000" + f"{len(variables):04d}".encode() + b"00000000000000000000  ")
    names, at = b"", 0
    for i, v in enumerate(variables):
        length = _length(v)
        names += struct.pack(">hhhh", 1 if v.type == "Num" else 2, 0, length, i + 1) + v.name.encode().ljust(8) + v.label.encode().ljust(40) + b" " * 8 + bytes(8) + b" " * 8 + bytes(4) + struct.pack(">i", at) + bytes(52)
        at += length
    return out + names + b" " * (-len(names) % _CARD) + card(_OBS + b"!!!!!!!" + zeros)


def _length(v: VariableMeta) -> int:
    return 8 if v.type == "Num" else int(v.length or 8)


def observations(variables: list[VariableMeta], rows: Iterable[tuple]) -> bytes:
    return b"".join(float_to_ibm(x) if v.type == "Num" else str(x or "").encode().ljust(_length(v))[: _length(v)] for r in rows for v, x in zip(variables, r))


def rest(variables: list[VariableMeta], n: int) -> bytes:
    """The blanks that fill the last card behind ``n`` observations."""
    return b" " * (-n * sum(map(_length, variables)) % _CARD)


def write_xpt(path: str, name: str, variables: list[VariableMeta], rows: list[tuple], label: str = "") -> None:
    """A transport file of small data; used for exchange and in tests."""
    with open(path, "wb") as f:
        f.write(front(name, variables, label) + observations(variables, rows) + rest(variables, len(rows)))
