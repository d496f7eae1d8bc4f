"""A writer of small .sas7bdat files, for tests: 32-bit, little-endian, not compressed."""

from __future__ import annotations

import struct
from pathlib import Path

from pandas.io.sas import sas_constants as known

PAGE, HEADER = 4096, 1024


def write_sas7bdat(path: Path, columns: list[tuple], rows: list[tuple], label: str = "") -> None:
    """``columns`` are (name, label, format, length); a length of None makes a number."""
    words, spots = bytearray(56), {}

    def word(text: str) -> tuple[int, int]:
        if text not in spots:
            spots[text] = (len(words), len(text.encode()))
            words.extend(text.encode())
            words.extend(bytes(-len(words) % 4))
        return spots[text]

    names = [(word(n), word(t), word(f)) for n, t, f, _ in columns]
    words.extend(bytes(-len(words) % 4))
    words[:2] = struct.pack("<H", len(words))
    widths = [8 if n is None else n for *_, n in columns]
    width, n = sum(widths), len(columns)
    text = b"\xfd\xff\xff\xff" + bytes(words)
    name = b"\xff\xff\xff\xff" + bytes(8) + b"".join(struct.pack("<HHHH", 0, *at, 0) for at, _, _ in names) + bytes(8)
    attributes = b"\xfc\xff\xff\xff" + bytes(8) + b"".join(struct.pack("<IIHBB", sum(widths[:i]), w, 0, 1 if columns[i][3] is None else 2, 0) for i, w in enumerate(widths)) + bytes(8)
    formats = [b"\xfe\xfb\xff\xff" + bytes(30) + struct.pack("<HHHHHH", 0, *form, 0, *title) + bytes(6) for _, title, form in names]

    def body(row: tuple) -> bytes:
        parts = []
        for v, (*_, size) in zip(row, columns):
            parts.append(struct.pack("<d", float("nan") if v is None else v) if size is None else str(v).encode().ljust(size)[:size])
        return b"".join(parts)

    size = bytearray(480)
    subheaders = [bytes(size), b"\xf6\xf6\xf6\xf6" + struct.pack("<I", n) + bytes(4), text, name, attributes, *formats]
    begin = 24 + 12 * len(subheaders)
    begin += begin % 8
    first = min(len(rows), (PAGE - begin - sum(map(len, subheaders))) // width)
    for at, v in ((0, 0xF7F7F7F7), (20, width), (24, len(rows)), (36, n), (60, first)):
        size[at : at + 4] = struct.pack("<I", v)
    size[378:380] = struct.pack("<H", 8)
    subheaders[0] = bytes(size)
    page, end, pointers = bytearray(PAGE), PAGE, b""
    for s in subheaders:
        end -= len(s)
        page[end : end + len(s)] = s
        pointers += struct.pack("<IIBBH", end, len(s), 0, 0, 0)
    page[16:24] = struct.pack("<HHHH", 0x200, first + len(subheaders), len(subheaders), 0)
    page[24 : 24 + len(pointers)] = pointers
    data = b"".join(map(body, rows[:first]))
    page[begin : begin + len(data)] = data
    pages, each = [bytes(page)], (PAGE - 24) // width
    for i in range(first, len(rows), each):
        some = rows[i : i + each]
        pages.append((bytes(16) + struct.pack("<HHHH", 0x100, len(some), 0, 0) + b"".join(map(body, some))).ljust(PAGE, b"\0"))
    head = bytearray(HEADER)
    head[: len(known.magic)] = known.magic
    head[32], head[35], head[37], head[39], head[70] = 0x22, 0x22, 1, 0x31, 20
    head[84:92], head[92:156], head[156:164] = b"SAS FILE", label.encode().ljust(64), b"DATA    "
    head[196:208] = struct.pack("<III", HEADER, PAGE, len(pages))
    path.write_bytes(bytes(head) + b"".join(pages))
