"""Rows of a CSV file by byte ranges, against the reader of the standard library."""

from __future__ import annotations

import csv
import io
import random

import pytest

import lakewarden.sources.csv_rows as cr
from lakewarden.sources.tables import read_csv

TEXTS = ["", "plain", 'a "quoted" one', '"', '""', '"""', "a,b", "line\nend", "\n", "\n\n", ',"\n",', "é ü 漢字", 'x"', '"x', "end\r\nof", "x" * 90, '"' * 40, " ", "0"]


def document(rng, count, end="\r\n", quoting=csv.QUOTE_MINIMAL):
    rows = [["A", "B b", "C"]] + [[rng.choice(TEXTS), rng.choice(TEXTS), rng.choice(TEXTS)] for _ in range(count)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=quoting).writerows(rows)
    return rows, out.getvalue()


def cut(path, size):
    """The rows by ranges of ``size`` bytes, added up here."""
    form, quoted, found = cr.form_of(str(path)), 0, []
    for a in range(form.begin, form.size, size):
        two, plain = cr._facts(form, a, min(a + size, form.size))
        got = cr._rows_of(form, cr.Range(a, min(a + size, form.size), quoted, len(found) + 1))
        quoted, n = two[quoted]
        assert n == len(got) and plain
        found += got
    assert not quoted
    return [next(csv.reader(io.StringIO(x.decode(), newline=""))) for x in found]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_a_row_belongs_to_the_range_it_begins_in(monkeypatch, tmp_path, size, end, quoting):
    monkeypatch.setattr(cr, "STEP", 5)
    rows, text = document(random.Random(size), 25, end, quoting)
    for form in (text, "﻿" + text, text.removesuffix(end), text + end * 3):
        (tmp_path / "a.csv").write_bytes(form.encode())
        assert cut(tmp_path / "a.csv", size) == rows


def test_quotes_within_a_field_and_empty_lines(monkeypatch, tmp_path):
    monkeypatch.setattr(cr, "STEP", 3)
    (tmp_path / "a.csv").write_text('\nA,B\n5" pipe,x\n\n"a" b,"c\n"\n y "z,1\n', newline="")
    for size in (1, 2, 5, 100):
        assert cut(tmp_path / "a.csv", size) == [["A", "B"], ['5" pipe', "x"], ["a b", "c\n"], [' y "z', "1"]]


@pytest.mark.parametrize("size", [100, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_dataset_over_many_ranges(spark, monkeypatch, tmp_path, size, end):
    monkeypatch.setattr(cr, "RANGE", size)
    monkeypatch.setattr(cr, "STEP", 16)
    rows, text = document(random.Random(size), 60, end)
    (tmp_path / "a.csv").write_text(text, newline="", encoding="utf-8")
    d = read_csv(spark, tmp_path / "a.csv", "A")
    got = [tuple(r) for r in d.df.orderBy("__record").collect()]
    assert [g[3] for g in got] == list(range(1, 61))
    # Spark's parser gives line ends within quotes as line feeds where the rows end in both characters.
    assert [tuple(x.replace("\r\n", "\n") for x in g[:3]) for g in got] == [tuple(x.replace("\r\n", "\n") for x in r) for r in rows[1:]]
    assert size > 100 or d.df.rdd.getNumPartitions() > 5


def test_numbers_zeros_and_domain_by_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cr, "RANGE", 64)
    (tmp_path / "dm.csv").write_text("DOMAIN,ID,AGE,N\n" + "".join(f"{'DM' if i else ''},{i:03},{i},{'' if i % 2 else -i / 4}\n" for i in range(200)))
    d = read_csv(spark, tmp_path / "dm.csv", "dm")
    assert [v.type for v in d.variables] == ["Char", "Char", "Num", "Num"] and d.domain_value == "DM"
    assert [tuple(r)[1:] for r in d.df.orderBy("__record").collect()] == [(f"{i:03}", float(i), None if i % 2 else -i / 4, i + 1) for i in range(200)]


def test_another_encoding_by_ranges(spark, monkeypatch, tmp_path):
    """Characters of several bytes lie across ranges; one that is none tells the encoding."""
    monkeypatch.setattr(cr, "RANGE", 8)
    text = "A,B\n" + "é漢😀ü,x\n" * 20
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    assert {r.A for r in read_csv(spark, tmp_path / "a.csv", "a").df.collect()} == {"é漢😀ü"}
    for at in range(9):
        raw = b"A,B\n" + b"x" * at + b"\xe9\x93,1\n" + b"yyyy,2\n" * 5
        (tmp_path / "b.csv").write_bytes(raw)
        got = [tuple(r) for r in read_csv(spark, tmp_path / "b.csv", "b").df.orderBy("__record").collect()]
        assert got[0] == ("x" * at + "é“", 1.0, 1) and len(got) == 6


def test_damaged_and_empty_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cr, "RANGE", 4)
    path = tmp_path / "a.csv"
    for text in ("", "\n\n", "﻿"):
        path.write_text(text, encoding="utf-8")
        assert read_csv(spark, path, "a").df.count() == 0
    path.write_text("A,B\n")
    d = read_csv(spark, path, "a")
    assert d.df.columns == ["A", "B", "__record"] and d.df.count() == 0
    path.write_text('A,B\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="ends within a quoted field"):
        read_csv(spark, path, "a")
    path.write_text("A,B\n1,2\n3,4\n5\n")
    with pytest.raises(ValueError, match="row 4 has another number"):
        read_csv(spark, path, "a")
    path.write_text("A,B\n1,2\n \n5,6\n")
    assert [tuple(r) for r in read_csv(spark, path, "a").df.orderBy("__record").collect()] == [(1.0, 2.0, 1), (5.0, 6.0, 3)]
