"""Rows of a JSON document by byte ranges, against the parser of the standard library."""

from __future__ import annotations

import json
import random

import pytest

import lakewarden.sources.json_rows as jr
from lakewarden.sources.dataset_json import read_dataset_json

TEXTS = ["", "plain", 'a "quoted" one', "back\\slash", "ends in \\", '\\"', "[1, [2", "]]}{", '"rows": [[', "é ü 漢字", "line\nend", '\\\\"\\', "x" * 300]


def document(rng, count, rows_first=False, indent=None):
    rows = [[rng.choice(TEXTS), rng.choice([1, 2.5, None, -3]), rng.choice(TEXTS)] for _ in range(count)]
    columns = [{"name": "A", "label": 'the "rows": [ of', "dataType": "string"}, {"name": "N", "label": "n", "dataType": "integer"}, {"name": "B", "label": "b", "dataType": "string"}]
    about = {"sourceSystem": {"name": "s", "rows": [[1]]}, "name": "AE", "label": "l", "columns": columns}
    whole = {"datasetJSONVersion": "1.1", "rows": rows, **about, "more": [[1], [2]], "records": count} if rows_first else {"datasetJSONVersion": "1.1", **about, "records": count, "rows": rows}
    return rows, json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=indent)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_a_row_belongs_to_the_range_it_begins_in(tmp_path, size):
    """Ranges of a few bytes, added up here."""
    rows, text = document(random.Random(size), 6)
    path, total = str(tmp_path / "ae.json"), len(text.encode())
    (tmp_path / "ae.json").write_text(text, encoding="utf-8")
    depth, quoted, found = jr.ROWS, 0, []
    for a in range(len(jr.head(path)[0]), total, size):
        after, change, lowest, begun = jr._facts(path, a, min(a + size, total))[quoted]
        if depth + lowest < jr.ROWS:
            break
        got = jr._rows_of(path, jr.Range(a, min(a + size, total), depth, quoted, len(found) + 1))
        assert len(got) == begun[jr.ROWS - depth + jr.DEEPEST]
        found, depth, quoted = found + got, depth + change, after
    assert [json.loads(x) for x in found] == rows[: len(found)] and len(found) >= len(rows) - 1


@pytest.mark.parametrize("size", [200, 1000, 1 << 20])
@pytest.mark.parametrize("rows_first", [False, True])
def test_ranges_of_any_size_give_each_row_once(spark, monkeypatch, tmp_path, size, rows_first):
    rng = random.Random(size)
    monkeypatch.setattr(jr, "STEP", 16)
    monkeypatch.setattr(jr, "RANGE", size)
    rows, text = document(rng, 60, rows_first, rng.choice([None, 1]))
    (tmp_path / "ae.json").write_text(text, encoding="utf-8")
    about, out, n = jr.read_rows(spark, tmp_path / "ae.json")
    got = sorted((r.record, r.value) for r in out.collect())
    assert [json.loads(v) for _, v in got] == rows and [i for i, _ in got] == list(range(1, len(rows) + 1)) and n == len(rows)
    assert about["records"] == len(rows) and [c["name"] for c in about["columns"]] == ["A", "N", "B"] and about["rows"] == []
    assert size > 1000 or out.rdd.getNumPartitions() > 3


def test_dataset_over_many_ranges(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(jr, "RANGE", 500)
    rows, text = document(random.Random(9), 80)
    (tmp_path / "ae.json").write_text(text)
    d = read_dataset_json(spark, tmp_path / "ae.json")
    assert [(r.A, r.N, r.B) for r in d.df.orderBy("__record").collect()] == [(a, n if n is None else float(n), b) for a, n, b in rows]


def test_damaged_and_empty_documents(spark, monkeypatch, tmp_path):
    path = tmp_path / "ae.json"
    for text in ('{"columns": [], "rows": []}', '{"rows":[ ] , "columns": []}', '{"columns": []}', '﻿{"columns": [], "rows": []}'):
        path.write_text(text, encoding="utf-8")
        about, out, n = jr.read_rows(spark, path)
        assert about["columns"] == [] and out.count() == n == 0
    for text in ('{"columns": [], "rows": [[1, 2], [3', '{"columns": [], "rows": [[1, 2]', '{"columns": [], "rows": [["a]]}'):
        path.write_text(text)
        with pytest.raises(ValueError, match="ends within"):
            jr.read_rows(spark, path)[1].count()
    path.write_text('{"name": "AE", "columns": [{"name": "A", "dataType": "string"}], "rows": [["a"], [b]]}')
    with pytest.raises(Exception, match="no JSON in row 2"):
        read_dataset_json(spark, path).df.collect()


def test_a_range_of_json_takes_few_bytes_of_memory():
    data = b'\n  [\n   "000001",\n   "a, \\"\\u00e9\\"\\n",\n   1.5\n  ],' * 40_000
    import tracemalloc

    tracemalloc.start()
    try:
        _, depth = jr._steps(data, 0, 0)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert depth.dtype.itemsize == 4 and depth[-1] == 0 and most < 12 * len(data)
