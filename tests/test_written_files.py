"""Files that Spark's tasks write: bytes and order are those of one writer, and the driver sees no rows."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lakewarden import queries_sources
from lakewarden.shared import new_folder, write_file

SF = "/root/testdata/sf0.001"


@pytest.fixture
def seen(monkeypatch):
    """The numbers of rows that the driver was given at once."""
    counts: list[int] = []
    collect, local = DataFrame.collect, DataFrame.toLocalIterator

    def collected(self):
        rows = collect(self)
        counts.append(len(rows))
        return rows

    def iterated(self, *args):
        rows = list(local(self, *args))
        counts.append(len(rows))
        return iter(rows)

    monkeypatch.setattr(DataFrame, "collect", collected)
    monkeypatch.setattr(DataFrame, "toLocalIterator", iterated)
    return counts


@pytest.mark.parametrize("name", ["source_xpt", "source_csv", "source_test_case", "source_dataset_json", "source_ndjson", "source_folder", "sink_csv"])
def test_rows_do_not_pass_through_the_driver(spark, seen, name):
    found = queries_sources.QUERIES[name](spark, SF)
    most = max(seen, default=0)
    assert most <= 20 and (name == "source_folder" or found.count() > 5 * most)


@pytest.mark.parametrize("where", ["shared", "own"])
def test_file_of_many_parts(spark, tmp_path, where):
    path = (new_folder(spark, "written") if where == "shared" else tmp_path) / "x.csv"
    rows = spark.range(0, 1000, 1, 7).filter("id < 100 or id > 900").repartitionByRange(5, "id").sortWithinPartitions("id")

    def encode(batch):
        return "".join(f",{i}" for i in batch.column(0).to_pylist()).encode()

    write_file(rows, path, encode, b"[", b"]", skip=1)
    assert path.read_text() == "[" + ",".join(str(i) for i in range(1000) if i < 100 or i > 900) + "]"
    write_file(rows.filter("id < 0"), path, encode, b"[", b"]", skip=1)
    assert path.read_text() == "[]"


def test_findings_written_in_order(spark):
    path = new_folder(spark, "findings") / "f.csv"
    from lakewarden import api
    from lakewarden.runner import run

    result = run(spark, [queries_sources._blank()], queries_sources._events(spark, SF), None)
    api.write_findings(result, str(path))
    want = result.findings.orderBy("Dataset", "rule_id", "Record", "Variable").collect()
    with path.open(newline="", encoding="utf-8") as f:
        head, *rows = csv.reader(f)
    assert head == result.findings.columns and rows == [["" if v is None else str(v) for v in r] for r in want]
    result.release()
