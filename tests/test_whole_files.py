from __future__ import annotations

import json
import zipfile

import pytest

from lakewarden.sinks import CELL, _workbook
from lakewarden.sources.study_folder import read_folder


def usdm(**above):
    return {**above, "study": {"id": "S1", "instanceType": "Study", "name": "n" * 30_000, "versions": []}, "usdmVersion": "4.0"}


def test_usdm_version_below_a_long_study(spark, tmp_path):
    text = json.dumps(usdm())
    assert text.index('"usdmVersion"') > 20_000
    (tmp_path / "study.json").write_text(text)
    assert "STUDY" in {n.upper() for n in read_folder(spark, tmp_path).datasets}


def test_dataset_json_with_usdm_words_in_cells(spark, tmp_path):
    columns = [{"itemOID": "a", "name": "A", "label": "", "dataType": "string"}]
    rows = [["usdmVersion"], ['"usdmVersion": "4.0"'], ['"study": {']]
    (tmp_path / "ae.json").write_text(json.dumps({"datasetJSONVersion": "1.1.0", "name": "AE", "records": 3, "columns": columns, "rows": rows}))
    study = read_folder(spark, tmp_path)
    assert [r.A for r in study.datasets["AE"].df.collect()] == [r[0] for r in rows]


def test_workbook_refuses_a_text_that_no_cell_holds(tmp_path):
    path = tmp_path / "out.xlsx"
    with pytest.raises(ValueError, match="column Value of 'Records' has texts over the 32767 characters"):
        _workbook(path, {"Problems": (["rule_id"], [("r",)]), "Records": (["Record", "Value"], [(1, "x" * (CELL + 1))])})
    assert not path.exists()
    _workbook(path, {"Records": (["Record", "Value"], [(1, "x" * CELL), (2, None)])})
    with zipfile.ZipFile(path) as z:
        assert "x" * CELL in z.read("xl/worksheets/sheet1.xml").decode()
