"""Files as Spark reads them, and what a rule needs before it may judge."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from lakewarden import api
from lakewarden.model import Dataset, Operation, Rule, RuleSkipped, Study, VariableMeta
from lakewarden.plans import operations
from lakewarden.plans.scope import of_family
from lakewarden.runner import run
from lakewarden.sources.frame import with_record
from lakewarden.sources.study_folder import read_file
from lakewarden.sources.xpt import write_xpt

from .helpers import dataset, leaf, verdicts
from .sas_file import write_sas7bdat

T, F = True, False


def test_csv_types_quotes_and_marks(spark, tmp_path):
    path = tmp_path / "ae.csv"
    path.write_bytes(b"\xef\xbb\xbfDOMAIN,ID,N,T\r\n,007,1.5,\"a, \"\"b\"\"\nc\"\r\nAE,8,,\xc3\xa9\r\n\r\n,9,2e1, x \r\n")
    d = read_file(spark, path)
    assert [(v.name, v.type) for v in d.variables] == [("DOMAIN", "Char"), ("ID", "Char"), ("N", "Num"), ("T", "Char")] and d.domain_value == "AE"
    assert [tuple(r) for r in d.df.orderBy("__record").collect()] == [("", "007", 1.5, 'a, "b"\nc', 1), ("AE", "8", None, "é", 2), ("", "9", 20.0, " x ", 3)]


def test_csv_of_another_encoding_and_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"A,B\n\xe9,1\n")
    assert [tuple(r) for r in read_file(spark, tmp_path / "a.csv").df.collect()] == [("é", 1.0, 1)]
    (tmp_path / "b.csv").write_text("A,B\n1,2\n3\n")
    with pytest.raises(ValueError, match="row 3"):
        read_file(spark, tmp_path / "b.csv")
    (tmp_path / "c.csv").write_text("A,a\n1,2\n")
    with pytest.raises(ValueError, match="same"):
        read_file(spark, tmp_path / "c.csv")


def test_transport_tasks_read_their_own_rows(spark, tmp_path, monkeypatch):
    import lakewarden.sources.xpt as xpt

    monkeypatch.setattr(xpt, "CHUNK", 3)
    path = tmp_path / "ae.xpt"
    write_xpt(str(path), "AE", [VariableMeta("A", "", "Char", 5), VariableMeta("N", "", "Num", 8)], [(f"v{i}", float(i)) for i in range(10)])
    reader = xpt._Reader(str(path))
    parts = reader.partitions()
    assert [p.value for p in parts] == [(0, 3), (3, 6), (6, 9), (9, 10)]
    assert [r for p in parts for r in reader.read(p)] == [(f"v{i}", float(i), i + 1) for i in range(10)]
    data = path.read_bytes()
    path.write_bytes(data + data[240:])
    reader = xpt._Reader(str(path))
    with pytest.raises(ValueError, match="one member"):
        [r for p in reader.partitions() for r in reader.read(p)]


def test_sas_files(spark, tmp_path, monkeypatch):
    import lakewarden.sources.sas7bdat as sas

    monkeypatch.setattr(sas, "CHUNK", 70)
    path = tmp_path / "ae.sas7bdat"
    columns = [("DOMAIN", "Domain", "", 2), ("AETERM", "Reported Term", "", 12), ("AESEQ", "Sequence", "", None), ("AEDT", "Day", "DATE", None), ("AEDTM", "Moment", "DATETIME", None)]
    rows = [("AE", f"term é {i}", None if i % 7 == 0 else i / 2, 23000.0 + i, 2e9 + i) for i in range(300)]
    write_sas7bdat(path, columns, rows)
    d = read_file(spark, path)
    assert [(v.name, v.label, v.type, v.length) for v in d.variables] == [("DOMAIN", "Domain", "Char", 2), ("AETERM", "Reported Term", "Char", 12), ("AESEQ", "Sequence", "Num", 8), ("AEDT", "Day", "Num", 8), ("AEDTM", "Moment", "Num", 8)]
    got = [tuple(r) for r in d.df.orderBy("__record").collect()]
    epoch = datetime(1960, 1, 1)
    want = [(a, t, n, (epoch + timedelta(days=x)).strftime("%Y-%m-%d"), (epoch + timedelta(seconds=y)).strftime("%Y-%m-%dT%H:%M:%S"), i + 1) for i, (a, t, n, x, y) in enumerate(rows)]
    assert got == want and d.domain_value == "AE"
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) - 2000])
    with pytest.raises(Exception, match="page"):
        read_file(spark, path).df.collect()


def test_records_are_numbered_over_partitions(spark):
    df = with_record(spark.createDataFrame([(i,) for i in range(20)], "a int").repartition(1).sortWithinPartitions("a").repartitionByRange(4, "a").sortWithinPartitions("a"))
    assert sorted((r.a, r["__record"]) for r in df.collect()) == [(i, i + 1) for i in range(20)]


def test_sets_that_are_tables_are_compared_whole(spark):
    a = dataset(spark, "SV", "V string", [("a",), ("b",), ("",)])
    b = dataset(spark, "TV", "V string, W string", [("a", "a"), ("b", "z"), ("c", "")])
    study = Study({"SV": a, "TV": b})

    def run_(check, *ops):
        return verdicts(a.df, check, True, [Operation(*o) for o in ops], study, a)

    of = {n: (f"${n}", "distinct", {"name": n[0].upper(), "domain": "TV"}) for n in ("v", "w")}
    assert run_(leaf("$v", "contains_all", ["a", "c"]), of["v"]) == [T, T, T]
    assert run_(leaf("$v", "contains_all", ["a", "x"]), of["v"]) == [F, F, F]
    assert run_(leaf("V", "contains_all", "$w"), of["w"]) == [F, F, F]
    assert run_(leaf("V", "not_contains_all", "$w"), of["w"]) == [T, T, T]
    assert run_(leaf("$v", "contains_all", "$w"), of["v"], of["w"]) == [F, F, F]
    assert run_(leaf("V", "contains_all", ["a", "b", ""])) == [T, T, T]


def test_a_large_set_is_reported_in_part(spark, monkeypatch):
    monkeypatch.setattr(operations, "REPORTED", 2)
    d = dataset(spark, "AE", "V string", [(x,) for x in "dcba"])
    rule = Rule("R", leaf("V", "is_contained_by", "$v"), operations=[Operation("$v", "distinct", {"name": "V"})], output=["$v"])
    out = run(spark, [rule], Study({"AE": d}))
    assert {r.Value for r in out.findings.collect()} == {"['a', 'b', ... (4 in all)]"}
    out.release()


def test_rules_without_their_inputs_are_left_out(spark):
    d = dataset(spark, "AE", "AETERM string", [("x",)])
    study = Study({"AE": d})

    def why(check, kind="Record Data", **more):
        return [r.reason for r in run(spark, [Rule("R", check, kind, **more)], study).skipped.collect()]

    assert "define.xml" in why(leaf("dataset_name", "non_empty"), "Dataset Metadata Check against Define XML")[0]
    assert "library" in why({"any": [leaf("AETERM", "empty"), leaf("AETERM", "equal_to", "library_variable_name")]})[0]
    assert "labels" in why(leaf("variable_label", "empty"), "Variable Metadata Check")[0]
    assert "does not give" in why({"any": [leaf("AETERM", "empty"), leaf("define_dataset_class", "empty")]})[0]
    d.file_name = "ae.xpt"
    assert why(leaf("variable_label", "empty"), "Variable Metadata Check") == []


def test_one_version_of_a_rule_by_standard():
    old, alone, new = Rule("R", {}, standards=[("SENDIG", "3.1", ""), ("SDTMIG", "3.4", "")]), Rule("R", {}, standards=[("SDTMIG", "3.4", "")]), Rule("R", {}, source="core_contributor")
    assert of_family([old, new], "SENDIG") == [old] and of_family([old, new], "SDTMIG") == [new] and of_family([old, new], None) == [new] and of_family([old, new], "TIG") == [old]
    assert of_family([alone, new], "SENDIG") == [new] and of_family([old], "SDTMIG") == [old] and of_family([old, alone], "TIG") == [old, alone]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "AETERM string, KEY int").coalesce(1).write.parquet(str(tmp_path / "ae"))
    from lakewarden.plans.early import early
    from lakewarden.sources.frame import parquet

    d = parquet(spark, str(tmp_path / "ae"), "AE")
    rule = Rule("R", {"all": [leaf("AETERM", "equal_to", "x", value_is_literal=True), leaf("KEY", "less_than", 9)]}, match_datasets=[{}])
    rows = early(d.df, [rule], d)
    assert [(r.AETERM, r.KEY, r["__record"]) for r in rows.collect()] == [("x", 1, 1)]
    assert "EqualTo(AETERM,x)" in rows._jdf.queryExecution().toString()
    whole = Rule("R", {"all": [leaf("AETERM", "equal_to", "x", value_is_literal=True), leaf("AETERM", "is_not_unique_set", ["KEY"])]}, match_datasets=[{}])
    assert early(d.df, [whole], d) is d.df


def test_check_dataset_of_a_csv(spark, tmp_path):
    (tmp_path / "ae.csv").write_text("DOMAIN,AETERM\nAE,x\nAE,\n")
    out = api.check_dataset(spark, tmp_path / "ae.csv", [Rule("R", leaf("AETERM", "empty"), message="Blank")])
    assert [(r.Dataset, r.Record, r.Variable, r.Value) for r in out.findings.collect()] == [("AE", 2, "AETERM", "")]


def test_dialects_stay_apart(spark):
    d = dataset(spark, "AE", "AETERM string", [("x",)])
    with pytest.raises(RuleSkipped):
        verdicts(d.df, leaf("zz", "empty"), data=d)
    assert isinstance(d, Dataset) and verdicts(d.df, leaf("zz", "empty"), core1=True, data=d) == [F]
