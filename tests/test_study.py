from __future__ import annotations

import csv
import json
import zipfile

import pytest

from lakewarden import api, catalog
from lakewarden.model import Dataset, Rule, Study, VariableMeta
from lakewarden.plans.matching import match
from lakewarden.runner import run
from lakewarden.sources.define_xml import read_define
from lakewarden.sources.usdm import flatten
from lakewarden.sources.xpt import write_xpt

from .helpers import dataset, leaf

RULE = """
Core: {Id: T-1, Status: Published}
Rule Type: Record Data
Sensitivity: Record
Authorities: [{Organization: X, Standards: [{Name: SDTMIG, Version: "3.4"}]}]
Scope: {Classes: {Include: [EVENTS]}, Domains: {Include: [AE]}}
Check:
  all:
    - {name: --SER, operator: equal_to, value: Y}
    - {name: --SEV, operator: empty}
Outcome: {Message: Severity must be present, Output Variables: [--SER, --SEV]}
"""


@pytest.fixture
def rules(tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "one.yml").write_text(RULE)
    return catalog.load_rules(tmp_path / "rules")


@pytest.fixture
def case(tmp_path):
    folder = tmp_path / "case"
    folder.mkdir()
    (folder / "_env").write_text("PRODUCT=SDTMIG\nVERSION=3-4\n")
    (folder / "_datasets.csv").write_text("Filename,Label\nae,Adverse Events\n")
    (folder / "_variables.csv").write_text("dataset,variable,label,type,length\n" + "".join(f"ae,{v},{v},{t},8\n" for v, t in (("DOMAIN", "Char"), ("USUBJID", "Char"), ("AESEQ", "Num"), ("AETERM", "Char"), ("AESER", "Char"), ("AESEV", "Char"))))
    (folder / "ae.csv").write_text("DOMAIN,USUBJID,AESEQ,AETERM,AESER,AESEV\nAE,S1,1,head,Y,\nAE,S1,2,arm,N,\nAE,S2,1,leg,Y,MILD\nAE,S3,,007,Y,\n")
    return folder


def test_check_study_end_to_end(spark, rules, case, tmp_path):
    result = api.check_study(spark, case, rules, standard="SDTMIG", version="3.4")
    rows = sorted(tuple(r) for r in result.findings.collect())
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows if r[4] == "AESEV"] == [("AE", 1, "S1", 1.0, "AESEV", ""), ("AE", 4, "S3", None, "AESEV", "")]
    assert {r[7] for r in rows} == {"wrong value"} and len(rows) == 4
    assert api.filter_findings(result, variable="AESER").findings.count() == 2
    assert "1 checks run, 1 problems in 2 records" in api.report_text(result)
    paths = api.write_findings(result, tmp_path / "out.csv")
    with paths[0].open() as f:
        assert len(list(csv.DictReader(f))) == 4
    api.write_findings(result, tmp_path / "out.xlsx")
    assert "xl/worksheets/sheet4.xml" in zipfile.ZipFile(tmp_path / "out.xlsx").namelist()


def test_no_rule_for_a_standard_is_an_error(spark, rules, case):
    with pytest.raises(ValueError, match="no rule"):
        api.check_study(spark, case, rules, standard="SENDIG")


def test_list_rules(rules):
    assert [r["rule_id"] for r in api.list_rules(rules, domain="AE")] == ["T-1"]
    assert api.list_rules(rules, domain="DM") == []


def test_check_dataset_leaves_out_cross_dataset_rules(spark, rules):
    df = spark.createDataFrame([("AE", "S1", "x", "Y", "")], "DOMAIN string, USUBJID string, AETERM string, AESER string, AESEV string")
    other = Rule("T-2", leaf("AESER", "empty"), match_datasets=[{"Name": "DM", "Keys": ["USUBJID"]}])
    result = api.check_dataset(spark, df, [*rules, other])
    assert result.findings.select("rule_id").distinct().count() == 1
    assert [r.reason for r in result.skipped.collect()] == ["needs DM, which is not supplied"]


def test_refusals_caps_and_sensitivities(spark):
    ae = dataset(spark, "AE", "USUBJID string, V string", [(f"S{i % 2}", "x") for i in range(30)])
    study = Study({"AE": ae})
    rules = [
        Rule("CAP", leaf("V", "equal_to", "x", value_is_literal=True)),
        Rule("REF", leaf("V", "less_than", "LOD")),
        Rule("GRP", leaf("V", "equal_to", "x", value_is_literal=True), sensitivity="Group", grouping=["USUBJID"]),
        Rule("SET", leaf("V", "equal_to", "x", value_is_literal=True), sensitivity="Dataset"),
        Rule("NOT", leaf("zz", "equal_to", "x")),
        Rule("TYP", leaf("V", "empty"), rule_type="JSON Schema Check"),
        Rule("STU", leaf("DM", "not_exists"), rule_type="Domain Presence Check", message="DM must be present"),
    ]
    result = run(spark, rules, study, 10)
    per = {r.rule_id: r["count"] for r in result.findings.groupBy("rule_id").count().collect()}
    assert per == {"CAP": 10, "GRP": 2, "SET": 1, "STU": 1}
    assert {r.rule_id for r in result.skipped.collect()} == {"REF", "NOT", "TYP"}
    assert [tuple(r) for r in result.truncated.collect()] == [("CAP", "AE", 30, 10)]
    assert result.findings.filter("rule_id = 'STU'").first().Dataset == "STUDY"


def test_keyed_join_by_dialect(spark):
    ae = dataset(spark, "AE", "USUBJID string, X string", [("1", "a"), ("", "b"), ("9", "c")])
    dm = dataset(spark, "DM", "USUBJID string, X string, SEX string", [("1", "z", "F"), ("", "y", "M")])
    study = Study({"AE": ae, "DM": dm})
    spec = [{"Name": "DM", "Keys": ["USUBJID"]}]
    cdisc = match(ae.df, Rule("R", {}, match_datasets=spec), ae, study)
    assert sorted((r.X, r.SEX, r["DM.X"]) for r in cdisc.collect()) == [("a", "F", "z"), ("b", None, None), ("c", None, None)]
    core1 = match(ae.df, Rule("R", {}, match_datasets=spec, source="core_contributor"), ae, study)
    assert sorted((r.X, r.SEX) for r in core1.collect()) == [("a", "F"), ("b", "M")]


def test_supplemental_child_and_relrec(spark):
    ae = dataset(spark, "AE", "USUBJID string, AESEQ double, AETERM string", [("1", 1.0, "head"), ("1", 2.0, "arm")])
    supp = dataset(spark, "SUPPAE", "RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, QNAM string, QVAL string", [("AE", "1", "AESEQ", "2", "TRTEM", "Y"), ("AE", "1", "AESEQ", "1.0", "OTH", "q")])
    cm = dataset(spark, "CM", "USUBJID string, CMSEQ double, CMTRT string", [("1", 5.0, "aspirin")])
    rel = dataset(spark, "RELREC", "RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, RELID string", [("AE", "1", "AESEQ", "2", "A"), ("CM", "1", "CMSEQ", "5", "A")])
    study = Study({"AE": ae, "SUPPAE": supp, "CM": cm, "RELREC": rel})
    out = match(ae.df, Rule("R", {}, match_datasets=[{"Name": "SUPPAE"}]), ae, study)
    assert sorted((r.AETERM, r.OTH, r.TRTEM) for r in out.collect()) == [("arm", None, "Y"), ("head", "q", None)]
    out = match(supp.df, Rule("R", {}, match_datasets=[{"Name": "SUPP--", "Child": True}]), supp, study)
    assert sorted((r.QNAM, r.AETERM) for r in out.collect()) == [("OTH", "head"), ("TRTEM", "arm")]
    out = match(ae.df, Rule("R", {}, match_datasets=[{"Name": "RELREC"}]), ae, study)
    assert [(r.AETERM, r["RELREC.CMTRT"]) for r in out.collect()] == [("arm", "aspirin")]


def test_transport_files(spark, tmp_path):
    variables = [VariableMeta("DOMAIN", "Domain", "Char", 2), VariableMeta("X", "Value", "Num", 8), VariableMeta("T", "Text", "Char", 5)]
    rows = [("VS", 1.5, "é"), ("VS", None, ""), ("VS", -118.625, "abc"), ("VS", 1e-6, "z")]
    write_xpt(str(tmp_path / "vs.xpt"), "VS", variables, rows, "Vital Signs")
    study = api.read_study(spark, tmp_path)
    d = study.get("VS")
    got = [(r.DOMAIN, r.X, r["T"], r["__record"]) for r in d.df.orderBy("__record").collect()]
    assert [(a, c, n) for a, _, c, n in got] == [("VS", "é", 1), ("VS", "", 2), ("VS", "abc", 3), ("VS", "z", 4)]
    assert got[1][1] is None and [got[0][1], got[2][1]] == [1.5, -118.625] and got[3][1] == pytest.approx(1e-6)
    assert [v.label for v in d.variables] == ["Domain", "Value", "Text"]
    data = (tmp_path / "vs.xpt").read_bytes()
    (tmp_path / "vs.xpt").write_bytes(data[:-7])
    with pytest.raises(Exception, match="cut off"):
        api.read_study(spark, tmp_path)


def test_dataset_json(spark, tmp_path):
    columns = [{"name": "DOMAIN", "label": "D", "dataType": "string"}, {"name": "N", "label": "N", "dataType": "integer"}]
    (tmp_path / "ae.json").write_text(json.dumps({"name": "AE", "label": "x", "records": 2, "columns": columns, "rows": [["AE", 1], ["AE", None]]}))
    (tmp_path / "cm.ndjson").write_text("\n".join(json.dumps(x) for x in ({"name": "CM", "records": 2, "columns": columns}, ["CM", 1], ["CM", None])))
    study = api.read_study(spark, tmp_path)
    for name in ("AE", "CM"):
        assert [(r.DOMAIN, r.N, r["__record"]) for r in study.get(name).df.orderBy("__record").collect()] == [(name, 1.0, 1), (name, None, 2)]
    (tmp_path / "ae.json").write_text(json.dumps({"name": "AE", "records": 3, "columns": columns, "rows": []}))
    with pytest.raises(ValueError, match="declares 3"):
        api.read_study(spark, tmp_path)


DEFINE = """<ODM xmlns="http://www.cdisc.org/ns/odm/v1.3" xmlns:def="http://www.cdisc.org/ns/def/v2.1"><Study><MetaDataVersion>
<ItemGroupDef OID="IG.AE" Name="AE" Domain="AE" def:Class="EVENTS"><Description><TranslatedText>Adverse Events</TranslatedText></Description><ItemRef ItemOID="IT.SEV" Mandatory="Yes" KeySequence="1"/></ItemGroupDef>
<ItemDef OID="IT.SEV" Name="AESEV" DataType="text" Length="8"><CodeListRef CodeListOID="CL.SEV"/></ItemDef>
<CodeList OID="CL.SEV" Name="Severity"><EnumeratedItem CodedValue="MILD"/><EnumeratedItem CodedValue="ODD" def:ExtendedValue="Yes"/><Alias Name="C66769" Context="nci"/></CodeList>
<CodeList OID="CL.M" Name="M"><ExternalCodeList Dictionary="MedDRA" Version="26.0"/></CodeList></MetaDataVersion></Study></ODM>"""


def test_define(spark, tmp_path):
    (tmp_path / "define.xml").write_text(DEFINE)
    d = read_define(tmp_path / "define.xml")
    assert d["datasets"][0]["define_dataset_label"] == "Adverse Events" and d["variables"][0]["define_variable_ccode"] == "C66769"
    assert d["external_dictionaries"] == [{"dictionary": "MedDRA", "version": "26.0"}] and d["extended_terms"][0]["value"] == "ODD"
    ae = dataset(spark, "AE", "AESEV string, AEXX string", [("MILD", "1")])
    rule = Rule("R", {"all": [leaf("define_variable_name", "empty"), leaf("variable_name", "not_equal_to", "AESEV", value_is_literal=True)]}, rule_type="Variable Metadata Check against Define XML", output=["variable_name"], sensitivity="Record")
    out = run(spark, [rule], Study({"AE": ae}, define=d))
    assert [r.Value for r in out.findings.collect()] == ["AEXX"]


def test_usdm_tables():
    doc = {"usdmVersion": "4", "study": {"id": "S1", "instanceType": "Study", "versions": [{"id": "V1", "instanceType": "StudyVersion", "n": 1, "armIds": ["A1"], "arms": [{"id": "A1", "instanceType": "StudyArm", "code": {"id": "C", "instanceType": "Code", "text": "x"}}]}]}}
    t = flatten(doc)
    assert {r["rel_type"] for r in t["StudyArm"]} == {"definition", "reference"}
    assert t["StudyArm"][0]["parent_id"] == "V1" and t["Code"][0]["_path"].endswith("/arms/0/code")
    assert t["StudyArm"][0]["code.text"] == "x"


def test_damaged_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        api.read_study(spark, tmp_path / "none")
    (tmp_path / "x.csv").write_text("A,B\n1,2\n1,2,3\n")
    with pytest.raises(ValueError, match="row 3"):
        api.read_study(spark, tmp_path)
    df = spark.createDataFrame([("a", "b")], "X string, x string")
    with pytest.raises(ValueError, match="same"):
        api.open_dataset("AE", df)


def test_bare_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "dm.csv").write_text("DOMAIN,ID,AGE\nDM,007,40\nDM,012,\n")
    d = api.read_study(spark, tmp_path).get("DM")
    assert [(r.ID, r.AGE) for r in d.df.orderBy("__record").collect()] == [("007", 40.0), ("012", None)]


def test_value_table_folds_to_records_and_variables(spark):
    d = Dataset("AE", dataset(spark, "AE", "A string, B string", [("x", "long value"), ("", "y")]).df, [VariableMeta("A", "", "Char", 4), VariableMeta("B", "", "Char", 4)], domain_value="AE")
    rule = Rule("R", leaf("variable_value_length", "greater_than", "variable_size"), rule_type="Value Check with Variable Metadata")
    out = run(spark, [rule], Study({"AE": d}))
    assert [(r.Record, r.Variable, r.Value) for r in out.findings.collect()] == [(1, "B", "long value")]
