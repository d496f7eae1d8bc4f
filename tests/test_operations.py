from __future__ import annotations

import pytest

from lakewarden.model import Dataset, Library, Operation, RuleSkipped, Study
from lakewarden.plans.operations import OPERATIONS, set_difference

from .helpers import dataset, leaf, verdicts

T, F = True, False


def run(data: Dataset, check: dict, *ops: tuple, core1: bool = False, study: Study | None = None):
    study = study or Study({data.name: data})
    return verdicts(data.df, check, core1, [Operation(i, o, k) for i, o, k in ops], study, data)


def test_all_operations_are_there():
    assert len(OPERATIONS) == 42


def test_record_count_keeps_empty_groups(spark):
    ae = dataset(spark, "AE", "USUBJID string, AESEV string", [("1", "MILD"), ("1", "MILD"), ("2", "SEVERE")])
    assert run(ae, leaf("$n", "equal_to", 0), ("$n", "record_count", {"group": ["USUBJID"], "filter": {"AESEV": "MILD"}})) == [F, F, T]
    assert run(ae, leaf("$n", "equal_to", 3), ("$n", "record_count", {})) == [T, T, T]
    assert run(ae, leaf("$n", "equal_to", 2), ("$n", "record_count", {"filter": {"AESEV": "MI&"}})) == [T, T, T]


def test_distinct_of_another_dataset(spark):
    sv = dataset(spark, "SV", "VISIT string", [("A",), ("X",), ("",)])
    tv = dataset(spark, "TV", "VISIT string", [("A",), ("B",), ("",)])
    study = Study({"SV": sv, "TV": tv})
    assert run(sv, leaf("VISIT", "is_not_contained_by", "$v"), ("$v", "distinct", {"name": "VISIT", "domain": "TV"}), study=study) == [F, T, T]
    assert run(sv, leaf("$v", "contains_all", ["A", "B"]), ("$v", "distinct", {"name": "VISIT", "domain": "TV"}), study=study) == [T, F, F]


def test_extremes_and_dates(spark):
    ex = dataset(spark, "EX", "USUBJID string, D string, N double", [("1", "2024-02", 1.0), ("1", "2024-01-15", 3.0), ("2", "junk", None), ("2", "2023", 2.0)])
    assert run(ex, leaf("D", "equal_to", "$m"), ("$m", "max_date", {"name": "D", "group": ["USUBJID"]})) == [T, F, F, T]
    assert run(ex, leaf("D", "equal_to", "$m"), ("$m", "min_date", {"name": "D"})) == [F, F, F, T]
    assert run(ex, leaf("N", "equal_to", "$m"), ("$m", "max", {"name": "N"})) == [F, T, F, F]


def test_date_extremes_of_1_0_rules_are_texts(spark):
    def latest(*dates, name="max_date"):
        d = dataset(spark, "EX", "D string", [(x,) for x in dates])
        got = run(d, leaf("D", "equal_to", "$m"), ("$m", name, {"name": "D"}), core1=True)
        return [x for x, hit in zip(dates, got) if hit]

    assert latest("2024-01-15junk", "2024-13") == []
    assert latest("2014-01-05", "2014-02", "2014-01") == ["2014-02"]
    assert latest("2014-02", "2014-02-01", name="min_date") == ["2014-02"]
    assert latest("2023-02-30", "2022-01-01", "0000-01-01") == ["2022-01-01"]
    d = dataset(spark, "EX", "D string, E string", [("2011-01-14 00:00:00", "2011-01-14T00:00:00"), ("2011-01-13T10:-:-", ""), ("2010--15", "")])
    assert run(d, leaf("E", "equal_to", "$m"), ("$m", "max_date", {"name": "D"}), core1=True) == [T, F, F]


def test_study_day_has_no_zero(spark):
    vs = dataset(spark, "VS", "USUBJID string, VSDTC string, VSDY double", [("1", "2024-01-01", 1.0), ("1", "2023-12-31", -1.0), ("1", "2024-01-03T10:00", 3.0), ("2", "2024-01-01", None)])
    dm = dataset(spark, "DM", "USUBJID string, RFSTDTC string", [("1", "2024-01-01")])
    study = Study({"VS": vs, "DM": dm})
    assert run(vs, leaf("VSDY", "equal_to", "$d"), ("$d", "dy", {"name": "--DTC"}), study=study) == [T, T, T, F]


def test_sets_of_values():
    assert set_difference(["a", "b", "c", "d"], ["c", "b"]) == ["a", "b", "d"]
    assert set_difference(["a", "b", "b"], ["a"], plain=True) == ["b", "b"]


def test_minus_intersect_map_and_columns(spark):
    d = dataset(spark, "AE", "A string, B string", [("A", "1"), ("Q", "2")])
    order = ("$c", "get_column_order_from_dataset", {})
    assert run(d, leaf("A", "is_contained_by", "$m"), order, ("$m", "intersect", {"name": "$c", "subtract": ["A", "Z"]})) == [T, F]
    assert run(d, leaf("A", "is_contained_by", "$m"), order, ("$m", "minus", {"name": "$c", "subtract": ["A"]})) == [F, F]
    assert run(d, leaf("$m", "equal_to", "two", value_is_literal=True), ("$m", "map", {"map": [{"A": "Q", "output": "two"}]})) == [F, T]
    assert run(d, leaf("$n", "equal_to", 1), ("$n", "variable_count", {"name": "A"})) == [T, T]


def library() -> Library:
    guide = [{"standard": "SDTMIG", "version": "3-4", "domain": "AE", "variable": v, "label": v.title(), "role": r, "type": "Char", "core": c, "ordinal": i} for i, (v, r, c) in enumerate([("STUDYID", "Identifier", "Req"), ("AETERM", "Topic", "Req"), ("AESEV", "Qualifier", "Exp"), ("AESTDTC", "Timing", "Exp")])]
    model = [{"class": c, "variable": v, "label": v, "role": "", "type": "Char", "ordinal": i} for i, (c, v) in enumerate([("Identifiers", "STUDYID"), ("Events", "--TERM"), ("Events", "--SEV"), ("Timing", "--STDTC"), ("Timing", "--DY")])]
    lists = [{"package": "sdtmct-2024-03-29", "codelist_code": "C1", "codelist": "SEV", "extensible": "False", "terms": [("T1", "MILD", "Mild", ["light"]), ("T2", "SEVERE", "Severe", [])]}]
    return Library(guide, model, {"AE": "Events"}, [{"standard": "SDTMIG", "version": "3.4", "domain": "AE", "label": "Adverse Events"}], lists, [{"package_type": "SDTM", "package_date": "2024-03-29"}], [{"code": "FR"}])


@pytest.mark.parametrize(("operation", "options", "member", "absent"), [
    ("required_variables", {}, "AETERM", "AESEV"), ("expected_variables", {}, "AESEV", "AETERM"), ("get_model_column_order", {}, "AEDY", "AEXX"), ("get_column_order_from_library", {}, "AESTDTC", "X"),
    ("standard_domains", {}, "AE", "ZZ"), ("codelist_terms", {"codelists": ["SEV"]}, "MILD", "T1"), ("get_codelist_attributes", {"ct_attribute": "Term CCODE"}, "T2", "MILD"),
    ("valid_codelist_dates", {"ct_package_types": ["SDTM"]}, "2024-03-29", "2020"), ("get_countries", {}, "FR", "DE"), ("get_model_filtered_variables", {}, "AETERM", "X"), ("get_dataset_filtered_variables", {}, "AESEV", "AEDY"),
    ("dataset_names", {}, "AE", "DM"), ("study_domains", {}, "AE", "DM"),
])
def test_metadata_sets(spark, operation, options, member, absent):
    ae = dataset(spark, "AE", "STUDYID string, AESEV string, probe string", [("1", "x", member), ("1", "x", absent)])
    study = Study({"AE": ae}, product="SDTMIG", version="3-4", ct_package="sdtmct-2024-03-29", library=library())
    assert run(ae, leaf("probe", "is_contained_by", "$v"), ("$v", operation, options), study=study) == [T, F]


def test_metadata_scalars(spark):
    ae = dataset(spark, "AE", "AESEV string, VER string, CODE string", [("Mild", "2024-03-29", "C1"), ("x", "1999", "C1")])
    study = Study({"AE": ae}, product="SDTMIG", version="3.4", ct_package="sdtmct-2024-03-29", library=library())
    assert run(ae, leaf("$v", "equal_to", "Adverse Events", value_is_literal=True), ("$v", "domain_label", {}), study=study) == [T, T]
    assert run(ae, leaf("$v", "equal_to", False), ("$v", "domain_is_custom", {}), study=study) == [T, T]
    assert run(ae, leaf("$v", "equal_to", False), ("$v", "codelist_extensible", {"version": "VER", "codelist_code": "CODE"}), study=study) == [T, F]  # unknown is blank, and blank equals nothing
    assert run(ae, leaf("$v", "equal_to", "AE", value_is_literal=True), ("$v", "extract_metadata", {"name": "dataset_name"}), study=study) == [T, T]
    with pytest.raises(RuleSkipped, match="dictionary"):
        run(ae, leaf("$v", "equal_to", "x"), ("$v", "get_external_dictionary_version", {}), study=study)
    with pytest.raises(RuleSkipped, match="terminology"):
        run(ae, leaf("$v", "empty"), ("$v", "codelist_terms", {}), study=Study({"AE": ae}))


def test_xhtml_errors_per_cell(spark):
    d = dataset(spark, "NC", "text string", [("<p>ok</p>",), ("<p>bad",), ("",)])
    assert run(d, leaf("$e", "non_empty"), ("$e", "get_xhtml_errors", {"name": "text"})) == [F, T, F]
