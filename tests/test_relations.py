"""Sets of a dataset as relations: no task gathers one, and nothing is cut."""

from __future__ import annotations

from lakewarden import api, queries
from lakewarden.model import Dataset, Operation, Rule, Study
from lakewarden.results import binding_gaps, binding_sets
from lakewarden.runner import run
from tests.helpers import dataset, frame, leaf, verdicts

SF = "/root/testdata/sf0.001"
T, F = True, False


def test_set_operations_gather_nothing(spark):
    for name in ("op_minus", "op_intersect"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "collect_set" not in plan and "collect_list" not in plan and "array_except" not in plan and "array_intersect" not in plan


def test_relations_in_conditions(spark):
    a = dataset(spark, "AE", "V string, S string", [("a", "a;b"), ("B", "c;x"), ("c", "")])
    study = Study({"AE": a, "TV": dataset(spark, "TV", "V string, W string, N string", [("a", "b", "10"), ("b", "c", "9"), ("c", "O'x", "")])})
    v, w, none = (Operation(f"${k}", "distinct", {"name": n, "domain": "TV", **more}) for k, n, more in (("v", "V", {}), ("w", "W", {}), ("none", "V", {"filter": {"W": "zz"}})))
    s = Operation("$s", "split_by", {"name": "S", "delimiter": ";"})

    def of(check, *ops, core1=False):
        return verdicts(a.df, check, core1, list(ops), study, a)

    minus, both = Operation("$m", "minus", {"name": "$v", "subtract": "$w"}), Operation("$i", "intersect", {"name": "$v", "subtract": "$w"})
    assert of(leaf("V", "is_contained_by", "$m"), v, w, minus) == [T, F, F]
    assert of(leaf("V", "is_contained_by", "$i"), v, w, both) == [F, F, T]
    assert of(leaf("V", "is_contained_by_case_insensitive", "$i"), v, w, both) == [F, T, T]
    assert of(leaf("V", "is_contained_by", "$m"), v, Operation("$m", "minus", {"name": "$v", "subtract": ["a", "zz"]})) == [F, F, T]
    assert of(leaf("V", "is_contained_by", "$m"), v, Operation("$m", "minus", {"name": ["a", "zz"], "subtract": "$v"})) == [F, F, F]
    assert of(leaf("$m", "empty"), v, none, Operation("$m", "minus", {"name": "$none", "subtract": "$v"})) == [T, T, T]
    assert of(leaf("$m", "non_empty"), v, none, Operation("$m", "minus", {"name": "$v", "subtract": "$none"})) == [T, T, T]
    assert of(leaf("$v", "shares_no_elements_with", "$w"), v, w) == [F, F, F] and of(leaf("$m", "shares_no_elements_with", "$w"), v, w, minus) == [T, T, T]
    # A record's own set beside a relation.
    assert of(leaf("$s", "is_contained_by", "$v"), s, v) == [T, T, F] and of(leaf("$s", "is_contained_by", "$v"), s, v, core1=True) == [T, F, F]
    assert of(leaf("$s", "shares_no_elements_with", "$i"), s, v, w, both) == [F, F, T] and of(leaf("V", "shares_no_elements_with", "$m"), v, w, minus) == [F, T, T]
    assert of(leaf("$v", "contains_all", "$s"), s, v) == [T, F, T] and of(leaf("$s", "contains_all", "$m"), s, v, w, minus) == [T, F, F]
    assert of(leaf("a", "equal_to", "$m") | {"name": "$m", "operator": "non_empty"}, s, v, Operation("$m", "minus", {"name": "$s", "subtract": "$v"})) == [F, T, F]
    assert of({"name": "$m", "operator": "non_empty"}, s, v, Operation("$m", "intersect", {"name": "$s", "subtract": "$v"})) == [T, T, F]
    # The largest of a set's members: by value where all are numbers.
    assert of(leaf("$x", "equal_to", "10", value_is_literal=True), Operation("$n", "distinct", {"name": "N", "domain": "TV"}), Operation("$x", "max", {"name": "$n"})) == [T, T, T]


def _gap_rule(**more):
    ops = [Operation("$wanted", "distinct", {"name": "N", "domain": "TV"}), Operation("$dataset_names", "distinct", {"name": "N"})]
    return Rule("R", leaf("$dataset_names", "not_contains_all", "$wanted"), sensitivity="Dataset", operations=ops, output=["$wanted", "$dataset_names"], **more)


def test_gaps_beyond_a_thousand_members_and_with_apostrophes(spark):
    wanted = [(f"O'Brien, {i}",) for i in range(5000)]
    s = Study({"AE": dataset(spark, "AE", "N string", [x for i, x in enumerate(wanted) if i % 50]), "TV": dataset(spark, "TV", "N string", wanted)})
    out = run(spark, [_gap_rule()], s, only=["AE"])
    assert sorted(r.member for r in binding_gaps(out).collect()) == sorted(f"O'Brien, {i}" for i in range(0, 5000, 50))
    assert {r.label for r in binding_gaps(out).collect()} == {"wanted"}
    assert binding_sets(out)[1].filter("Variable = '$wanted'").count() == 5000
    assert "missing wanted: O'Brien, 0, " in api.report_text(out) and "(100 in all)" in api.report_text(out)
    out.release()


def test_gaps_of_one_missing_set_and_of_sets_per_record(spark):
    d = dataset(spark, "AE", "S string", [("a;b",), ("a;b",)])
    split = Operation("$missing_parts", "split_by", {"name": "S", "delimiter": ";"})
    out = run(spark, [Rule("R", leaf("S", "non_empty"), operations=[split], output=["$missing_parts"])], Study({"AE": d}))
    assert sorted(tuple(r) for r in binding_gaps(out).collect()) == [("R", "AE", "parts", "a"), ("R", "AE", "parts", "b")]
    other = dataset(spark, "AE", "S string", [("a;b",), ("c",)])
    out = run(spark, [Rule("R", leaf("S", "non_empty"), operations=[split], output=["$missing_parts"])], Study({"AE": other}))
    assert binding_gaps(out).count() == 0
    plain = Dataset("AE", frame(spark, "S string", [("x",)]))
    assert binding_gaps(run(spark, [Rule("R", leaf("S", "empty"))], Study({"AE": plain}))).count() == 0


def test_a_pass_carries_no_text_of_a_set_of_the_dataset(spark):
    wanted = [(f"name {i}",) for i in range(1500)]
    s = Study({"AE": dataset(spark, "AE", "N string", wanted), "TV": dataset(spark, "TV", "N string", wanted)})
    rule = Rule("R", leaf("N", "is_contained_by", "$wanted"), operations=[Operation("$wanted", "distinct", {"name": "N", "domain": "TV"})], output=["N", "$wanted"])
    out = run(spark, [rule], s, None, ["AE"])
    assert out.info["passes"][0].selectExpr("max(length(to_json(values)))").first()[0] < 200
    texts = out.findings.filter("Variable = '$wanted'")
    assert texts.count() == 1500 and texts.select("Value").distinct().count() == 1
    text = texts.first().Value
    assert text.startswith("['name 0', 'name 1', 'name 10', ") and text.endswith(", ... (1500 in all)]") and text.count("'") == 2000
    assert {r.Value for r in out.findings.filter("Variable = 'N'").collect()} == {w[0] for w in wanted}
    out.release()
