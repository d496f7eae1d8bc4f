"""The expression language, and rules over a document."""

from __future__ import annotations

import json

import pytest

from lakewarden.functions.jsonata import NOTHING, JsonataError, evaluate
from lakewarden.model import Dataset, Rule, RuleSkipped, Study
from lakewarden.plans.document import found, parse_refs, results, sift_tree, with_paths
from lakewarden.runner import run
from lakewarden.sources.usdm import flatten, read_usdm

from .helpers import frame, leaf

SHOP = {
    "name": "Shop", "open": True, "closed": None, "site": {"street": "High", "town": "Ayr"},
    "orders": [
        {"id": "o1", "lines": [{"sku": "a", "n": 2, "price": 3.5, "tags": ["x", "y"]}, {"sku": "b", "n": 1, "price": 10}]},
        {"id": "o2", "lines": [{"sku": "a", "n": 4, "price": 3.5, "tags": ["x"]}, {"sku": "c", "n": 1, "price": 7.25}]},
        {"id": "o3", "lines": []},
    ],
}
CASES = [
    ("name", "Shop"), ("nothing", NOTHING), ("site.town", "Ayr"), ("closed", None), ("orders.id", ["o1", "o2", "o3"]), ("orders[0].id", "o1"), ("orders[-1].id", "o3"), ("orders.lines[0].sku", ["a", "a"]),
    ("(orders.lines)[0].sku", "a"), ("orders[[0..1]].id", ["o1", "o2"]), ("orders.lines[sku='b'].price", 10), ("orders.lines[price > 3 and n < 3].sku", ["a", "b", "c"]), ("site.*", ["High", "Ayr"]), ("*.town", "Ayr"),
    ("**.sku", ["a", "b", "a", "c"]), ("orders.lines.tags", ["x", "y", "x"]), ("orders.lines.[tags]", [["x", "y"], [], ["x"], []]), ("orders.lines{sku: $sum(n)}", {"a": 6, "b": 1, "c": 1}), ("orders.lines{sku: n[]}", {"a": [2, 4], "b": [1], "c": [1]}),
    ("orders.lines.{sku: n}", [{"a": 2}, {"b": 1}, {"a": 4}, {"c": 1}]), ("$sum(orders.lines.(n * price))", 38.25), ("orders.lines^(>price, sku).sku", ["b", "c", "a", "a"]), ("orders.lines.%.id", ["o1", "o1", "o2", "o2"]),
    ("orders.lines[sku='c'].{'o': %.id, 's': %.%.name}", {"o": "o2", "s": "Shop"}), ("orders#$i.lines[n=1].{'i': $i, 's': sku}", [{"i": 0, "s": "b"}, {"i": 1, "s": "c"}]), ("orders@$o.$o.lines[sku='a'].{'o': $o.id, 'n': n}", [{"o": "o1", "n": 2}, {"o": "o2", "n": 4}]),
    ("name & ' ' & site.town & nothing", "Shop Ayr"), ("1 + 2 * 3 - 4 / 2", 5), ("7 % 4", 3), ("-(2 + 3)", -5), ("[1..4].($ * 2)", [2, 4, 6, 8]), ("[]", []), ("{}", {}), ("[1, [2, 3], 4]", [1, [2, 3], 4]), ("(1; 2; 3)", 3),
    ("open ? 'y' : 'n'", "y"), ("nothing ? 1", NOTHING), ("nothing ?? 'd'", "d"), ("'' ?: 'e'", "e"), ("'a' in ['a', 'b']", True), ("nothing = nothing", False), ("{'a': [1, 2]} = {'a': [1, 2]}", True), ("1 = true", False), ("1 < nothing", NOTHING),
    ("($f := function($n) { $n < 2 ? 1 : $n * $f($n - 1) }; $f(6))", 720), ("($add := function($a, $b) { $a + $b }; $two := $add(?, 2); $two(5))", 7), ("('a b' ~> $split(' ') ~> $join('-'))", "a-b"), ("($up := $uppercase ~> $trim; $up(' x '))", "X"),
    ("$map([1, 2, 3], function($v, $i) { $v * $i })", [0, 2, 6]), ("$filter([1..6], function($v) { $v % 2 = 0 })", [2, 4, 6]), ("$reduce([1..4], function($a, $b) { $a * $b })", 24), ("$sort([3, 1, 2], function($a, $b) { $a < $b })", [3, 2, 1]),
    ("$each(site, function($v, $k) { $k & '=' & $v })", ["street=High", "town=Ayr"]), ("$sift(site, function($v, $k) { $k = 'town' })", {"town": "Ayr"}), ("site.$keys()", ["street", "town"]), ("$merge([{'a': 1}, {'b': 2}])", {"a": 1, "b": 2}),
    ("$distinct(orders.lines.sku)", ["a", "b", "c"]), ("$count(nothing)", 0), ("$exists(closed)", True), ("$type(closed)", "null"), ("$not(open)", False), ("$string(5.0)", "5"), ("$string({'a': [1, 2.5, null]})", '{"a":[1,2.5,null]}'), ("$number('12.5')", 12.5),
    ("$contains('abc', /B/i)", True), ("$replace('ab12', /([a-z]+)(\\d+)/, '$2-$1')", "12-ab"), ("$match('a1b22', /\\d+/).match", ["1", "22"]), ("$split('a1b2c', /\\d/)", ["a", "b", "c"]), ("$substring('hello', 1, 3)", "ell"), ("$substringAfter('a:b', ':')", "b"),
    ("$pad('x', -3, '0')", "00x"), ("$round(2.5)", 2), ("$round(3.14159, 2)", 3.14), ("$max(orders.lines.price)", 10), ("$average([1, 2])", 1.5), ("$zip([1, 2], [3, 4])", [[1, 3], [2, 4]]), ("$lookup(site, 'town')", "Ayr"), ("$single(orders[id='o2']).id", "o2"),
    ("$append([1], 2)", [1, 2]), ("$reverse([1, 2])", [2, 1]), ("$spread({'a': 1, 'b': 2})", [{"a": 1}, {"b": 2}]), ("$boolean([0, 1])", True), ("`name`", "Shop"), ("/* note */ 1 /* more */ + 1", 2), ("$toMillis('1970-01-02T00:00:00Z')", 86400000),
    ("site ~> |$|{'zip': 1}, 'street'|", {"town": "Ayr", "zip": 1}), ("$$.name", "Shop"),
]


@pytest.mark.parametrize(("expression", "want"), CASES)
def test_expression(expression, want):
    got = evaluate(expression, SHOP)
    assert got is want if want is NOTHING else (got == want and type(got) in (type(want), int, float) or list(got) == want)


@pytest.mark.parametrize("expression", ["a.[", "1 +", "a b", "$none(1)", "'a' < 1", "{1: 2}", "1 + 'a'", "$error('no')", "'unclosed", "1 / 0", "($f := function($x) { $f($x) }; $f(1))"])
def test_what_cannot_be_evaluated_is_told(expression):
    with pytest.raises(JsonataError):
        evaluate(expression, {"a": 1})


def test_results_carry_paths():
    doc = json.dumps({"a": {"b": [{"x": 1}, {"x": 2}]}})
    assert results("a.b.{'at': _path, 'x': x}", doc) == [{"at": "/a/b/0", "x": 1}, {"at": "/a/b/1", "x": 2}]
    assert results("a.b[x = 9]", doc) == [] and results("a.b[0].x", doc) == [1]
    assert with_paths([{"k": {}}]) == [{"k": {"_path": "/0/k"}, "_path": "/0"}]
    for bad in (({"not": "text"}, doc), ("$.a[", doc), ("$.a", "{no json")):
        with pytest.raises(RuleSkipped):
            results(*bad)


def test_utilities():
    tree = {"instanceType": "T", "id": 1, "keep": {"v": "hit", "w": 2}, "drop": {"v": "miss"}, "list": [{"v": "hit"}, {"v": "miss"}]}
    assert sift_tree(tree, "hit", ["id"]) == {"id": 1, "keep": {"v": "hit"}, "list": [{"v": "hit"}]}
    assert sift_tree(tree, "hit", "id", True) == {"T.id": 1, "T.keep": {"v": "hit"}, "T.list": [{"v": "hit"}]}
    assert sift_tree({"a": 1}, "hit", []) is NOTHING
    items = [{"id": "a", "refs": ["b", "c"]}, {"id": "b", "refs": "c"}, {"id": "c"}, {"id": "d", "refs": ["d"]}]
    out = parse_refs("refs", "to", items)
    assert out[0] == {"id": "a", "to": [{"id": "b", "to": {"id": "c"}}, {"id": "c"}]} and out[3] == {"id": "d", "to": {"circularReference": "d"}} and "refs" in items[0]


DOCUMENT = {"usdmVersion": "4.0", "study": {"id": "S", "instanceType": "Study", "arms": [{"id": "A1", "instanceType": "StudyArm", "label": "one"}, {"id": "A2", "instanceType": "StudyArm", "label": "", "tags": ["x", True]}]}}


def test_rules_over_a_document(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(DOCUMENT))
    study = read_usdm(spark, tmp_path / "s.json")
    rules = [
        Rule("J1", "study.arms[label = ''].{'instanceType': instanceType, 'path': _path, 'id': id, 'tags': tags}", "JSONata", output=["id", "tags", "gone"], message="A label is required"),
        Rule("J2", "study.arms.{'entity': 'Nowhere', 'id': id}", "JSONata"), Rule("J3", "$.a[", "JSONata"), Rule("J4", "study.arms[id = 'zz']", "JSONata"),
    ]
    out = run(spark, rules, study)
    rows = sorted((r.rule_id, r.Dataset, r.Record, r.Variable, r.Value, r.triage) for r in out.findings.collect() if r.rule_id == "J1")
    assert rows == [("J1", "STUDYARM", 2, "gone", "", "wrong value"), ("J1", "STUDYARM", 2, "id", "A2", "wrong value"), ("J1", "STUDYARM", 2, "tags", "x, TRUE", "wrong value")]
    assert {(r.Dataset, r.Record, r.Value) for r in out.findings.collect() if r.rule_id == "J2"} == {("NOWHERE", None, "A1"), ("NOWHERE", None, "A2")}
    assert [r.rule_id for r in out.skipped.collect()] == ["J3"] and {r for r, _ in out.info["ran"]} == {"J1", "J2", "J4"}


def test_tabular_studies_have_no_document(spark):
    study = Study({"AE": Dataset("AE", frame(spark, "A string", [("x",)]))})
    with pytest.raises(RuleSkipped, match="USDM"):
        found(Rule("J", "$", "JSONata"), study)
    out = run(spark, [Rule("J", "$", "JSONata"), Rule("R", leaf("A", "empty"))], study)
    assert [r for r, _ in out.info["ran"]] == ["R"] and out.skipped.count() == 0


def test_entities_by_a_map():
    doc = {"study": {"id": "S", "codes": [{"id": "C", "instanceType": "code"}], "thing": {"id": "T"}}}
    assert set(flatten(doc)) == {"Wrapper", "study", "Code", "thing"}
    assert set(flatten(doc, {"study": "Study", "thing": "Item"})) == {"Wrapper", "Study", "Code", "Item"}
