from __future__ import annotations

import pytest

from lakewarden.model import Dataset, MissingColumn, Operation, RuleSkipped, Study
from lakewarden.operators import OPERATORS

from .helpers import frame, leaf, verdicts

T, F, N = True, False, None


def test_all_operators_are_registered():
    assert len(OPERATORS) == 115


def test_equality_and_blanks(spark):
    df = frame(spark, "a string, b string, n double", [("x", "x", 1.0), ("x", "", 2.0), ("", "x", None), ("", "", None), ("200.00", "200", 200.0)])
    assert verdicts(df, leaf("a", "equal_to", "b")) == [T, F, F, F, F]
    assert verdicts(df, leaf("a", "not_equal_to", "b")) == [F, T, T, F, T]
    assert verdicts(df, leaf("a", "equal_to", "b", type_insensitive=True)) == [T, F, F, F, T]
    assert verdicts(df, leaf("a", "equal_to", "n")) == [F, F, F, F, F]  # text is never a number
    assert verdicts(df, leaf("a", "equal_to", "n", type_insensitive=True)) == [F, F, F, F, T]
    assert verdicts(df, leaf("a", "not_equal_to", "y", value_is_literal=True)) == [T, T, T, T, T]
    with pytest.raises(RuleSkipped, match="CORE 1.0 cannot"):
        verdicts(df, leaf("a", "equal_to", "n"), core1=True)


def test_references(spark):
    df = frame(spark, "r string, a string, b string", [("a", "1", "2"), ("b", "1", "1"), ("zz", "1", "1")])
    assert verdicts(df, leaf("a", "equal_to", "r", value_is_reference=True)) == [T, T, F]
    assert verdicts(df, leaf("a", "not_equal_to", "r", value_is_reference=True), core1=True) == [F, F, F]


def test_order_needs_numbers(spark):
    df = frame(spark, "a string, b string", [("9", "10"), ("BLQ", "1"), ("3", "x")])
    assert verdicts(df, leaf("a", "less_than", "b")) == [T, F, F]
    assert verdicts(df, leaf("a", "greater_than_or_equal_to", 3)) == [T, F, T]
    assert verdicts(df, leaf("a", "less_than", "LOD")) == [N, N, N]  # undecided: the rule is refused later


def test_missing_columns_by_dialect(spark):
    df = frame(spark, "a string", [("x",), ("",)])
    with pytest.raises(MissingColumn):
        verdicts(df, {"all": [leaf("a", "empty"), leaf("zz", "empty")]})
    assert verdicts(df, {"any": [leaf("a", "empty"), leaf("zz", "empty")]}) == [F, T]
    assert verdicts(df, {"all": [leaf("a", "empty"), leaf("zz", "empty")]}, core1=True) == [F, F]
    assert verdicts(df, {"not": leaf("zz", "exists")}) == [T, T]
    with pytest.raises(RuleSkipped, match="empty"):
        verdicts(df, {"all": []})


def test_regex_dialects(spark):
    df = frame(spark, "a string", [("abc",), ("xabc",), ("",)])
    assert verdicts(df, leaf("a", "matches_regex", "ab")) == [T, F, F]
    assert verdicts(df, leaf("a", "matches_regex", "ab"), core1=True) == [T, T, F]
    assert verdicts(df, leaf("a", "not_matches_regex", "ab")) == [F, T, F]


def test_enumerated_columns(spark):
    df = frame(spark, "v string, v1 string, v2 string", [("a", "", "b"), ("a", "b", ""), ("", "", ""), ("", "b", "")])
    assert verdicts(df, leaf("v", "inconsistent_enumerated_columns")) == [T, F, F, T]


DATES = [
    ("2024-03-15", T), ("2024-03", T), ("2024", T), ("2024---15", T), ("2023-02-30", F), ("2024-02-29", T), ("1900-02-29", F), ("2003-20", F), ("-", F), ("0000-01-01", F), ("2024-03-15T-", F),
    ("2024-03-15T10:30", T), ("2024-03-15T10:30:15.5Z", T), ("2024-03-15/2024-04", T), ("--03-15", T), ("2024-13-01", F), ("", F), ("-----T10:30", T),
]


def test_partial_dates(spark):
    df = frame(spark, "d string", [(d,) for d, _ in DATES])
    assert verdicts(df, leaf("d", "invalid_date")) == [not ok for _, ok in DATES]


def test_date_comparison_by_precision_and_zone(spark):
    rows = [("2024-03", "2024-03-15"), ("2024-03-15", "2024-03-15"), ("2024-03-15T23:30:00-02:00", "2024-03-16"), ("2024-03-14", "2024-03-15"), ("junk", "2024"), ("", "")]
    df = frame(spark, "a string, b string", rows)
    assert verdicts(df, leaf("a", "date_equal_to", "b")) == [F, T, F, F, F, F]
    assert verdicts(df, leaf("a", "date_greater_than_or_equal_to", "b")) == [T, T, T, F, F, F]
    assert verdicts(df, leaf("a", "date_not_equal_to", "b")) == [T, F, T, T, T, F]
    assert verdicts(df, leaf("a", "date_less_than", "b")) == [F, F, F, T, F, F]


@pytest.mark.parametrize(("text", "cdisc", "core1"), [
    ("P1Y", F, F), ("P1Y,2M", F, F), ("P1.5Y2M", T, F), ("P1Y1.5M", F, F), ("PT", T, T), ("P", T, T), ("-P1D", F, T), ("P3W", F, F), ("P1DT2H", F, F), ("PT1.5.2H", T, T), ("", T, T),
])
def test_durations(spark, text, cdisc, core1):
    df = frame(spark, "d string", [(text,)])
    assert verdicts(df, leaf("d", "invalid_duration")) == [cdisc]
    assert verdicts(df, leaf("d", "invalid_duration"), core1=True) == [core1]


def test_unique_sets_group_blanks(spark):
    df = frame(spark, "a string, b string", [("x", ""), ("x", None), ("y", "1"), ("y", "2")])
    assert verdicts(df, leaf("a", "is_not_unique_set", ["b"])) == [T, T, F, F]
    assert verdicts(df, leaf("zz", "is_unique_set", ["b"]), core1=True) == [F, F, F, F]


def test_unique_sets_span_split_files(spark):
    a, b = (Dataset(n, frame(spark, "a string", rows), domain_value="LB") for n, rows in (("LB1", [("x",), ("y",)]), ("LB2", [("x",)])))
    study = Study({"LB1": a, "LB2": b})
    assert verdicts(a.df, leaf("a", "is_not_unique_set", ["a"]), study=study, data=a) == [T, F]


def test_relationships(spark):
    df = frame(spark, "c string, d string", [("1", "a"), ("1", "b"), ("2", "c"), ("3", "c"), ("4", "e"), ("", ""), ("5", "f"), ("5", "")])
    assert verdicts(df, leaf("c", "is_not_unique_relationship", "d")) == [T, T, T, T, F, F, T, T]


def test_consistency_and_same_values(spark):
    df = frame(spark, "g string, v string", [("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("b", "")])
    assert verdicts(df, leaf("v", "is_inconsistent_across_dataset", ["g"])) == [F, F, T, T, T]
    assert verdicts(df, leaf("v", "is_inconsistent_across_dataset", ["g"], where_populated=True)) == [F, F, T, T, F]
    assert verdicts(df, leaf("v", "has_same_values")) == [F] * 5


def test_next_record_and_last_row(spark):
    rows = [("s", "2", "b", "c"), ("s", "10", "c", "z"), ("s", "1", "a", "b"), ("t", "1", "", "")]
    df = frame(spark, "u string, o string, e string, nxt string", rows)
    assert verdicts(df, leaf("nxt", "does_not_have_next_corresponding_record", "e", within="u", ordering="o")) == [F, F, F, F]
    assert verdicts(df, leaf("e", "empty_within_except_last_row", "u", ordering="o")) == [F, F, F, F]


def test_sorted_by_with_blanks_ties_and_overlaps(spark):
    def run(rows, **more):
        df = frame(spark, "u string, s double, d string", rows)
        return verdicts(df, leaf("s", "target_is_not_sorted_by", [{"name": "d", **more}], within="u"))

    assert run([("a", 1.0, "2024-01-01"), ("a", 2.0, "2024-01-02"), ("a", 3.0, "2024-01-03")]) == [F, F, F]
    assert run([("a", 1.0, "2024-01-02"), ("a", 2.0, "2024-01-01"), ("a", 3.0, "2024-01-03")]) == [T, T, F]
    assert run([("a", 1.0, ""), ("a", 2.0, "2024-01-02")]) == [T, F]
    assert run([("a", 1.0, ""), ("a", 2.0, "2024-01-02")], null_position="first") == [F, F]
    assert run([("a", 1.0, "2024-01"), ("a", 2.0, "2024-01-02")]) == [T, T]
    assert run([("a", 1.0, "2024-01-03"), ("a", 2.0, "2024-01-02")], sort_order="desc") == [F, F]
    assert run([(None, 1.0, "2024-01-03"), (None, 2.0, "2024-01-02")]) == [F, F]


def test_ordered_set(spark):
    df = frame(spark, "g string, v string", [("a", "1"), ("a", "10"), ("a", "9"), ("b", "1"), ("b", ""), ("b", "2")])
    assert verdicts(df, leaf("v", "is_not_ordered_set", "g")) == [T, T, T, T, F, T]  # from 1 to a blank is a step down
    assert verdicts(df, leaf("v", "is_ordered_set", "g")) == [F, F, F, F, F, F]
    up = frame(spark, "g string, v double", [("a", 1.0), ("a", None), ("a", 0.5), ("b", 1.0), ("b", 10.0)])
    assert verdicts(up, leaf("v", "is_not_ordered_set", "g")) == [F, F, F, F, F]  # a missing number is not compared
    assert verdicts(up, leaf("v", "is_not_ordered_set")) == [F] * 5
    assert verdicts(frame(spark, "v string", [("2",), ("10",), ("9",)]), leaf("v", "is_not_ordered_set")) == [T, T, T]
    with pytest.raises(RuleSkipped, match="zz"):
        verdicts(df, leaf("v", "is_not_ordered_set", ["g", "zz"]))


def test_intervals_are_those_of_1_0_rules(spark):
    rows = {"2023-01-01/2023-02-01": F, "2023-01/2023-02": F, "2023-01-01/P1D": F, "P1D/2023-01-01": F, "2023-01-01/-P1D": T, "P1D/P1D": T, "2023---15/2023": T, "2023": T, "": T, "2023/2024/2025": T, "2023-01-01/": T}
    df = frame(spark, "d string", [(d,) for d in rows])
    assert verdicts(df, leaf("d", "invalid_date_interval"), core1=True) == list(rows.values())
    assert verdicts(df, leaf("d", "invalid_date_interval")) == list(rows.values())


def test_dates_of_1_0_rules(spark):
    good = ["2024", "-2024", "2024-12", "2024--", "2024-05--", "2024-01/2024-02", "2024-01-01/2024-02-01", "2024-02-29", "2024-01-15T10:30", "2024-01-15T10:30:15.25+0130", "2024-01-15T10:30Z"]
    bad = ["", "2024-", "2024-05-", "2024-13", "2024-02-30", "2023-02-29", "2024-01-15T10", "2024-01-15T24:00", "2024-01-15T10:60", "2024-01-15T-:30", "2024-00-10", "-2024-01-15", "2024/2025", "x", "2024-01-32"]
    df = frame(spark, "d string", [(d,) for d in good + bad])
    assert verdicts(df, leaf("d", "invalid_date"), core1=True) == [F] * len(good) + [T] * len(bad)


def test_date_components_of_1_0_rules(spark):
    df = frame(spark, "a string, b string", [("2014-01-20", "2014-01-21"), ("2014-01-20 10:00", "2014-01-20T10:30"), ("2014-01-20T10:00junk", "2014-01-20"), ("", ""), ("2014-01", "2014-01-20")])

    def run(operator, **more):
        return verdicts(df, leaf("a", operator, "b", **more), core1=True)

    assert run("date_equal_to", date_component="hour") == [F, T, F, F, F]
    assert run("date_equal_to", date_component="month") == [T, T, T, F, T]
    assert run("date_equal_to", date_component="microsecond") == [F] * 5
    assert run("date_equal_to") == [F, F, F, F, T]
    assert run("date_less_than") == [T, T, F, F, F]
    with pytest.raises(RuleSkipped, match="century"):
        run("date_equal_to", date_component="century")


def test_order_by_sort_columns_of_1_0_rules(spark):
    def run(rows, schema="u string, s string, d string", **more):
        return verdicts(frame(spark, schema, rows), leaf("s", "target_is_not_sorted_by", [{"name": "d", **more}], within="u"), core1=True)

    assert run([("a", "1", "2020-01-01"), ("a", "2", "2020-01-02"), ("a", "10", "2020-01-03")]) == [F, F, F]
    assert run([("a", "1", "2020-01-02"), ("a", "2", "2020-01-01"), ("a", "3", "2020-01-03")]) == [T, T, F]
    assert run([("a", "1", "2020"), ("a", "2", "2020-01")]) == [T, F]  # a year that holds the next date
    assert run([(None, "1", "2020"), (None, "2", "2020-01")]) == [F, F]
    assert run([("a", "", "1"), ("a", "10", "2"), ("a", "9", "3")]) == [T, T, T]  # a blank makes the order one of texts
    assert run([("a", 1.0, None), ("a", 2.0, "x")], "u string, s double, d string") == [T, T]


def test_sets(spark):
    ops = [Operation("$s", "split_by", {"name": "a", "delimiter": "|"}), Operation("$t", "split_by", {"name": "b", "delimiter": "|"})]
    df = frame(spark, "a string, b string", [("x|y", "x|y|z"), ("y|x", "x|y|z"), ("q", "x"), ("", "")])
    assert verdicts(df, leaf("$s", "is_ordered_subset_of", "$t"), operations=ops) == [T, F, F, T]
    assert verdicts(df, leaf("$t", "contains_all", "$s"), operations=ops) == [T, T, F, T]
    assert verdicts(df, leaf("$s", "shares_no_elements_with", "$t"), operations=ops) == [F, F, T, T]
    assert verdicts(df, leaf("$s", "is_contained_by", "$t"), operations=ops) == [T, T, F, F]
    assert verdicts(df, leaf("a", "contains_all", ["q", "x|y"])) == [T, F, F, F]  # one verdict, on the first record
    assert verdicts(df, leaf("a", "contains_all", ["q", "x|y"]), core1=True) == [T, T, T, T]


def test_dictionaries_refuse(spark):
    df = frame(spark, "a string", [("x",)])
    with pytest.raises(RuleSkipped, match="MedDRA"):
        verdicts(df, leaf("a", "is_valid_meddra_code_reference", "b"))
    with pytest.raises(RuleSkipped, match="Unimplemented"):
        verdicts(df, leaf("a", "no_such_operator", "b"))
