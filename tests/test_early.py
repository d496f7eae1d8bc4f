"""Rows that no rule of a pass can need are not read: findings stay the same."""

from __future__ import annotations

import random

import pytest

import lakewarden.runner as runner
from lakewarden.model import RECORD, Dataset, Rule, Study
from lakewarden.plans.early import early
from lakewarden.sources.frame import normal_types, parquet
from tests.helpers import dataset, leaf

LEAVES = [
    leaf("A", "empty"), leaf("--TERM", "non_empty"), leaf("A", "equal_to", "x", value_is_literal=True), leaf("N", "equal_to", 2), leaf("N", "less_than", 2), leaf("N", "greater_than_or_equal_to", 3),
    leaf("A", "is_contained_by", ["x", "y"]), leaf("N", "empty"), leaf("B", "matches_regex", "^u"), leaf("zz", "equal_to", "1"), leaf("B", "not_equal_to", "A"), leaf("B", "exists"), leaf("zz", "exists"),
]


def tree(rng, depth=2):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(LEAVES)
    kind = rng.choice(["all", "all", "any", "not"])
    return {"not": tree(rng, depth - 1)} if kind == "not" else {kind: [tree(rng, depth - 1) for _ in range(rng.randrange(1, 4))]}


def raw_dataset(spark, rng):
    rows = [(rng.choice(["x", "y", "z", "", None]), rng.choice(["u", "v", "", None]), rng.choice([1, 2, 3, None]), rng.choice(["t", None]), i + 1) for i in range(60)]
    raw = spark.createDataFrame(rows, f"A string, B string, N int, AETERM string, {RECORD} bigint")
    return Dataset("AE", normal_types(raw), domain_value="AE", raw=raw)


@pytest.mark.parametrize("joined", [False, True])
def test_findings_stay_the_same(spark, monkeypatch, joined):
    rng = random.Random(7)
    d, dm = raw_dataset(spark, rng), dataset(spark, "DM", "B string, zz string", [("u", "1"), ("v", "2")])
    study = Study({"AE": d, "DM": dm})
    specs = [{"Name": "DM", "Keys": ["B"]}] if joined else []
    groups = [[Rule(f"R{g}{i}", tree(rng), output=["A", "N"], message="m", match_datasets=specs) for i in range(rng.randrange(1, 4))] for g in range(5)]

    def found():
        out = []
        for rules in groups:
            result = runner.run(spark, rules, study, None, ["AE"])
            out.append((sorted(map(repr, result.findings.drop("triage").collect())), sorted(map(repr, result.skipped.collect()))))
            result.release()
        return out

    cut = []
    monkeypatch.setattr(runner, "early", lambda rows, rules, d: (cut.append(1), early(rows, rules, d))[1])
    got = found()
    monkeypatch.setattr(runner, "early", lambda rows, rules, d: rows)
    assert got == found() and len(cut) == len(groups) and sum(len(f) for f, _ in got) > 50


def test_conditions_of_rules_in_one_pass_reach_the_scan(spark, tmp_path):
    raw_dataset(spark, random.Random(1)).raw.drop(RECORD).coalesce(1).write.parquet(str(tmp_path / "ae"))
    d = parquet(spark, str(tmp_path / "ae"), "AE")
    rules = [Rule("R1", {"all": [leaf("A", "equal_to", "x", value_is_literal=True), leaf("B", "matches_regex", "^u")]}), Rule("R2", {"any": [leaf("A", "empty"), leaf("N", "empty")]}), Rule("R3", leaf("zz", "equal_to", "1"))]
    plan = early(d.df, rules, d)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].splitlines()[0]
    assert all(t in pushed for t in ("EqualTo(A,x)", "IsNull(A)", "IsNull(N)", "Or("))
    assert early(d.df, [*rules, Rule("R4", leaf("B", "matches_regex", "^u"))], d) is d.df


def test_columns_that_a_join_may_fill_are_not_tested(spark):
    d = raw_dataset(spark, random.Random(1))
    rule = Rule("R", leaf("N", "empty"), match_datasets=[{"Name": "SUPPAE"}])
    assert early(d.df, [rule], d) is d.df and early(d.df, [Rule("R", leaf("N", "empty"))], d) is not d.df
