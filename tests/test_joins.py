"""Joins by what the data name, against plain versions: any number of key variables and domains in one join."""

from __future__ import annotations

import random

import pytest

from lakewarden.model import Rule, Study
from lakewarden.plans.matching import match
from tests.helpers import dataset

RELREC = "RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, RELID string"


def number(v) -> str:
    """A key: trimmed, numbers by value."""
    v = "" if v is None else str(v).strip()
    try:
        return str(float(v))
    except ValueError:
        return v


def study_of(spark, rng, links):
    ae = [(rng.choice(["1", "2", ""]), float(i % 5), rng.choice(["a", "b", ""]), f"t{i}") for i in range(30)]
    cm = [(rng.choice(["1", "2", ""]), float(i % 4), rng.choice(["a", "b", ""]), f"m{i}") for i in range(20)]
    ti = [(rng.choice(["a", "b", "c"]), f"i{i}") for i in range(6)]
    tables = {
        "AE": dataset(spark, "AE", "USUBJID string, AESEQ double, AEGRPID string, AETERM string", ae), "CM": dataset(spark, "CM", "USUBJID string, CMSEQ double, CMGRPID string, CMTRT string", cm),
        "TI": dataset(spark, "TI", "TIGRPID string, TITEXT string", ti), "RELREC": dataset(spark, "RELREC", RELREC, links),
    }
    rows = {
        "AE": [{"USUBJID": s, "AESEQ": n, "AEGRPID": g, "AETERM": t} for s, n, g, t in ae], "CM": [{"USUBJID": s, "CMSEQ": n, "CMGRPID": g, "CMTRT": t} for s, n, g, t in cm],
        "TI": [{"TIGRPID": g, "TITEXT": t} for g, t in ti],
    }
    return Study(tables), rows


def related(rows, links):
    """(term, text of the partner) of each related pair, link by link."""
    out = []
    for rd, subject, var, value, rel in links:
        for rd2, subject2, var2, value2, rel2 in links:
            if rd != "AE" or rd2 not in ("CM", "TI") or (subject, rel) != (subject2, rel2) or (var and var not in rows["AE"][0]) or (var2 and var2 not in rows[rd2][0]):
                continue
            for a in rows["AE"]:
                if (subject and a["USUBJID"] != subject) or (var and value and number(a[var]) != number(value)):
                    continue
                for p in rows[rd2]:
                    if "USUBJID" in p and p["USUBJID"] != a["USUBJID"]:
                        continue
                    given = number(value2) if value2 else number(a[var]) if var else None
                    if not var2 or (given is not None and number(p[var2]) == given):
                        out.append((a["AETERM"], p.get("CMTRT") or p.get("TITEXT")))
    return sorted(out)


def links_of(rng, count):
    out = []
    for i in range(count):
        subject = rng.choice(["1", "2", ""])
        a = rng.choice([("AESEQ", rng.choice(["1", "2.0", " 3", ""])), ("AEGRPID", rng.choice(["a", "b", "", " "])), ("", ""), ("", "9"), ("AEXX", "1")])
        b = rng.choice([("CM", "CMSEQ", rng.choice(["1.0", "2", ""])), ("CM", "CMGRPID", rng.choice(["a", ""])), ("TI", "TIGRPID", rng.choice(["b", ""])), ("CM", "", ""), ("XX", "XXSEQ", "1"), ("CM", "CMXX", "1")])
        out += [("AE", subject, *a, f"R{i}"), (b[0], subject, b[1], b[2], f"R{i}")]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_relationships_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    links = links_of(rng, 14)
    study, rows = study_of(spark, rng, links)
    out = match(study.get("AE").df, Rule("R", {}, match_datasets=[{"Name": "RELREC"}]), study.get("AE"), study)
    want = related(rows, links)
    text = ["RELREC.CMTRT", "RELREC.TITEXT"]
    assert sorted((r.AETERM, next(r[c] for c in text if c in out.columns and r[c] is not None)) for r in out.collect()) == want and len(want) > 20


def exchanges(spark, df) -> int:
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        return df()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(k)


def test_key_variables_add_no_exchange(spark):
    one = [("AE", "1", "AESEQ", "1", "A"), ("CM", "1", "CMSEQ", "1", "A")]
    more = one + [("AE", "1", "AEGRPID", "a", "B"), ("CM", "1", "CMGRPID", "a", "B"), ("AE", "2", "AESEQ", "1", "C"), ("TI", "2", "TIGRPID", "a", "C")]

    def count(links):
        study, _ = study_of(spark, random.Random(1), links)
        return exchanges(spark, lambda: match(study.get("AE").df, Rule("R", {}, match_datasets=[{"Name": "RELREC"}]), study.get("AE"), study))

    assert count(one) == count(more)


CHILD = "RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, NOTE string, X string"


def children(rng, count):
    pick = [("AE", "AESEQ", "1"), ("AE", "AESEQ", "2.0"), ("ae", "AEGRPID", "a"), ("AE", "", ""), ("AE", "AESEQ", ""), ("CM", "CMSEQ", "1"), ("CM", "CMXX", "1"), ("XX", "XXSEQ", "1"), ("AE", "AEGRPID", "none")]
    return [(rd, rng.choice(["1", "2", "9"]), iv, val, f"n{i}", f"x{i}") for i in range(count) for rd, iv, val in [rng.choice(pick)]]


@pytest.mark.parametrize("core1", [False, True])
def test_children_get_their_first_parent(spark, core1):
    rng = random.Random(5)
    ae = [(rng.choice(["1", "2"]), float(i % 3), rng.choice("ab"), f"t{i}", f"y{i}") for i in range(20)]
    cm = [(rng.choice(["1", "2"]), float(i % 3), f"m{i}", float(i)) for i in range(12)]
    notes = children(rng, 60)
    co = dataset(spark, "CO", CHILD, notes)
    study = Study({"CO": co, "AE": dataset(spark, "AE", "USUBJID string, AESEQ double, AEGRPID string, AETERM string, X string", ae), "CM": dataset(spark, "CM", "USUBJID string, CMSEQ double, CMTRT string, AETERM double", cm)})
    rule = Rule("R", {}, match_datasets=[{"Name": "CO", "Child": True}], source="core_contributor" if core1 else "")
    got = {r.NOTE: r.asDict() for r in match(co.df, rule, co, study).collect()}
    parents = {"AE": [dict(zip(("USUBJID", "AESEQ", "AEGRPID", "AETERM", "X"), r)) for r in ae], "CM": [dict(zip(("USUBJID", "CMSEQ", "CMTRT", "AETERM"), r)) for r in cm]}
    assert len(got) == len(notes)
    met = 0
    for rd, subject, iv, value, note, x in notes:
        rd = rd.upper()
        iv = iv if value and iv in parents.get(rd, [{}])[0] else ""
        first = next((p for p in parents.get(rd, []) if p["USUBJID"] == subject and (not iv or number(p[iv]) == number(value))), {})
        met += bool(first)
        r = got[note]
        term = first.get("AETERM")
        assert r["AETERM"] == (term if not isinstance(term, float) else str(int(term))) and r["CMTRT"] == first.get("CMTRT")
        if core1:
            assert (r["AE.X"], r["AE.USUBJID"]) == (first.get("X"), first.get("USUBJID") if rd == "AE" else None) and r["X"] == x
        else:
            assert r["X"] == (first.get("X") or x if iv else x)
            assert r["X.AE"] == (first.get("X") if not iv else None) and r["USUBJID.AE"] == (first.get("USUBJID") if rd == "AE" else None)
    assert met > 20


def test_parents_are_joined_once(spark):
    def count(notes):
        co = dataset(spark, "CO", CHILD, notes)
        ae = dataset(spark, "AE", "USUBJID string, AESEQ double, AEGRPID string", [("1", 1.0, "a")])
        study = Study({"CO": co, "AE": ae, "CM": dataset(spark, "CM", "USUBJID string, CMSEQ double", [("1", 1.0)])})
        return exchanges(spark, lambda: match(co.df, Rule("R", {}, match_datasets=[{"Name": "CO", "Child": True}]), co, study))

    one = [("AE", "1", "AESEQ", "1", "", "")]
    assert count(one) == count(one + [("AE", "1", "AEGRPID", "a", "", ""), ("AE", "1", "", "", "", ""), ("CM", "1", "CMSEQ", "1", "", "")]) == 2


def test_no_parent_and_no_link(spark):
    co = dataset(spark, "CO", CHILD, [("XX", "1", "XXSEQ", "1", "n", "x")])
    study = Study({"CO": co, "RELREC": dataset(spark, "RELREC", RELREC, [])})
    assert match(co.df, Rule("R", {}, match_datasets=[{"Name": "CO", "Child": True}]), co, study).count() == 1
    assert match(co.df, Rule("R", {}, match_datasets=[{"Name": "RELREC"}]), co, study).count() == 0
