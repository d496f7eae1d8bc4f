"""Plans that hold at any size: hot keys, order without groups, files of unlike size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import lakewarden.plans.table as table_module
from lakewarden.model import RECORD
from lakewarden.plans.ranges import ranked
from lakewarden.sources.frame import parquet
from tests.helpers import frame, leaf, verdicts

CHECKS = [
    leaf("a", "is_not_unique_set", ["b"]), leaf("a", "is_not_unique_relationship", ["c"]), leaf("b", "present_on_multiple_rows_within", None, within="a"), leaf("b", "is_inconsistent_across_dataset", ["a"]),
]


@pytest.mark.parametrize("check", CHECKS)
@pytest.mark.parametrize("core1", [False, True])
def test_a_hot_key_is_dealt_out(spark, monkeypatch, check, core1):
    rng = random.Random(3)
    rows = [("hot" if i % 2 else f"k{rng.randrange(40)}", str(rng.randrange(60)), "") for i in range(300)]
    rows = [(a, b, str(i % 3) if a == "hot" else f"of {a}") for i, (a, b, _) in enumerate(rows)]
    df = frame(spark, "a string, b string, c string", rows)
    want = verdicts(df, check, core1)
    assert len(set(want)) == 2
    monkeypatch.setattr(table_module, "HUB_ROWS", 20)
    assert verdicts(df, check, core1) == want


def test_the_rows_of_a_hub_are_even_over_the_tasks(spark, monkeypatch):
    """With the key of half of the rows, no window holds them and the join deals them by record."""
    from lakewarden.model import Dataset, Study
    from lakewarden.plans.table import Table

    monkeypatch.setattr(table_module, "HUB_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise((F.col("id") / 4).cast("int").cast("string")).alias("a"), (F.col("id") + 1).alias(RECORD))
        t = Table(df, Dataset("XX", df), Study(), "XX")
        bad = t.of_key([F.col("a")], F.col("__n") > 1)
        out = t.df.filter(bad)
        plan = out._jdf.queryExecution().toString()
        assert "Window" not in plan and "BroadcastHashJoin" in plan
        sizes = [r["count"] for r in out.filter("a = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes) and out.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_places_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), F.col("id").alias("r"))
    got = ranked(rows, [F.col("x"), F.col("r")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.x, r.r) for r in got] == sorted((r.x, r.r) for r in got)


def plain_order(rows, numeric, down, first):
    """Row numbers that are out of order, for (target, value) rows, by the meaning of the check."""
    from datetime import date

    def is_date(v):
        try:
            return v is not None and len(v) in (4, 7, 10) and bool(date.fromisoformat(v + "-01-01"[: 10 - len(v)] if len(v) == 4 else v + "-01" if len(v) == 7 else v))
        except ValueError:
            return False

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] if rows[i][0] is not None else 0, i))
    blank = [v is None if numeric else not (v or "").strip() for _, v in rows]
    bad = set()
    flags = [blank[i] for i in order]
    if any(flags) and not all(flags) and flags != sorted(flags, reverse=first):
        bad |= {i for i in order if blank[i]}
    held = set() if numeric else {i for i in order for j in order if is_date(rows[i][1]) and is_date(rows[j][1]) and len(rows[i][1]) != len(rows[j][1]) and (rows[i][1].startswith(rows[j][1]) or rows[j][1].startswith(rows[i][1]))}
    checked = [i for i in order if not blank[i] and i not in held]
    by_value = sorted(checked, key=lambda i: rows[i][1], reverse=down) if not down else sorted(checked[::-1], key=lambda i: rows[i][1])[::-1]
    for i, j in zip(checked, by_value):
        a, b = rows[i][0], rows[j][0]
        same = a == b or {a, b} == {"2024--", "2024---15"}  # dates, equal before the dashes
        bad |= set() if same else {i}
    filled = [i for i in order if not blank[i]]
    for k, i in enumerate(filled):
        if numeric or is_date(rows[i][1]):
            for j, sign in ((k - 1, 1), (k + 1, -1)):
                if 0 <= j < len(filled):
                    x, y = rows[filled[j]][1], rows[i][1]
                    if (x > y if (sign == 1) != down else x < y):
                        bad.add(i)
    return [i in bad or i in held for i in range(len(rows))]


@pytest.mark.parametrize("down,first", [(False, False), (True, True)])
@pytest.mark.parametrize("values", ["dates", "texts", "numbers"])
def test_order_with_and_without_groups(spark, values, down, first):
    rng = random.Random(f"{values}{down}")
    pool = {"dates": ["2024", "2024-01", "2024-01-03", "2023-05-01", "2023-06", "2022", "", " ", "zz"], "texts": ["a", "b", "", "c"], "numbers": [1.0, 2.0, 3.0, None]}[values]
    spec = {"name": "d", "sort_order": "desc" if down else "asc", "null_position": "first" if first else "last"}
    groups = [[(rng.choice([f"x--{rng.randrange(5)}", f"y{i}", "2024--", "2024---15"]), rng.choice(pool)) for i in range(rng.randrange(1, 9))] for _ in range(30)]
    groups.append([(f"{i:02}", v) for i, v in enumerate(sorted((p for p in pool if p not in ("", " ", None)), reverse=down))])
    kind = "double" if values == "numbers" else "string"
    df = frame(spark, f"g string, s string, d {kind}", [(str(k), s, d) for k, g in enumerate(groups) for s, d in g])
    want = [x for g in groups for x in plain_order(g, values == "numbers", down, first)]
    assert verdicts(df, leaf("s", "target_is_not_sorted_by", [spec], within="g")) == want
    for g in groups[-2:-1] if (values == "dates") != down else []:
        alone = verdicts(frame(spark, f"s string, d {kind}", g), leaf("s", "target_is_not_sorted_by", [spec]))
        assert alone == plain_order(g, values == "numbers", down, first)


def test_dashes_of_texts_count(spark):
    df = frame(spark, "s string, d string", [("x--1", "b"), ("x--2", "a")])
    check = leaf("s", "target_is_not_sorted_by", [{"name": "d"}])
    assert verdicts(df, check) == [True, True]
    assert verdicts(frame(spark, "s string, d string", [("2024--", "b"), ("2024---15", "a")]), check) == [False, False]


def test_order_without_groups_sorts_in_many_tasks(spark):
    from lakewarden import queries

    for name in ("target_is_not_sorted_by_whole", "target_is_not_sorted_by_whole_strict"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Window" not in plan


def test_records_of_many_files(spark, tmp_path):
    parts = [("b", range(5, 60_000)), ("a", range(5)), ("c", range(60_000, 60_010))]
    for name, ids in parts:
        spark.range(ids.start, ids.stop, 1, 1).selectExpr("id", "'XX' AS DOMAIN").write.parquet(str(tmp_path / f"t/part={name}"))
    for split in ("128m", "64k", "8k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            d = parquet(spark, str(tmp_path / "t"), "XX")
            assert d.df.filter(F.col(RECORD) != F.col("id") + 1).count() == 0 and d.df.count() == 60_010
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("partitions", [1, 5])
def test_as_of_equals_a_walk(spark, partitions):
    from lakewarden.plans.asof import as_of

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(100)]), i) for i in range(400)]
    events = [(rng.choice(["a", "b", None]), rng.randrange(5, 100), f"v{i:03}") for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = as_of(spark.createDataFrame(rows, "k string, t int, i int"), spark.createDataFrame(events, "k string, t int, v string"), ["k"], "t", "v")
        assert got.columns == ["k", "t", "i", "v"]
        found = {r.i: r.v for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found == {i: None if t is None else max(((s, v) for key, s, v in events if key == k and s <= t), default=(0, None))[1] for k, t, i in rows}


def test_value_checks_read_what_they_can_violate(spark, tmp_path):
    from lakewarden.model import Dataset, Rule, Study, VariableMeta
    from lakewarden.runner import run
    from lakewarden.sources.frame import normal_types, with_file_record

    spark.createDataFrame([("x", "long text", 1.5), ("y", "", None)], "A string, B string, N double").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = normal_types(with_file_record(spark.read.parquet(str(tmp_path / "t"))))
    meta = [VariableMeta("A", "First", "Char", 8), VariableMeta("B", "Second", "Char", 8), VariableMeta("N", "Number", "Num", 8)]

    def found(*conditions, **more):
        rule = Rule("V", {"all": list(conditions)}, "Value Check with Variable Metadata", **more)
        out = run(spark, [rule], Study({"XX": Dataset("XX", df, meta)}), None)
        plan = out.info["passes"][0]._jdf.queryExecution().toString()
        rows = sorted((r.Record, r.Variable, r.Value) for r in out.findings.collect())
        out.release()
        return rows, [c for c in "ABN" if f"{c}:" in plan[plan.rindex("ReadSchema") :].partition(">")[0]]

    longer = leaf("variable_value", "longer_than", 3)
    assert found(leaf("variable_name", "equal_to", "B", value_is_literal=True), longer) == ([(1, "B", "long text")], ["B"])
    assert found(leaf("variable_data_type", "equal_to", "Num", value_is_literal=True), leaf("variable_value", "non_empty")) == ([(1, "N", "1.5")], ["N"])
    assert found(leaf("variable_name", "is_contained_by", ["A", "Z"]), leaf("variable_value", "equal_to", "y", value_is_literal=True)) == ([(2, "A", "y")], ["A"])
    assert found(leaf("variable_name", "equal_to", "Q", value_is_literal=True), longer)[0] == []
    assert found(longer) == ([(1, "B", "long text")], ["A", "B", "N"])


def test_values_are_built_of_violations_alone(spark):
    """The values that findings show are not among the columns that every row carries, unless they come from a binding of the row."""
    from lakewarden.model import Dataset, Dialect, Operation, Rule, Study
    from lakewarden.plans.reshape import as_table
    from lakewarden.runner import compile_rules, run

    df = frame(spark, "a string, n double", [("", 1.0), ("x", 2.0), ("", 3.0)])
    data = Dataset("XX", df, domain_value="XX")
    most = Operation("$most", "max", {"name": "n", "group": ["a"]})
    rules = [Rule(f"R{i}", leaf("a", "empty"), output=["a", "n"]) for i in range(5)] + [Rule("B", leaf("a", "empty"), output=["a", "$most"], operations=[most])]

    def carried(some):
        done, table, skipped = compile_rules(some, lambda: as_table(df, data, Study(), Dialect.CDISC), Study(), Dialect.CDISC)
        assert len(done) == len(some) and not skipped
        return sum(f.dataType.simpleString().startswith("array<struct") for f in table.df.schema)

    assert carried(rules[:5]) == 0 and carried(rules) == 1
    found = run(spark, rules, Study({"XX": data}), None).findings
    want = {(f"R{i}", r, v, x) for i in range(5) for r, n in ((1, "1"), (3, "3")) for v, x in (("a", ""), ("n", n))} | {("B", r, v, x) for r in (1, 3) for v, x in (("a", ""), ("$most", "3"))}
    assert {(r.rule_id, r.Record, r.Variable, r.Value.removesuffix(".0")) for r in found.collect()} == want


def test_a_pass_is_kept_on_disk_as_a_row_per_record(spark):
    """However many rules a record violates, one row is kept of it, and nothing of it in memory; findings are the same."""
    from lakewarden.model import Dataset, Operation, Rule, Study
    from lakewarden.runner import FUSE, run

    df = frame(spark, "a string, b string, n double", [("", "p", 1.0), ("x", "p", 2.0), ("", "q", 3.0), ("x", "q", None)])
    data = Dataset("XX", df, domain_value="XX")
    plain = [Rule(f"R{i:02}", leaf("a", "empty" if i % 2 else "non_empty"), output=[("a", "n")[i % 3 > 0], "zz"]) for i in range(FUSE - 3)]
    most = Operation("$most", "max", {"name": "n", "group": ["b"]})
    others = [
        Rule("B", leaf("a", "empty"), output=["n", "$most"], operations=[most]), Rule("D", leaf("a", "empty"), output=["b"], sensitivity="Dataset"),
        Rule("G", leaf("a", "empty"), output=["b"], sensitivity="Group", grouping=["b"]),
    ]
    out = run(spark, [*plain, *others], Study({"XX": data}), None)
    (kept,) = out.info["kept"]
    assert kept.count() == 4
    level = kept.storageLevel
    assert level.useDisk and not level.useMemory
    number = {1: "1", 2: "2", 3: "3", 4: ""}
    want = {(f"R{i:02}", r, v, number[r] if v == "n" else "x" if v == "a" and not i % 2 else "Not in dataset" if v == "zz" else "") for i in range(FUSE - 3) for r in ((1, 3) if i % 2 else (2, 4)) for v in (("a", "n")[i % 3 > 0], "zz")}
    want |= {("B", r, v, x) for r, m in ((1, "2"), (3, "3")) for v, x in (("n", str(r)), ("$most", m))} | {("D", None, "b", "p"), ("G", 1, "b", "p"), ("G", 3, "b", "q")}
    found = out.findings.collect()
    assert len(found) == len(want) and {(r.rule_id, r.Record, r.Variable, r.Value.removesuffix(".0")) for r in found} == want
    out.release()
    assert not kept.storageLevel.useDisk
