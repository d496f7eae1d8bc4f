from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lakewarden.llm.common import Scratch, Stages, hub_join, keyed, placed, unkeyed, word_blocks


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hub_join_equals_the_plain_join(spark, how):
    rows = spark.range(6000).select(F.col("id").alias("rid"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("k"))
    per = Scratch(spark, "t").keep(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("rid").alias("last")).filter("k <> 9"))
    got, want = hub_join(rows, per, ["k"], "rid", how), rows.join(per.drop("n"), ["k"], how)
    assert sorted(got.select(*sorted(got.columns)).collect()) == sorted(want.select(*sorted(want.columns)).collect())


def test_places_are_dense_and_in_order(spark):
    values = spark.createDataFrame([("b",), (None,), ("a",), ("é",), ("Z",)], "v string")
    got = placed(values, Scratch(spark, "t"), F.col("v").asc_nulls_last()).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.place)] == ["Z", "a", "b", "é", None] and sorted(r.place for r in got) == list(range(5))


def test_a_stage_deletes_the_tables_of_the_one_before(spark):
    roots, stages = [], Stages()

    @stages
    def stage(spark, docs, sf_dir):
        scratch = Scratch(spark, "t")
        roots.append(scratch.root.removeprefix("file://").removeprefix("file:"))
        return scratch.keep(docs)

    assert stage(spark, spark.range(3), "").count() == 3 and os.path.isdir(roots[0])
    assert stage(spark, spark.range(4), "").count() == 4 and os.path.isdir(roots[1]) and not os.path.exists(roots[0])
    stages.clear(spark)
    assert not os.path.exists(roots[1])


def test_any_column_name_survives(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`row` int, rid int, `a.b` int, `p` int")
    assert unkeyed(keyed(df, p=F.lit(9))).collect() == df.collect()


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_hold_all_words(size):
    text = b"  a bb\tccc\n\n dddd  e" + b"x" * 50 + b" "
    assert [w for words in word_blocks(text, size) for w in words] == text.split()


@pytest.mark.parametrize("seed", range(3))
def test_components_of_chains_stars_and_circles(spark, seed, monkeypatch):
    import random

    import lakewarden.llm.components as m

    monkeypatch.setattr(m, "HUB", 5)
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)] + [(700, 700)]
    rng.shuffle(edges)
    label = {x: x for e in edges for x in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in m.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: r for x, r in label.items() if x != 700}
    assert m.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
