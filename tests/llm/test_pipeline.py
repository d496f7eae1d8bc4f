from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
from lakewarden.llm import queries
from lakewarden.llm.mixing import mixture
from lakewarden.llm.quality_classifier import quality_classifier

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_against_brute_force(spark):
    from .test_near_copies import brute_least

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert len(cp.STAGES) == 5
    (_, quality), (_, exact), (_, near), (_, mixed), (_, packed) = cp.STAGES

    kept = {r.doc_id for r in quality_classifier(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    one = quality(spark, docs, SF).cache()
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept

    two = exact(spark, one, SF).cache()
    last = {}
    for r in sorted(one.collect(), key=lambda r: r.doc_id):
        last[r.text] = r.doc_id
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(last.values())

    three = near(spark, two, SF).cache()
    stay = brute_least([(r.doc_id, r.text, r.source) for r in two.collect()])
    assert three.columns == columns and {r.doc_id for r in three.collect()} == stay

    four = mixed(spark, three, SF).cache()
    want = {r.doc_id: r.taken // r.size for r in mixture(three).collect() if r.taken}
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == want

    five = packed(spark, four, SF).collect()
    assert Counter(r.doc_id for r in five if r.piece == 0) == want
    whole = cp.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.length) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length) for r in five)


CLASHING = "_id, _sha2, _sha, _words, _p, _host, _path, _k, _copies, _posterior, _kept, _s, _n, _prior, row, rid, host, path, p, kept, n, s, prior, weight, base, size, mark, times, best, name".split(", ")


def test_stages_keep_columns_of_any_name(spark, documents):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "t"), (None, "x y", "s"), (None, "x y", "t"), (5, None, None)]
    df = documents(rows).select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in ("row", "name")))
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and out.select(*(F.sum(c) for c in CLASHING if c not in ("row", "name"))).first()[0] is not None


def test_mix_gives_each_row_its_own_copies(documents):
    from lakewarden.llm.mixing import mix

    # Null ids of one size in two sources, and rows equal in all columns.
    rows = [(None, "a b c", "b")] * 3 + [(None, "a b c", "a")] * 2 + [(4, "a b c", "a")] * 4
    df = documents(rows)
    taken: dict = {}
    for r in mixture(df).collect():
        taken[r.doc_id, r.source_size] = taken.get((r.doc_id, r.source_size), 0) + r.taken // 3
    got = Counter((r.doc_id, {"b": 9, "a": 18}[r.source]) for r in mix(df).collect())
    assert got == {k: v for k, v in taken.items() if v}


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
