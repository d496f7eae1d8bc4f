"""The queries that SQL can express, on the smallest driver tables and on awkward ones."""

from __future__ import annotations

import duckdb
import pytest

from lakewarden.llm import queries

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_a_failing_host_equals_sql(spark, tmp_path):
    """Most documents of one host fail, so that its shrunk rate passes the limit and its good documents go too."""
    data = [(i, f"w{i} " * 3 if i % 4 else " ".join(f"w{i}x{k}" for k in range(20)), "en", "junk", 1) for i in range(80)]
    data += [(100 + i, " ".join(f"w{i}x{k}" for k in range(15 + i % 5)) if i % 9 else "short", "en", f"h{i % 3}", 1) for i in range(120)]
    data += [(300, None, None, None, None), (301, "a b c d e " * 6 + "#$ x", "en", "junk", 1), (302, "l1 x\nl2 y\nl1 x\n \n\nl2 y", "en", "h1", 1)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = queries.op5_quality_rules(spark, str(tmp_path)).toPandas(), con.execute(queries.OP5_SQL).fetchdf()
    assert rows(got) == rows(want)
    good = got[(~got["base_failed"]) & got["doc_id"].isin(range(0, 80, 4))]
    assert len(good) == 20 and not good["kept"].any()
