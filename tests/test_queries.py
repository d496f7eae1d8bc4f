"""The registered queries against their SQL, on the smallest driver tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lakewarden import queries
from lakewarden import queries_reference as reference
from lakewarden import queries_sources as sources

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "equal_to", "matches_regex", "is_contained_by_set", "date_equal_to", "date_less_than", "is_not_unique_set", "is_not_unique_relationship", "does_not_have_next_corresponding_record", "target_is_not_sorted_by",
    "is_not_ordered_set", "op_distinct", "op_record_count", "op_max_date", "ship_before_order", "match_left", "supp_pivot", "child_parent", "relrec", "unpivot_value_check", "variable_metadata", "global_length",
    "findings_melt", "max_records_topk", "truncated", "problem_summary", "skipped_ledger", "invalid_date_interval", "date_less_than_zones", "date_not_equal_to_odd", "date_component_core1", "is_not_ordered_set_blank",
    "is_not_ordered_set_whole", "op_max_date_core1", "op_minus", "match_bigint_key", "match_text_number_key", "triage_levels", *reference.QUERIES, *sources.QUERIES,
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "<NA>" else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["rule_id", "l_orderkey", "variable", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
