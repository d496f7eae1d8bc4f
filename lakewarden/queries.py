"""Registered queries of the engine: one per operator, operation, join, rule type and result step.

Each runs the engine's own compiler over a whole driver table and returns the
keys (or rows) it finds; beside it stands the SQL that must agree. A base is a
projection both engines read as it stands; ``{t}`` is the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import RECORD, Dataset, Dialect, Operation, Rule, Study, VariableMeta
from .plans.early import early
from .plans.evaluate import Compiler
from .plans.matching import match
from .plans.table import Table
from .sources.frame import normal_types

_ISO = "replace(left(CAST(ts AS STRING), 19), ' ', 'T')"
#: (table, projection). ``id`` is unique and gives the record's place.
BASES = {
    "events": (
        "events",
        f"""SELECT event_id AS id, CAST(user_id AS STRING) AS u, CAST(value AS DOUBLE) AS n, event_type AS t, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS tb,
        upper(event_type) AS tu, CAST(event_id % 7 AS STRING) AS d7, CAST(CAST(event_id % 5 AS STRING) || '.00' AS STRING) AS d5, CAST(event_id % 5 AS DOUBLE) AS m5, {_ISO} AS iso,
        CASE event_id % 6 WHEN 0 THEN left({_ISO}, 4) WHEN 1 THEN left({_ISO}, 7) WHEN 2 THEN left({_ISO}, 10) WHEN 3 THEN {_ISO} WHEN 4 THEN '' ELSE left({_ISO}, 8) || '32' END AS p,
        left({_ISO}, 8) || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') AS q, CASE event_id % 5 WHEN 0 THEN 'P1Y2M' WHEN 1 THEN 'P1.5Y2M' WHEN 2 THEN 'PT' WHEN 3 THEN '-P3W' ELSE 'P1D,T2H' END AS du,
        CASE event_id % 4 WHEN 0 THEN '' ELSE 'a' END AS x, CASE event_id % 3 WHEN 0 THEN '' ELSE event_type END AS x1, CASE event_id % 5 WHEN 0 THEN 'click' ELSE '' END AS x2,
        CASE event_id % 3 WHEN 0 THEN 'x1' WHEN 1 THEN 'x2' ELSE 'none' END AS ref, CASE event_id % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'b,a' WHEN 2 THEN 'c' ELSE '' END AS s1,
        CASE event_id % 3 WHEN 0 THEN 'a,b' WHEN 1 THEN 'c,d' ELSE 'a,b,c,d' END AS s2,
        CASE event_id % 3 WHEN 0 THEN {_ISO.replace('ts', "ts - INTERVAL '3' HOUR")} WHEN 1 THEN {_ISO.replace('ts', "ts + INTERVAL '1' HOUR")} ELSE {_ISO} END AS iso2,
        {_ISO} || CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '-05:30' ELSE '' END AS zoned,
        CASE event_id % 7 WHEN 0 THEN left({_ISO}, 10) || '/2025' WHEN 1 THEN '2024---' || substr({_ISO}, 9, 2) WHEN 2 THEN '-----T' || substr({_ISO}, 12, 5) WHEN 3 THEN left({_ISO}, 8) || '-T' || substr({_ISO}, 12, 5)
          WHEN 4 THEN '2024-02-30' WHEN 5 THEN left({_ISO}, 16) || 'Z' ELSE left({_ISO}, 10) || 'x' END AS odd,
        CASE event_id % 4 WHEN 0 THEN '2023-02-' WHEN 1 THEN '2023-08-' WHEN 2 THEN '2024-03-' ELSE '2020-08-' END || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') AS rel,
        CASE event_id % 7 WHEN 0 THEN left({_ISO}, 10) || '/P1D' WHEN 1 THEN left({_ISO}, 10) || '/-P1D' WHEN 2 THEN 'P2W/' || left({_ISO}, 10) WHEN 3 THEN left({_ISO}, 10) || '/' || left({_ISO}, 7) WHEN 4 THEN left({_ISO}, 7) || '/2024--'
          WHEN 5 THEN left({_ISO}, 10) ELSE left({_ISO}, 8) || '32/2024-01-01' END AS span FROM {{t}}""",
    ),
    "customer": ("customer", "SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS DOUBLE) AS nation, c_mktsegment AS seg, CAST(c_acctbal AS DOUBLE) AS bal, CAST(c_custkey % 300 AS STRING) AS grp, CAST(c_custkey % 7 AS STRING) AS g7, 'x--' || lpad(CAST(c_custkey * 7 % 1000003 AS STRING), 7, '0') AS dash, CASE WHEN c_custkey % 10 < 3 THEN 'A' || CAST(c_custkey % 50 AS STRING) WHEN c_custkey % 10 = 4 THEN '' ELSE c_name END AS one, CASE WHEN c_custkey % 10 < 2 THEN 'B' || CAST(c_custkey % 40 AS STRING) WHEN c_custkey % 10 IN (4, 5) THEN '' ELSE 'C' || CAST(c_custkey % 700 AS STRING) END AS two FROM {t}"),
    "orders": ("orders", "SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS cust, o_orderstatus AS status, o_orderpriority AS prio, left(CAST(o_orderdate AS STRING), 10) AS day, CAST(o_orderkey % 11 AS DOUBLE) AS k11, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE left(CAST(o_orderdate AS STRING), 10) END AS dayb, left(CAST(o_orderdate AS STRING), CASE WHEN o_orderkey % 5 = 1 THEN 7 ELSE 10 END) || CASE o_orderkey % 5 WHEN 2 THEN 'junk' WHEN 3 THEN ' 10:00' ELSE '' END AS dayx FROM {t}"),
}


def _as_read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = BASES[name]
    return spark.sql(sql, t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return normal_types(_as_read(spark, sf_dir, name)).withColumn(RECORD, F.col("id") + 1)


def base_dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    """A base as a dataset of its name, with the rows as they are read."""
    raw = _as_read(spark, sf_dir, name).withColumn(RECORD, F.col("id") + 1)
    return Dataset(name.upper(), normal_types(raw), raw=raw)


def base_sql(name: str) -> str:
    table, sql = BASES[name]
    return sql.format(t=table)


def flagged(df: DataFrame, rule: Rule, study: Study | None = None, keys: tuple[str, ...] = ("id",), data: Dataset | None = None) -> DataFrame:
    """The keys of the rows that violate a rule."""
    study = study or Study()
    data = data or Dataset("T", df)
    rows = match(early(df, [rule], data), rule, data, study) if rule.match_datasets else df
    table = Table(rows, data, study, "T")
    verdict = table.add(Compiler(table, study, rule.dialect).rule(rule)[0])
    sure = table.settled(F.coalesce(verdict, F.lit(False)))
    found = table.df.filter(sure).select(*(F.col(k) for k in keys))
    return found.distinct() if rule.match_datasets else found


def _rule(check: dict, operations: list[Operation] | None = None, core1: bool = False, **more: object) -> Rule:
    return Rule("R", check, operations=operations or [], source="core_contributor" if core1 else "", **more)


#: A date's text is valid if it is cut after a part and is no 32nd.
_VALID = "({0} <> '' AND {0} NOT LIKE '%-32')"
_LEVEL = "least(length(p), length(q))"


def _date(op: str) -> str:
    return f"{_VALID.format('p')} AND left(p, {_LEVEL}) {op} left(q, {_LEVEL})"


_SPLIT = [Operation("$s1", "split_by", {"name": "s1", "delimiter": ","}), Operation("$s2", "split_by", {"name": "s2", "delimiter": ","})]
#: Users of two kinds of events, as sets and as SQL.
_BOTH = [Operation("$a", "distinct", {"name": "u", "filter": {"t": "click", "d7": "1"}}), Operation("$b", "distinct", {"name": "u", "filter": {"t": "error", "d7": "2"}})]
_USERS = "SELECT CAST(user_id AS STRING) FROM events WHERE event_type = '{}' AND event_id % 7 = {}"
_L1, _L2 = "(CASE WHEN s1 = '' THEN [] ELSE string_split(s1, ',') END)", "string_split(s2, ',')"
_BY_U = "PARTITION BY u ORDER BY iso, id"

#: A key that is filled has one partner; both ways.
_TWO_WAYS = "(one <> '' AND min(two) OVER (PARTITION BY one) <> max(two) OVER (PARTITION BY one)) OR (two <> '' AND min(one) OVER (PARTITION BY two) <> max(one) OVER (PARTITION BY two))"
#: The instant of a text to the second with its zone, and the day or year that odd texts give (no date: NULL).
_ZONED = "(CAST(replace(left(zoned, 19), 'T', ' ') AS TIMESTAMP) - CASE substr(zoned, 20) WHEN '+02:00' THEN INTERVAL '2' HOUR WHEN '-05:30' THEN INTERVAL '-330' MINUTE ELSE INTERVAL '0' HOUR END)"
_ODD = "CASE id % 7 WHEN 0 THEN left(odd, 10) WHEN 1 THEN '2024' WHEN 3 THEN left(odd, 7) WHEN 5 THEN left(odd, 10) END"
_ODD_LEVEL = f"length({_ODD})"
#: Valid intervals of 1.0 rules, by the form they were written in.
_SPAN = "id % 7 IN (0, 2, 3, 4)"

#: query: (base, condition, SQL predicate over the base[, operations[, 1.0 dialect]]).
CHECKS: dict[str, tuple] = {
    "equal_to": ("events", {"name": "x1", "operator": "equal_to", "value": "t"}, "x1 <> '' AND t <> '' AND x1 = t"),
    "equal_to_literal": ("events", {"name": "t", "operator": "equal_to", "value": "click", "value_is_literal": True}, "t = 'click'"),
    "equal_to_type_insensitive": ("events", {"name": "d5", "operator": "equal_to", "value": "m5", "type_insensitive": True}, "TRY_CAST(d5 AS DOUBLE) = m5"),
    "equal_to_reference": ("events", {"name": "t", "operator": "equal_to", "value": "ref", "value_is_reference": True}, "t <> '' AND CASE ref WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 END = t"),
    "not_equal_to": ("events", {"name": "x1", "operator": "not_equal_to", "value": "tb"}, "x1 <> tb"),
    "equal_to_case_insensitive": ("events", {"name": "x1", "operator": "equal_to_case_insensitive", "value": "tu"}, "x1 <> '' AND upper(x1) = tu"),
    "not_equal_to_case_insensitive": ("events", {"name": "x1", "operator": "not_equal_to_case_insensitive", "value": "tu"}, "upper(x1) <> tu"),
    "less_than": ("events", {"name": "d7", "operator": "less_than", "value": 3}, "TRY_CAST(d7 AS DOUBLE) < 3"),
    "less_than_or_equal_to": ("events", {"name": "d7", "operator": "less_than_or_equal_to", "value": "m5"}, "TRY_CAST(d7 AS DOUBLE) <= m5"),
    "greater_than": ("events", {"any": [{"name": "t", "operator": "greater_than", "value": 3}, {"name": "d5", "operator": "greater_than", "value": "d7"}]}, "coalesce(TRY_CAST(t AS DOUBLE) > 3, false) OR TRY_CAST(d5 AS DOUBLE) > TRY_CAST(d7 AS DOUBLE)"),
    "greater_than_or_equal_to": ("events", {"name": "d5", "operator": "greater_than_or_equal_to", "value": 2}, "TRY_CAST(d5 AS DOUBLE) >= 2"),
    "exists": ("events", {"all": [{"name": "tb", "operator": "exists"}, {"name": "d7", "operator": "equal_to", "value": "1", "value_is_literal": True}]}, "d7 = '1'"),
    "not_exists": ("events", {"all": [{"name": "zz", "operator": "not_exists"}, {"name": "d7", "operator": "equal_to", "value": "2", "value_is_literal": True}]}, "d7 = '2'"),
    "empty": ("events", {"name": "tb", "operator": "empty"}, "tb = ''"),
    "non_empty": ("events", {"name": "tb", "operator": "non_empty"}, "tb <> ''"),
    "inconsistent_enumerated_columns": ("events", {"name": "x", "operator": "inconsistent_enumerated_columns"}, "(x = '' AND (x1 <> '' OR x2 <> '')) OR (x1 = '' AND x2 <> '')"),
    "matches_regex": ("events", {"name": "t", "operator": "matches_regex", "value": "c[a-z]+"}, "t <> '' AND regexp_matches(t, '^(c[a-z]+)')"),
    "not_matches_regex": ("events", {"name": "tb", "operator": "not_matches_regex", "value": "c"}, "tb <> '' AND NOT regexp_matches(tb, '^c')"),
    "matches_regex_case_insensitive": ("events", {"name": "tu", "operator": "matches_regex_case_insensitive", "value": "li"}, "regexp_matches(lower(tu), 'li')", None, True),
    "not_matches_regex_case_insensitive": ("events", {"name": "tb", "operator": "not_matches_regex_case_insensitive", "value": "LI"}, "tb <> '' AND NOT regexp_matches(tb, 'li')", None, True),
    "longer_than": ("customer", {"name": "seg", "operator": "longer_than", "value": 8}, "length(seg) > 8"),
    "longer_than_or_equal_to": ("customer", {"name": "seg", "operator": "longer_than_or_equal_to", "value": 9}, "length(seg) >= 9"),
    "shorter_than": ("events", {"name": "tb", "operator": "shorter_than", "value": "iso"}, "length(tb) < length(iso)"),
    "shorter_than_or_equal_to": ("events", {"name": "tb", "operator": "shorter_than_or_equal_to", "value": 5}, "tb <> '' AND length(tb) <= 5", None, True),
    "has_equal_length": ("events", {"name": "t", "operator": "has_equal_length", "value": 5}, "length(t) = 5"),
    "has_not_equal_length": ("events", {"name": "t", "operator": "has_not_equal_length", "value": 5}, "length(t) <> 5"),
    "contains": ("events", {"name": "iso", "operator": "contains", "value": "-01"}, "contains(iso, '-01')"),
    "does_not_contain": ("events", {"name": "iso", "operator": "does_not_contain", "value": "-1"}, "NOT contains(iso, '-1')"),
    "contains_case_insensitive": ("events", {"name": "t", "operator": "contains_case_insensitive", "value": "LI"}, "contains(upper(t), 'LI')"),
    "does_not_contain_case_insensitive": ("events", {"name": "t", "operator": "does_not_contain_case_insensitive", "value": "LI"}, "NOT contains(upper(t), 'LI')"),
    "starts_with": ("customer", {"name": "seg", "operator": "starts_with", "value": ["AUTO", "BU"]}, "seg LIKE 'AUTO%' OR seg LIKE 'BU%'"),
    "ends_with": ("customer", {"name": "seg", "operator": "ends_with", "value": "RY"}, "seg LIKE '%RY'"),
    "prefix_matches_regex": ("customer", {"name": "name", "operator": "prefix_matches_regex", "prefix": 9, "value": "#"}, "regexp_matches(left(name, 9), '#')"),
    "not_prefix_matches_regex": ("customer", {"name": "name", "operator": "not_prefix_matches_regex", "prefix": 18, "value": "[05]$"}, "NOT regexp_matches(left(name, 18), '[05]$')"),
    "suffix_matches_regex": ("customer", {"name": "name", "operator": "suffix_matches_regex", "suffix": 2, "value": "[13]$"}, "regexp_matches(right(name, 2), '[13]$')"),
    "not_suffix_matches_regex": ("customer", {"name": "name", "operator": "not_suffix_matches_regex", "suffix": 2, "value": "[13]$"}, "NOT regexp_matches(right(name, 2), '[13]$')"),
    "prefix_matches_regex_case_insensitive": ("customer", {"name": "seg", "operator": "prefix_matches_regex_case_insensitive", "prefix": 2, "value": "^b"}, "regexp_matches(lower(left(seg, 2)), '^b')"),
    "not_prefix_matches_regex_case_insensitive": ("customer", {"name": "seg", "operator": "not_prefix_matches_regex_case_insensitive", "prefix": 2, "value": "^b"}, "NOT regexp_matches(lower(left(seg, 2)), '^b')"),
    "suffix_matches_regex_case_insensitive": ("customer", {"name": "seg", "operator": "suffix_matches_regex_case_insensitive", "suffix": 3, "value": "y$"}, "regexp_matches(lower(right(seg, 3)), 'y$')"),
    "not_suffix_matches_regex_case_insensitive": ("customer", {"name": "seg", "operator": "not_suffix_matches_regex_case_insensitive", "suffix": 3, "value": "y$"}, "NOT regexp_matches(lower(right(seg, 3)), 'y$')"),
    "prefix_equal_to": ("events", {"name": "iso", "operator": "prefix_equal_to", "prefix": 2, "value": "20", "value_is_literal": True}, "left(iso, 2) = '20'"),
    "prefix_not_equal_to": ("events", {"name": "t", "operator": "prefix_not_equal_to", "prefix": 1, "value": "c", "value_is_literal": True}, "left(t, 1) <> 'c'"),
    "suffix_equal_to": ("events", {"name": "t", "operator": "suffix_equal_to", "suffix": 1, "value": "K", "value_is_literal": True}, "lower(right(t, 1)) = 'k'"),
    "suffix_not_equal_to": ("events", {"name": "t", "operator": "suffix_not_equal_to", "suffix": 1, "value": "k", "value_is_literal": True}, "lower(right(t, 1)) <> 'k'"),
    "prefix_is_contained_by": ("events", {"name": "t", "operator": "prefix_is_contained_by", "prefix": 1, "value": ["c", "v"]}, "left(t, 1) IN ('c', 'v')"),
    "prefix_is_not_contained_by": ("events", {"name": "t", "operator": "prefix_is_not_contained_by", "prefix": 1, "value": ["c", "v"]}, "left(t, 1) NOT IN ('c', 'v')"),
    "suffix_is_contained_by": ("events", {"name": "t", "operator": "suffix_is_contained_by", "suffix": 1, "value": ["k", "w"]}, "right(t, 1) IN ('k', 'w')"),
    "suffix_is_not_contained_by": ("events", {"name": "t", "operator": "suffix_is_not_contained_by", "suffix": 1, "value": ["k", "w"]}, "right(t, 1) NOT IN ('k', 'w')"),
    "prefix_is_contained_by_case_insensitive": ("events", {"name": "t", "operator": "prefix_is_contained_by_case_insensitive", "prefix": 1, "value": ["C", "V"]}, "left(t, 1) IN ('c', 'v')"),
    "prefix_is_not_contained_by_case_insensitive": ("events", {"name": "t", "operator": "prefix_is_not_contained_by_case_insensitive", "prefix": 1, "value": ["C"]}, "left(t, 1) <> 'c'"),
    "suffix_is_contained_by_case_insensitive": ("events", {"name": "t", "operator": "suffix_is_contained_by_case_insensitive", "suffix": 1, "value": ["K"]}, "right(t, 1) = 'k'"),
    "suffix_is_not_contained_by_case_insensitive": ("events", {"name": "t", "operator": "suffix_is_not_contained_by_case_insensitive", "suffix": 1, "value": ["K"]}, "right(t, 1) <> 'k'"),
    "does_not_equal_string_part": ("events", {"name": "d7", "operator": "does_not_equal_string_part", "value": "iso", "regex": "^\\d{3}(\\d)"}, "d7 <> substr(iso, 4, 1)"),
    "is_substring_of": ("events", {"name": "d7", "operator": "is_substring_of", "value": "iso"}, "contains(iso, d7)"),
    "is_not_substring_of": ("events", {"name": "d7", "operator": "is_not_substring_of", "value": "iso"}, "NOT contains(iso, d7)"),
    "is_contained_by": ("events", {"name": "t", "operator": "is_contained_by", "value": ["click", "view"]}, "t IN ('click', 'view')"),
    "is_not_contained_by": ("events", {"name": "t", "operator": "is_not_contained_by", "value": ["click", "view"]}, "t NOT IN ('click', 'view')"),
    "is_contained_by_set": ("events", {"name": "x", "operator": "is_contained_by", "value": "$s2"}, f"list_contains({_L2}, x)", _SPLIT),
    "is_contained_by_case_insensitive": ("events", {"name": "t", "operator": "is_contained_by_case_insensitive", "value": ["CLICK"]}, "t = 'click'"),
    "is_not_contained_by_case_insensitive": ("events", {"name": "t", "operator": "is_not_contained_by_case_insensitive", "value": ["CLICK"]}, "t <> 'click'"),
    "contains_all": ("events", {"name": "$s1", "operator": "contains_all", "value": "$s2"}, f"len(list_filter({_L2}, lambda v: NOT list_contains({_L1}, v))) = 0", _SPLIT),
    "not_contains_all": ("events", {"name": "$s1", "operator": "not_contains_all", "value": "$s2"}, f"len(list_filter({_L2}, lambda v: NOT list_contains({_L1}, v))) > 0", _SPLIT),
    "shares_no_elements_with": ("events", {"name": "$s1", "operator": "shares_no_elements_with", "value": "$s2"}, f"len(list_filter({_L2}, lambda v: list_contains({_L1}, v))) = 0", _SPLIT),
    "is_ordered_subset_of": ("events", {"name": "$s1", "operator": "is_ordered_subset_of", "value": "$s2"}, "s1 = '' OR (s1 = 'a,b,c' AND s2 = 'a,b,c,d') OR (s1 = 'c' AND s2 LIKE '%c%')", _SPLIT),
    "is_not_ordered_subset_of": ("events", {"name": "$s1", "operator": "is_not_ordered_subset_of", "value": "$s2"}, "NOT (s1 = '' OR (s1 = 'a,b,c' AND s2 = 'a,b,c,d') OR (s1 = 'c' AND s2 LIKE '%c%'))", _SPLIT),
    "in_enumerated_columns": ("events", {"name": "x", "operator": "in_enumerated_columns", "value": "t"}, "t IN (x, x1, x2)"),
    "not_in_enumerated_columns": ("events", {"name": "x", "operator": "not_in_enumerated_columns", "value": "t"}, "t NOT IN (x, x1, x2)"),
    "date_equal_to": ("events", {"name": "p", "operator": "date_equal_to", "value": "q"}, f"length(p) = length(q) AND {_date('=')}"),
    "date_not_equal_to": ("events", {"name": "p", "operator": "date_not_equal_to", "value": "q"}, f"NOT {_VALID.format('p')} OR length(p) <> length(q) OR left(p, {_LEVEL}) <> left(q, {_LEVEL})"),
    "date_greater_than": ("events", {"name": "p", "operator": "date_greater_than", "value": "q"}, _date(">")),
    "date_less_than": ("events", {"name": "p", "operator": "date_less_than", "value": "q"}, _date("<")),
    "date_greater_than_or_equal_to": ("events", {"name": "p", "operator": "date_greater_than_or_equal_to", "value": "q"}, _date(">=")),
    "date_less_than_or_equal_to": ("events", {"name": "p", "operator": "date_less_than_or_equal_to", "value": "q"}, _date("<=")),
    "date_less_than_core1": ("events", {"name": "p", "operator": "date_less_than", "value": "q"}, f"p <> '' AND left(p, {_LEVEL}) < left(q, {_LEVEL})", None, True),
    "is_complete_date": ("events", {"name": "p", "operator": "is_complete_date"}, f"{_VALID.format('p')} AND length(p) >= 10"),
    "is_incomplete_date": ("events", {"name": "p", "operator": "is_incomplete_date"}, f"NOT ({_VALID.format('p')} AND length(p) >= 10)"),
    "invalid_date": ("events", {"name": "p", "operator": "invalid_date"}, f"NOT {_VALID.format('p')}"),
    "invalid_duration": ("events", {"name": "du", "operator": "invalid_duration", "negative": False}, "du IN ('P1.5Y2M', 'PT', '-P3W')"),
    "invalid_date_interval": ("events", {"name": "span", "operator": "invalid_date_interval"}, f"NOT ({_SPAN})"),
    "date_less_than_zones": ("events", {"name": "zoned", "operator": "date_less_than", "value": "iso2"}, f"{_ZONED} < CAST(replace(iso2, 'T', ' ') AS TIMESTAMP)"),
    "date_equal_to_zones": ("events", {"name": "zoned", "operator": "date_equal_to", "value": "iso2"}, f"{_ZONED} = CAST(replace(iso2, 'T', ' ') AS TIMESTAMP)"),
    "date_greater_than_or_equal_to_odd": ("events", {"name": "odd", "operator": "date_greater_than_or_equal_to", "value": "q"}, f"coalesce({_ODD} >= left(q, {_ODD_LEVEL}), false)"),
    "date_not_equal_to_odd": ("events", {"name": "odd", "operator": "date_not_equal_to", "value": "q"}, f"{_ODD} IS NULL OR {_ODD_LEVEL} <> 10 OR id % 7 = 5 OR {_ODD} <> q"),
    "invalid_date_odd": ("events", {"name": "odd", "operator": "invalid_date"}, "id % 7 IN (4, 6)"),
    "invalid_date_core1": ("events", {"name": "odd", "operator": "invalid_date"}, "id % 7 <> 5", None, True),
    "invalid_duration_core1": ("events", {"name": "du", "operator": "invalid_duration"}, "du IN ('PT', '-P3W')", None, True),
    "date_component_core1": ("events", {"name": "p", "operator": "date_equal_to", "value": "q", "date_component": "day"}, "length(p) >= 10 AND substr(p, 9, 2) = substr(q, 9, 2)", None, True),
    "date_component_hour_core1": ("events", {"name": "iso", "operator": "date_greater_than", "value": "iso2", "date_component": "hour"}, "substr(iso, 12, 2) > substr(iso2, 12, 2)", None, True),
    "is_not_unique_set": ("orders", {"name": "cust", "operator": "is_not_unique_set", "value": ["status", "prio"]}, "count(*) OVER (PARTITION BY cust, status, prio) > 1"),
    "is_unique_set": ("orders", {"name": "cust", "operator": "is_unique_set", "value": ["status", "prio"]}, "count(*) OVER (PARTITION BY cust, status, prio) = 1"),
    "is_not_unique_relationship": ("customer", {"name": "one", "operator": "is_not_unique_relationship", "value": "two"}, _TWO_WAYS),
    "is_unique_relationship": ("customer", {"name": "one", "operator": "is_unique_relationship", "value": "two"}, f"NOT ({_TWO_WAYS})"),
    "is_not_unique_relationship_core1": ("customer", {"name": "one", "operator": "is_not_unique_relationship", "value": "two"}, _TWO_WAYS.replace("one <> '' AND ", "").replace("two <> '' AND ", ""), None, True),
    "has_same_values": ("customer", {"not": {"name": "seg", "operator": "has_same_values"}}, "(SELECT count(DISTINCT c_mktsegment) FROM customer) > 1"),
    "present_on_multiple_rows_within": ("events", {"name": "t", "operator": "present_on_multiple_rows_within", "within": "u"}, "count(*) OVER (PARTITION BY u, t) > 1"),
    "not_present_on_multiple_rows_within": ("events", {"name": "q", "operator": "not_present_on_multiple_rows_within", "within": "u"}, "count(*) OVER (PARTITION BY u, q) = 1"),
    "is_inconsistent_across_dataset": ("customer", {"name": "seg", "operator": "is_inconsistent_across_dataset", "value": ["grp"]}, "min(seg) OVER (PARTITION BY grp) <> max(seg) OVER (PARTITION BY grp)"),
    "does_not_have_next_corresponding_record": ("events", {"name": "t", "operator": "does_not_have_next_corresponding_record", "value": "t", "within": "u", "ordering": "iso"}, f"lead(id) OVER ({_BY_U}) IS NOT NULL AND t <> lead(t) OVER ({_BY_U})"),
    "empty_within_except_last_row": ("events", {"name": "tb", "operator": "empty_within_except_last_row", "value": "u", "ordering": "iso"}, f"tb = '' AND lead(id) OVER ({_BY_U}) IS NOT NULL"),
    "target_is_not_sorted_by": ("orders", {"name": "k11", "operator": "target_is_not_sorted_by", "value": [{"name": "day", "sort_order": "asc", "null_position": "last"}], "within": "cust", "strict_incremental_ordering": True}, "k11 <> row_number() OVER (PARTITION BY cust ORDER BY day, id)"),
    "target_is_not_sorted_by_dashes": ("customer", {"name": "dash", "operator": "target_is_not_sorted_by", "value": [{"name": "seg", "sort_order": "desc"}], "within": "g7"}, "row_number() OVER (PARTITION BY g7 ORDER BY dash, id) <> row_number() OVER (PARTITION BY g7 ORDER BY seg DESC, dash, id)"),
    "target_is_not_sorted_by_whole": ("customer", {"name": "dash", "operator": "target_is_not_sorted_by", "value": [{"name": "seg"}]}, "row_number() OVER (ORDER BY dash, id) <> row_number() OVER (ORDER BY seg, dash, id)"),
    "target_is_not_sorted_by_whole_strict": ("customer", {"name": "g7", "operator": "target_is_not_sorted_by", "value": [{"name": "seg", "sort_order": "desc"}], "strict_incremental_ordering": True}, "CAST(g7 AS BIGINT) <> row_number() OVER (ORDER BY seg DESC, id)"),
    "target_is_not_sorted_by_core1": ("orders", {"name": "k11", "operator": "target_is_not_sorted_by", "value": [{"name": "day"}], "within": "cust"}, "row_number() OVER (PARTITION BY cust ORDER BY k11, day, id) <> row_number() OVER (PARTITION BY cust ORDER BY day, k11, id)", None, True),
    "is_not_ordered_set": ("orders", {"name": "day", "operator": "is_not_ordered_set", "value": "cust"}, "max(CASE WHEN day < before THEN 1 ELSE 0 END) OVER (PARTITION BY cust) = 1"),
    "is_not_ordered_set_blank": ("orders", {"name": "dayb", "operator": "is_not_ordered_set", "value": "cust"}, "dayb <> '' AND max(CASE WHEN dayb < before THEN 1 ELSE 0 END) OVER (PARTITION BY cust) = 1"),
    "is_not_ordered_set_whole": ("orders", {"name": "k11", "operator": "is_not_ordered_set"}, "max(CASE WHEN k11 < before THEN 1 ELSE 0 END) OVER () = 1"),
    "is_ordered_set": ("orders", {"name": "day", "operator": "is_ordered_set", "value": "cust"}, "max(CASE WHEN day < before THEN 1 ELSE 0 END) OVER (PARTITION BY cust) = 0"),
    "is_latest_available_external_dictionary_version": ("events", {"name": "rel", "operator": "is_latest_available_external_dictionary_version", "external_dictionary_type": "meddra", "version": "26.0"}, "rel >= '2023-03-01' AND rel < '2023-09-01'"),
    "is_not_latest_available_external_dictionary_version": ("events", {"name": "rel", "operator": "is_not_latest_available_external_dictionary_version", "external_dictionary_type": "meddra", "version": "26.0"}, "NOT (rel >= '2023-03-01' AND rel < '2023-09-01')"),
    "check_tree_kleene": ("events", {"any": [{"all": [{"name": "t", "operator": "equal_to", "value": "click", "value_is_literal": True}, {"not": {"name": "tb", "operator": "empty"}}]}, {"name": "zz", "operator": "equal_to", "value": "1"}]}, "t = 'click' AND tb <> ''"),
    # Operations, through the condition that reads the binding.
    "op_distinct": ("events", {"name": "d7", "operator": "is_not_contained_by", "value": "$v"}, "d7 NOT IN (SELECT CAST(event_id % 7 AS STRING) FROM events WHERE event_type = 'click' AND CAST(event_id % 7 AS STRING) IN ('1', '3'))", [Operation("$v", "distinct", {"name": "d7", "filter": {"t": "click", "d7": ["1", "3"]}})]),
    "op_distinct_grouped": ("customer", {"name": "seg", "operator": "is_contained_by", "value": "$v"}, "list_contains(array_agg(CASE WHEN g7 = '3' THEN seg END) OVER (PARTITION BY nation), seg)", [Operation("$v", "distinct", {"name": "seg", "group": ["nation"], "filter": {"g7": "3"}})]),
    "op_record_count": ("orders", {"name": "$n", "operator": "greater_than", "value": 4}, "sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY cust) > 4", [Operation("$n", "record_count", {"group": ["cust"], "filter": {"status": "F"}})]),
    "op_record_count_all": ("orders", {"name": "k11", "operator": "greater_than", "value": "$n"}, "k11 > (SELECT count(*) FROM orders WHERE o_orderpriority LIKE 'zz%')", [Operation("$n", "record_count", {"filter": {"prio": "zz&"}})]),
    "op_record_count_regex": ("events", {"name": "$n", "operator": "greater_than", "value": 320}, "count(*) OVER (PARTITION BY left(iso, 10)) > 320", [Operation("$n", "record_count", {"group": ["iso"], "regex": "\\d{4}-\\d{2}-\\d{2}"})]),
    "op_map_constant": ("events", {"name": "t", "operator": "equal_to", "value": "$v"}, "t = 'view'", [Operation("$v", "map", {"map": [{"output": "view"}]})]),
    "op_max_of_binding": ("orders", {"name": "$n", "operator": "equal_to", "value": "$m"}, "count(*) OVER (PARTITION BY cust) = (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) c)", [Operation("$n", "record_count", {"group": ["cust"]}), Operation("$m", "max", {"name": "$n"})]),
    "op_max": ("customer", {"name": "bal", "operator": "equal_to", "value": "$v"}, "bal = max(bal) OVER (PARTITION BY nation)", [Operation("$v", "max", {"name": "bal", "group": ["nation"]})]),
    "op_min": ("customer", {"name": "bal", "operator": "equal_to", "value": "$v"}, "bal = min(bal) OVER ()", [Operation("$v", "min", {"name": "bal"})]),
    "op_max_date": ("orders", {"name": "day", "operator": "date_equal_to", "value": "$v"}, "day = max(day) OVER (PARTITION BY cust)", [Operation("$v", "max_date", {"name": "day", "group": ["cust"]})]),
    "op_min_date": ("orders", {"name": "day", "operator": "date_equal_to", "value": "$v"}, "day = min(day) OVER (PARTITION BY cust)", [Operation("$v", "min_date", {"name": "day", "group": ["cust"]})]),
    "op_max_date_core1": ("orders", {"name": "dayx", "operator": "equal_to", "value": "$v"}, "dayx = max(CASE WHEN dayx NOT LIKE '%junk' THEN replace(dayx, ' ', 'T') END) OVER (PARTITION BY cust)", [Operation("$v", "max_date", {"name": "dayx", "group": ["cust"]})], True),
    "op_map": ("events", {"name": "$v", "operator": "equal_to", "value": "one", "value_is_literal": True}, "t = 'click' AND d7 = '1'", [Operation("$v", "map", {"map": [{"t": "click", "d7": 1, "output": "one"}, {"t": "view", "d7": 2, "output": "two"}]})]),
    "op_minus": ("events", {"name": "u", "operator": "is_contained_by", "value": "$v"}, f"u IN ({_USERS.format('click', 1)}) AND u NOT IN ({_USERS.format('error', 2)})", [*_BOTH, Operation("$v", "minus", {"name": "$a", "subtract": "$b"})]),
    "op_minus_ordered": ("events", {"name": "ref", "operator": "is_contained_by", "value": "$v"}, "ref = 'x2'", [Operation("$c", "get_column_order_from_dataset", {}), Operation("$v", "minus", {"name": "$c", "subtract": ["x1", "ref", "tb"]})]),
    "op_intersect": ("events", {"name": "u", "operator": "is_contained_by", "value": "$v"}, f"u IN ({_USERS.format('click', 1)}) AND u IN ({_USERS.format('error', 2)})", [*_BOTH, Operation("$v", "intersect", {"name": "$a", "subtract": "$b"})]),
    "op_split_by": ("events", {"name": "$s1", "operator": "contains", "value": "b"}, f"list_contains({_L1}, 'b')", _SPLIT),
    "op_variable_exists": ("events", {"all": [{"name": "$v", "operator": "equal_to", "value": True}, {"name": "d7", "operator": "equal_to", "value": "1", "value_is_literal": True}]}, "d7 = '1'", [Operation("$v", "variable_exists", {"name": "tb"})]),
    "op_get_column_order_from_dataset": ("events", {"name": "ref", "operator": "is_contained_by", "value": "$v"}, "ref <> 'none'", [Operation("$v", "get_column_order_from_dataset", {})]),
}


def _check(name: str) -> Callable[[SparkSession, str], DataFrame]:
    where, condition, _, *more = CHECKS[name]
    operations, core1 = (more[0] if more else None), len(more) > 1 and more[1]
    return lambda spark, sf_dir: flagged(base(spark, sf_dir, where), _rule(condition, operations, core1))


def _check_sql(name: str) -> str:
    where, _, predicate, *_ = CHECKS[name]
    rows = f"SELECT *, ({predicate}) AS hit FROM ({base_sql(where)}) b"
    if "before" in predicate:
        column, group = CHECKS[name][1]["name"], CHECKS[name][1].get("value")
        rows = f"SELECT *, ({predicate}) AS hit FROM (SELECT *, lag({column}) OVER ({'PARTITION BY ' + group if group else ''} ORDER BY id) AS before FROM ({base_sql(where)}) b0) b"
    return f"SELECT id FROM ({rows}) r WHERE hit"


# Joins, rule types and results over several tables.


def _raw(spark: SparkSession, sf_dir: str, table: str, order: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").withColumn(RECORD, F.col(order).cast("bigint") + 1)


def _table(spark: SparkSession, sf_dir: str, table: str, order: str) -> DataFrame:
    return normal_types(_raw(spark, sf_dir, table, order))


def ship_before_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of finished orders that shipped before their order: a keyed join and a date rule, melted into findings."""
    raw, orders = _raw(spark, sf_dir, "lineitem", "l_orderkey"), _table(spark, sf_dir, "orders", "o_orderkey")
    items = normal_types(raw)
    study = Study({"ORDERS": Dataset("ORDERS", orders)})
    rule = Rule(
        "SHIP_BEFORE_ORDER", {"all": [{"name": "l_shipdate", "operator": "date_less_than", "value": "o_orderdate"}, {"name": "l_linestatus", "operator": "equal_to", "value": "F", "value_is_literal": True}]},
        match_datasets=[{"Name": "ORDERS", "Keys": [{"Left": "l_orderkey", "Right": "o_orderkey"}]}],
    )
    data = Dataset("LINEITEM", items, raw=raw)
    table = Table(match(early(items, [rule], data), rule, data, study), data, study, "LI")
    verdict = table.add(Compiler(table, study, Dialect.CDISC).rule(rule)[0])
    sure = table.settled(F.coalesce(verdict, F.lit(False)))
    hits = table.df.filter(sure)
    pairs = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in ("l_linenumber", "l_shipdate")))
    return hits.select(F.lit(rule.id).alias("rule_id"), "l_orderkey", F.explode(pairs).alias("v")).select("rule_id", "l_orderkey", "v.variable", "v.value")


_SHIP = "replace(left(CAST({0} AS STRING), 19), ' ', 'T')"
SHIP_SQL = f"""
WITH hits AS (SELECT l_orderkey, CAST(l_linenumber AS STRING) AS n, {_SHIP.format('l_shipdate')} AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' AND l_shipdate < o_orderdate)
SELECT 'SHIP_BEFORE_ORDER' AS rule_id, l_orderkey, 'l_linenumber' AS variable, n AS value FROM hits UNION ALL SELECT 'SHIP_BEFORE_ORDER', l_orderkey, 'l_shipdate', s FROM hits
"""


def match_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with no order in status P: a declared left join keeps them, with a blank status."""
    rule = _rule({"name": "ORDERS.status", "operator": "empty"}, match_datasets=[{"Name": "ORDERS", "Keys": [{"Left": "key", "Right": "cust"}], "Join Type": "left"}])
    customers = base(spark, sf_dir, "customer").withColumn("key", F.col("id").cast("string"))
    orders = base(spark, sf_dir, "orders").filter("status = 'P'")
    return flagged(customers, rule, Study({"ORDERS": Dataset("ORDERS", orders)}))


MATCH_LEFT_SQL = "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"


def match_bigint_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers by whole numbers beyond 2^53, where neighbours are one double."""
    big = 9_007_199_254_740_992
    orders = base(spark, sf_dir, "orders").withColumn("key", F.col("cust").cast("bigint") + F.lit(big))
    customers = base(spark, sf_dir, "customer").withColumn("key", F.col("id") + F.lit(big))
    study = Study({"CUSTOMER": Dataset("CUSTOMER", customers)})
    rule = _rule({}, match_datasets=[{"Name": "CUSTOMER", "Keys": ["key"]}], core1=True)
    return match(orders, rule, Dataset("ORDERS", orders), study).select("id", F.col("`CUSTOMER.name`").alias("name"), F.col("`name`").alias("again"), F.col("key").cast("string").alias("key_text"))


BIGINT_SQL = "SELECT o_orderkey AS id, c_name AS name, c_name AS again, CAST(o_custkey + 9007199254740992 AS STRING) AS key_text FROM orders JOIN customer ON o_custkey = c_custkey"


def match_text_number_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join of a text with leading zeros and a number; columns of one name go by both orders."""
    orders = base(spark, sf_dir, "orders").withColumn("key", F.concat(F.lit("00"), F.col("cust")))
    customers = base(spark, sf_dir, "customer").withColumn("number", F.col("id"))
    rule = _rule({}, match_datasets=[{"Name": "CUSTOMER", "Keys": [{"Left": "key", "Right": "number"}]}], core1=True)
    out = match(orders, rule, Dataset("ORDERS", orders), Study({"CUSTOMER": Dataset("CUSTOMER", customers)}))
    return out.select("id", F.col("`CUSTOMER.id`").alias("customer"), F.col("`id.CUSTOMER`").alias("again"))


TEXT_NUMBER_SQL = "SELECT o_orderkey AS id, c_custkey AS customer, c_custkey AS again FROM orders JOIN customer ON o_custkey = c_custkey"


def supp_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' first texts by role as columns of their first turn, as supplemental qualifiers are joined."""
    turns = _table(spark, sf_dir, "conversations", "turn")
    parents = turns.groupBy("conv_id").agg(F.min(RECORD).alias(RECORD)).withColumn("DOMAIN", F.lit("CV"))
    supp = turns.select(F.lit("CV").alias("RDOMAIN"), F.lit("conv_id").alias("IDVAR"), F.col("conv_id").cast("string").alias("IDVARVAL"), F.col("role").alias("QNAM"), F.col("text").alias("QVAL"), RECORD)
    study = Study({"SUPPCV": Dataset("SUPPCV", supp)})
    out = match(parents, _rule({}, match_datasets=[{"Name": "SUPPCV"}]), Dataset("CV", parents, domain_value="CV"), study)
    return out.select("conv_id", F.length("user").cast("bigint").alias("user_chars"), F.length("assistant").cast("bigint").alias("assistant_chars"))


SUPP_SQL = """
SELECT conv_id, CAST(length(min_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END)) AS BIGINT) AS user_chars,
       CAST(length(min_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END)) AS BIGINT) AS assistant_chars FROM conversations GROUP BY conv_id
"""


def child_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label with the document it names, by a key that the rows themselves declare."""
    labels = _table(spark, sf_dir, "labels", "doc_id").select(F.lit("DC").alias("RDOMAIN"), F.lit("DOCID").alias("IDVAR"), F.col("doc_id").cast("string").alias("IDVARVAL"), "toxic", RECORD)
    docs = _table(spark, sf_dir, "documents", "doc_id").select(F.lit("DC").alias("DOMAIN"), F.col("doc_id").alias("DOCID"), "lang", "source", RECORD)
    study = Study({"DC": Dataset("DC", docs, domain_value="DC")})
    out = match(labels, _rule({}, match_datasets=[{"Name": "LB", "Child": True}]), Dataset("LB", labels), study)
    return out.select(F.col("IDVARVAL").cast("bigint").alias("doc_id"), "toxic", "lang", "source")


CHILD_SQL = "SELECT l.doc_id, l.toxic, d.lang, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id"


def relrec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders related to customers by a relationship table over whole domains."""
    orders, customers = base(spark, sf_dir, "orders").withColumn("DOMAIN", F.lit("OD")), base(spark, sf_dir, "customer").withColumn("DOMAIN", F.lit("CU")).withColumn("key", F.col("id").cast("string"))
    rows = [("OD", "", "cust", "", "1", 1), ("CU", "", "key", "", "1", 2)]
    rel = spark.createDataFrame(rows, f"RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, RELID string, {RECORD} bigint")
    study = Study({"OD": Dataset("OD", orders, domain_value="OD"), "CU": Dataset("CU", customers, domain_value="CU"), "RELREC": Dataset("RELREC", rel)})
    out = match(orders, _rule({}, match_datasets=[{"Name": "RELREC", "Keys": ["USUBJID"]}]), study.get("OD"), study)
    return out.filter(F.col("`RELREC.seg`") == "BUILDING").select("id", F.col("`RELREC.name`").alias("name"))


RELREC_SQL = "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"


#: The variables of a customer, their types and declared lengths.
_CUSTOMER = {"c_custkey": ("Num", 8), "c_name": ("Char", 20), "c_nationkey": ("Num", 8), "c_acctbal": ("Num", 8), "c_mktsegment": ("Char", 10)}
_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _text_sql(column: str) -> str:
    """A value as text; whole numbers without a point."""
    return f"regexp_replace(CAST({column} AS STRING), '\\.0$', '')" if column in ("c_acctbal", "p_retailprice") else f"CAST({column} AS STRING)"


def _customer_dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset("CUSTOMER", _table(spark, sf_dir, "customer", "c_custkey").select(*_CUSTOMER, RECORD), [VariableMeta(n, "", *about) for n, about in _CUSTOMER.items()])


def unpivot_value_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value Check with Variable Metadata: values longer than nine characters, one row per record and variable."""
    from .plans.reshape import as_table, build

    d = _customer_dataset(spark, sf_dir)
    rule = _rule({"name": "variable_value", "operator": "longer_than", "value": 9}, rule_type="Value Check with Variable Metadata")
    study = Study({"CUSTOMER": d})
    table = as_table(build(rule, d, study), d, study, Dialect.CDISC)
    verdict = table.add(Compiler(table, study, Dialect.CDISC).rule(rule)[0])
    return table.df.filter(verdict).select(F.col(RECORD).alias("record"), "variable_name", "variable_value", F.col("variable_size").cast("bigint").alias("declared"))


UNPIVOT_SQL = "SELECT c_custkey + 1 AS record, variable_name, variable_value, declared FROM (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{c}' AS variable_name, {_text_sql(c)} AS variable_value, CAST({n} AS BIGINT) AS declared FROM customer" for c, (_, n) in _CUSTOMER.items()) + ") u WHERE length(variable_value) > 9"


def variable_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable Metadata Check: one row per variable, emptiness found in one pass."""
    from .plans.reshape import build

    d = _customer_dataset(spark, sf_dir)
    rule = _rule({"name": "variable_has_empty_values", "operator": "exists"}, rule_type="Variable Metadata Check")
    out = build(rule, d, Study({"CUSTOMER": d}))
    return out.select("variable_name", "variable_data_type", F.col("variable_order_number").cast("bigint").alias("place"), "variable_has_empty_values")


VARIABLE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS variable_name, '{t}' AS variable_data_type, CAST({i} AS BIGINT) AS place, CASE WHEN count(*) > count({c if t == 'Num' else f"nullif({c}, '')"}) THEN 'True' ELSE 'False' END AS variable_has_empty_values FROM customer" for i, (c, (t, _)) in enumerate(_CUSTOMER.items(), 1))


def global_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global Value Check: longest value per variable name over several datasets."""
    from .plans.reshape import global_lengths

    part = _table(spark, sf_dir, "part", "p_partkey").select(*_PART, RECORD)
    out = global_lengths(Study({"CUSTOMER": _customer_dataset(spark, sf_dir), "PART": Dataset("PART", part)}))
    return out.select("variable_name", F.col("variable_max_value_length").cast("bigint").alias("longest"))


GLOBAL_SQL = " UNION ALL ".join(f"SELECT '{c}' AS variable_name, CAST(max(length({_text_sql(c)})) AS BIGINT) AS longest FROM {'customer' if c in _CUSTOMER else 'part'}" for c in (*_CUSTOMER, *_PART))


def _study_run(spark: SparkSession, sf_dir: str, most: int | None):
    """Two rules fused over events and one over orders."""
    from .runner import run

    study = Study({n.upper(): base_dataset(spark, sf_dir, n) for n in ("events", "orders")})
    on = {"Include": ["EVENTS"]}
    rules = [
        Rule("EV1", {"name": "tb", "operator": "empty"}, output=["id", "tb"], domains=on, message="Type is required"),
        Rule("EV2", {"name": "p", "operator": "invalid_date"}, output=["p"], domains=on, message="Date is not valid"),
        Rule("EV3", {"name": "zz", "operator": "equal_to", "value": "1"}, domains=on),
        Rule("OD1", {"name": "status", "operator": "equal_to", "value": "P", "value_is_literal": True}, output=["status"], domains={"Include": ["ORDERS"]}, message="Pending", sensitivity="Dataset"),
    ]
    return run(spark, rules, study, most)


def findings_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of fused rules, one row per record and variable, with triage."""
    return _study_run(spark, sf_dir, None).findings.select("Dataset", "Record", "Variable", "Value", "issue", "triage", "rule_id")


MELT_SQL = f"""
WITH e AS ({base_sql('events')})
SELECT 'EVENTS' AS "Dataset", id + 1 AS "Record", 'id' AS "Variable", CAST(id AS STRING) AS "Value", 'Type is required' AS issue, 'wrong value' AS triage, 'EV1' AS rule_id FROM e WHERE tb = ''
UNION ALL SELECT 'EVENTS', id + 1, 'tb', '', 'Type is required', 'wrong value', 'EV1' FROM e WHERE tb = ''
UNION ALL SELECT 'EVENTS', id + 1, 'p', p, 'Date is not valid', 'wrong value', 'EV2' FROM e WHERE NOT {_VALID.format('p')}
UNION ALL SELECT DISTINCT 'ORDERS', CAST(NULL AS BIGINT), 'status', 'P', 'Pending', 'wrong value', 'OD1' FROM orders WHERE o_orderstatus = 'P'
"""


def max_records_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped findings: the first 50 records of each rule and dataset (the cap is the feature)."""
    return _study_run(spark, sf_dir, 50).findings.select("rule_id", "Record", "Variable").filter("Record is not null")


TOPK_SQL = f"""
WITH e AS ({base_sql('events')}), h AS (
  SELECT 'EV1' AS rule_id, id + 1 AS "Record" FROM e WHERE tb = '' UNION ALL SELECT 'EV2', id + 1 FROM e WHERE NOT {_VALID.format('p')}),
k AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY "Record") AS n FROM h)
SELECT rule_id, "Record", v AS "Variable" FROM k JOIN (SELECT 'EV1' AS r, 'id' AS v UNION ALL SELECT 'EV1', 'tb' UNION ALL SELECT 'EV2', 'p') x ON r = rule_id WHERE n <= 50
"""


def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cap cut: true counts per rule and dataset."""
    return _study_run(spark, sf_dir, 50).truncated


TRUNCATED_SQL = f"""
WITH e AS ({base_sql('events')}) SELECT 'EV1' AS rule_id, 'EVENTS' AS domain, count(*) AS records_found, CAST(50 AS BIGINT) AS records_kept FROM e WHERE tb = '' HAVING count(*) > 50
UNION ALL SELECT 'EV2', 'EVENTS', count(*), 50 FROM e WHERE NOT {_VALID.format('p')} HAVING count(*) > 50
"""


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem summary: records and variables per rule and dataset."""
    from .results import problem_summary

    return problem_summary(_study_run(spark, sf_dir, None).findings).select("Dataset", "rule_id", "triage", "records", "variables")


PROBLEMS_SQL = f"""
WITH e AS ({base_sql('events')})
SELECT 'EVENTS' AS "Dataset", 'EV1' AS rule_id, 'wrong value' AS triage, count(*) AS records, 'id, tb' AS variables FROM e WHERE tb = ''
UNION ALL SELECT 'EVENTS', 'EV2', 'wrong value', count(*), 'p' FROM e WHERE NOT {_VALID.format('p')}
UNION ALL SELECT 'ORDERS', 'OD1', 'wrong value', CAST(1 AS BIGINT), 'status' FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0
"""


def triage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way a level of triage is reached, one rule each: by the findings per rule."""
    from .runner import run

    on = {"Include": ["EVENTS"]}

    def rule(name: str, check: dict, output: list[str], message: str, **more: object) -> Rule:
        return Rule(name, check, output=output, domains=on, message=message, **more)

    absent = {"all": [{"name": "ZZ", "operator": "not_exists"}, {"name": "t", "operator": "equal_to", "value": "click", "value_is_literal": True}]}
    rules = [
        rule("T1", {"name": "t", "operator": "equal_to", "value": "click", "value_is_literal": True}, ["t"], "Type is required"),
        rule("T2", absent, ["t", "ZZ"], "ZZ should be present"),
        rule("T3", absent, ["t", "ZZ"], "ZZ is missing"),
        rule("T4", {"all": [*absent["all"], {"name": "d7", "operator": "less_than", "value": 2}]}, ["t", "ZZ"], "ZZ is missing"),
        rule("T5", {"name": "tb", "operator": "empty"}, ["tb"], "Type is blank"),
        rule("T6", {"name": "tb", "operator": "empty"}, ["tb"], "An expected type is blank"),
        rule("T7", {"name": "tb", "operator": "empty"}, ["$required", "tb"], "Variables", operations=[Operation("$required", "distinct", {"name": "tb", "filter": {"d7": "9"}})]),
        rule("T8", {"name": "USUBJID", "operator": "is_not_unique_set", "value": ["t"]}, ["USUBJID"], "Subjects are not unique"),
        rule("T9", {"name": "ZZ", "operator": "not_exists"}, ["ZZ"], "ZZ is not there"),
        rule("TP", {"name": "TA", "operator": "not_exists"}, [], "The dataset must not be present", rule_type="Domain Presence Check"),
        rule("TQ", {"name": "TA", "operator": "not_exists"}, [], "TA is missing", rule_type="Domain Presence Check"),
    ]
    events = base(spark, sf_dir, "events").withColumn("USUBJID", F.col("u"))
    found = run(spark, rules, Study({"EVENTS": Dataset("EVENTS", events)}), None).findings
    return found.groupBy("rule_id", "triage").agg(F.count(F.lit(1)).alias("findings"))


_TRIAGE = [("T1", "wrong value", 1, "t = 'click'"), ("T2", "missing required", 2, "t = 'click'"), ("T3", "missing required", 2, "t = 'click'"), ("T4", "wrong value", 2, "t = 'click' AND TRY_CAST(d7 AS DOUBLE) < 2"),
           ("T5", "missing required", 1, "tb = ''"), ("T6", "missing optional", 1, "tb = ''"), ("T7", "missing required", 2, "tb = ''"), ("T9", "missing optional", 1, "true")]
TRIAGE_SQL = f"WITH e AS ({base_sql('events')}) " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{level}' AS triage, {n} * count(*) AS findings FROM e WHERE {test}" for r, level, n, test in _TRIAGE) + """
UNION ALL SELECT 'T8', 'wrong value', count(*) FROM (SELECT count(*) OVER (PARTITION BY u, t) AS n FROM e) c WHERE n > 1
UNION ALL SELECT 'TP', 'wrong value', 1 UNION ALL SELECT 'TQ', 'missing required', 1
"""


def skipped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules left out, with the reason."""
    return _study_run(spark, sf_dir, None).skipped


SKIPPED_SQL = "SELECT 'EV3' AS rule_id, 'EVENTS' AS domain, 'needs zz, which this dataset does not have' AS reason"

def study_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks above as one run over three datasets, fused by dataset and dialect: findings per rule."""
    from .runner import run

    rules = [
        Rule(name, condition, operations=(more[0] if more else None) or [], source="core_contributor" if len(more) > 1 and more[1] else "", domains={"Include": [where.upper()]}, output=["id"])
        for name, (where, condition, _, *more) in CHECKS.items()
    ]
    study = Study({b.upper(): Dataset(b.upper(), base(spark, sf_dir, b)) for b in BASES})
    return run(spark, rules, study, None).findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


STUDY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS rule_id, count(*) AS findings FROM ({_check_sql(n)}) c HAVING count(*) > 0" for n in CHECKS)

_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ship_before_order": (ship_before_order, SHIP_SQL), "match_left": (match_left, MATCH_LEFT_SQL), "match_bigint_key": (match_bigint_key, BIGINT_SQL), "match_text_number_key": (match_text_number_key, TEXT_NUMBER_SQL), "supp_pivot": (supp_pivot, SUPP_SQL), "child_parent": (child_parent, CHILD_SQL), "relrec": (relrec, RELREC_SQL),
    "unpivot_value_check": (unpivot_value_check, UNPIVOT_SQL), "variable_metadata": (variable_metadata, VARIABLE_SQL), "global_length": (global_length, GLOBAL_SQL), "findings_melt": (findings_melt, MELT_SQL),
    "max_records_topk": (max_records_topk, TOPK_SQL), "truncated": (truncated, TRUNCATED_SQL), "problem_summary": (problems, PROBLEMS_SQL), "skipped_ledger": (skipped_ledger, SKIPPED_SQL), "triage_levels": (triage_levels, TRIAGE_SQL), "study_run": (study_run, STUDY_SQL),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _check(n) for n in CHECKS} | {n: q for n, (q, _) in _MORE.items()}
ORACLE_SQL: dict[str, str] = {n: _check_sql(n) for n in CHECKS} | {n: s for n, (_, s) in _MORE.items()}
