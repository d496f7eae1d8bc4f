"""Checks on streams.

Row-local rules are plain Columns and run on a stream as they run on a table;
counts per group run as watermarked window aggregates. Rules that need the order
of records, the whole dataset or another one stay with batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import RECORD, Dataset, Rule, RuleSkipped, Study
from ..plans.evaluate import Compiler
from ..plans.table import Table
from ..sources.frame import normal_types

#: Operators whose verdict hangs on more than the row itself.
NOT_LOCAL = {
    "is_not_unique_set", "is_unique_set", "is_not_unique_relationship", "is_unique_relationship", "has_same_values", "present_on_multiple_rows_within", "not_present_on_multiple_rows_within",
    "is_inconsistent_across_dataset", "does_not_have_next_corresponding_record", "empty_within_except_last_row", "target_is_not_sorted_by", "is_not_ordered_set", "is_ordered_set",
}


def _operators(node: dict) -> set[str]:
    if "operator" in node:
        return {node["operator"]}
    out: set[str] = set()
    for k in ("all", "any"):
        for n in node.get(k) or []:
            out |= _operators(n)
    return out | (_operators(node["not"]) if node.get("not") else set())


def violations(stream: DataFrame, rules: list[Rule], domain: str, keys: list[str]) -> DataFrame:
    """(rule_id, keys) of each row of a stream that violates a row-local rule."""
    for r in rules:
        if _operators(r.check) & NOT_LOCAL or r.operations or r.match_datasets:
            raise RuleSkipped(f"{r.id} needs more than the row itself")
    # No record numbers on a stream; keys tell the rows.
    rows = normal_types(stream.drop(RECORD))
    data, study = Dataset(domain, rows), Study()
    table = Table(rows, data, study, domain[:2])
    slots = []
    for r in rules:
        verdict, _ = Compiler(table, study, r.dialect).rule(r)
        slots.append(F.when(F.coalesce(verdict, F.lit(False)), F.lit(r.id)))
    out = table.df.select(*keys, F.explode(F.filter(F.array(*slots), lambda x: x.isNotNull())).alias("rule_id"))
    return out.select("rule_id", *keys)


def violation_counts(found: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Violations per rule and window of event time; rows later than ``late`` are left out."""
    return found.withWatermark(time, late).groupBy("rule_id", F.window(time, window)).count().select("rule_id", F.col("window.start").alias("start"), "count")
