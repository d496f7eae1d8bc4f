"""Conditions that can be tested as the rows are read: those of a rule's own columns against its own values.

From a Check follows what a row must meet to violate it, whatever the other
conditions say, as long as none of them looks at other rows. Rules that share a
pass keep the rows that one of them may need. The tests are plain comparisons,
so that they reach the scan, and stand before the join if there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Dataset, Dialect, Rule
from ..operators import OPERATORS
from ..sources.frame import normal_types
from ..operators.registry import ANSWERS_MISSING
from .table import kind_of, wildcard

#: Modules of operators that look at one row at a time, and what they hold that does not.
_ROW_MODULES = {"compare", "strings", "presence", "sets", "dates"}
_WHOLE_TABLE = {"contains_all", "not_contains_all"}
_ORDER = {"less_than": Column.__lt__, "less_than_or_equal_to": Column.__le__, "greater_than": Column.__gt__, "greater_than_or_equal_to": Column.__ge__}


def _leaves(node: dict) -> list[dict]:
    if "operator" in node:
        return [node]
    return [x for key in ("all", "any") for n in node.get(key) or [] for x in _leaves(n)] + (_leaves(node["not"]) if node.get("not") else [])


def row_by_row(c: dict) -> bool:
    fn = OPERATORS.get(c["operator"])
    return fn is not None and c["operator"] not in _WHOLE_TABLE and fn.__module__.rpartition(".")[2] in _ROW_MODULES


def _plain(c: dict, name: str, kinds: dict[str, str]) -> Column | None:
    """The condition as a comparison of a column with values, if it is one.

    Texts may be tested as they were read, where NULL is not yet an empty text.
    """
    value, kind, op = c.get("value"), kinds[name], c["operator"]
    col = F.col(f"`{name}`")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if op == "empty" and kind in ("text", "num"):
        return col.isNull() | (col == "") if kind == "text" else col.isNull()
    if op == "non_empty" and kind in ("text", "num"):
        return col != "" if kind == "text" else col.isNotNull()
    if op == "equal_to" and not c.get("type_insensitive"):
        if kind == "text" and c.get("value_is_literal") is True and isinstance(value, str) and value:
            return col == F.lit(value)
        if kind == "num" and number and not c.get("value_is_reference"):
            return col.cast("double") == F.lit(float(value))
    if op == "is_contained_by" and kind == "text" and isinstance(value, list) and value and all(isinstance(v, str) and v and not v.startswith("$") for v in value):
        return col.isin(value)
    if op in _ORDER and kind == "num" and number:
        return _ORDER[op](col.cast("double"), F.lit(float(value)))
    return None


def needed(node: dict, kinds: dict[str, str], prefix: str, joined: bool, names: set[str]) -> Column | None:
    """What every row that violates the Check meets, or None if that cannot be told; ``names`` takes the columns it reads.

    Where no join adds columns, a condition on one that is not there cannot be met:
    such a rule is refused, or in ``any`` goes by its other conditions.
    """
    if "operator" in node:
        name = str(node.get("name"))
        name = prefix + name[2:] if name.startswith("--") else name
        if name in kinds:
            test = _plain(node, name, kinds)
            if test is not None:
                names.add(name)
            return test
        plain = not joined and "." not in name and not name.startswith("$") and node["operator"] not in ANSWERS_MISSING
        return F.lit(False) if plain else None
    parts = [needed(n, kinds, prefix, joined, names) for n in node.get("all") or node.get("any") or []]
    if node.get("all"):
        known = [p for p in parts if p is not None]
        return reduce(Column.__and__, known) if known else None
    return reduce(Column.__or__, parts) if parts and all(p is not None for p in parts) else None


def _changes_columns(rule: Rule) -> bool:
    """Whether a join may fill the rule's own columns from another dataset."""
    specs = [(str(s.get("Name") or s.get("name") or "").upper(), s.get("Child") or s.get("child")) for s in rule.match_datasets]
    return any(child or name.startswith(("SUPP", "SQ")) for name, child in specs)


def early(rows: DataFrame, rules: list[Rule], d: Dataset) -> DataFrame:
    """The rows that may violate one of the rules, which share their rows and joins."""
    kinds, names, tests = {f.name: kind_of(f.dataType) for f in rows.schema}, set(), []
    for rule in rules:
        if rule.operations or rule.dialect is Dialect.CORE1 or _changes_columns(rule) or not all(map(row_by_row, _leaves(rule.check))):
            return rows
        test = needed(rule.check, kinds, wildcard(d), bool(rule.match_datasets), names)
        if test is None:
            return rows
        tests.append(test)
    test = reduce(Column.__or__, tests)
    if d.raw is None or rows is not d.df or any(d.raw.schema[n].dataType != rows.schema[n].dataType for n in names):
        return rows.filter(test)
    return normal_types(d.raw.filter(test))
