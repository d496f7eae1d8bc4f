"""From a Check tree to one boolean Column over a Table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Dialect, MissingColumn, Rule, RuleSkipped, Study
from ..operators import get
from ..operators.registry import ANSWERS_MISSING
from .operations import compute, materialised
from .table import Context, Operand, Table, literal

#: Operators that compare sets by joins and never need the value (or the target) as one array.
_BY_JOIN = {"is_contained_by", "is_not_contained_by", "is_contained_by_case_insensitive", "is_not_contained_by_case_insensitive", "contains_all", "not_contains_all", "shares_no_elements_with"}
_TARGET_BY_JOIN = {"contains_all", "not_contains_all", "shares_no_elements_with", "empty", "non_empty"}


class Compiler:
    """Compiles the checks of one table; bindings are computed when first asked for and once per definition."""

    def __init__(self, table: Table, study: Study, dialect: Dialect):
        self.table, self.study, self.dialect = table, study, dialect
        self._seen: dict[str, Operand | None] = {}

    def rule(self, rule: Rule) -> tuple[Column, list[str]]:
        """The violation (NULL: undecided), and the reasons why rows may be undecided."""
        self.operations = {o.id: o for o in rule.operations}
        self.table.bindings = {}
        for op in rule.operations:  # in order of declaration, as later ones use earlier ones
            self._bind(op.id)
        self.unresolved: list[str] = []
        return self._node(rule.check), self.unresolved

    def _bind(self, name: str) -> Operand | None:
        if name not in self.table.bindings:
            op = self.operations.get(name)
            if op is None:
                return None
            key = repr((op.operator, sorted(op.options.items(), key=lambda kv: kv[0])))
            fresh = any(isinstance(v, str) and v.startswith("$") for v in op.options.values())
            if key not in self._seen or fresh:
                self._seen[key] = compute(op, self.table, self.study, self.dialect)
            self.table.bindings[name] = self._seen[key]
        return self.table.bindings[name]

    def _node(self, node: dict) -> Column:
        if "name" in node and "operator" in node:
            return self._leaf(node)
        if node.get("all"):
            return reduce(Column.__and__, [self._node(n) for n in node["all"]])
        if node.get("any"):
            parts, missing = [], []
            for n in node["any"]:
                try:
                    parts.append(self._node(n))
                except MissingColumn as e:
                    missing.append(e.column)
            if not parts:
                raise MissingColumn(", ".join(dict.fromkeys(missing)))
            return reduce(Column.__or__, parts)
        if node.get("not"):
            return ~self._node(node["not"])
        empty = [k for k in ("all", "any", "not") if k in node]
        raise RuleSkipped(f"the rule's Check block is empty ({', '.join(empty)} with no conditions under it)" if empty else f"Unrecognized Check node: {', '.join(node)}")

    def column(self, name: str) -> Operand:
        t = self.table
        return Operand(t.col(name), t.kind(name), per_row=True, column=name, as_text=t.text(name))

    def _reference(self, name: str) -> Operand | None:
        """The value, row by row, of the column that each row names."""
        t = self.table
        name = t.resolve(name)
        if not t.has(name):
            return None
        named, out, none = t.col(name), F.lit(None).cast("string"), F.lit(True)
        for c in t.names:
            hit = F.upper(named) == c.upper() if self.dialect is Dialect.CORE1 else named == c
            out, none = F.when(hit, tx.text_of(t.col(c), t.kind(c))).otherwise(out), none & ~F.coalesce(hit, F.lit(False))
        return Operand(out, "text", per_row=True, no_column=none if self.dialect is Dialect.CORE1 else None)

    def _wild(self, name: str) -> Operand | None:
        """RELREC.**TERM: the partner domain's variable, whichever it is."""
        prefix, _, tail = name.partition(".**")
        cols = [c for c in self.table.names if re.fullmatch(re.escape(prefix) + r"\.[A-Z]{2}" + re.escape(tail), c)]
        if not cols:
            return None
        return Operand(F.coalesce(*(F.when(tx.text_of(self.table.col(c), self.table.kind(c)) != "", tx.text_of(self.table.col(c), self.table.kind(c))) for c in cols), F.lit("")), "text", per_row=True)

    def _value(self, c: dict) -> Operand | None:
        value, t = c.get("value"), self.table
        if value is None:
            return None
        if c.get("value_is_reference"):
            return self._reference(str(value))
        if c.get("value_is_literal"):
            return literal(value)
        if isinstance(value, list) and len(value) == 1 and isinstance(value[0], str) and value[0].startswith("$"):
            value = value[0]
        if isinstance(value, str):
            if value.startswith("$"):
                bound = self._bind(value)
                if bound is None:
                    self.unresolved.append(f"{value} could not be computed for this dataset")
                    return None
                return bound if c["operator"] in _BY_JOIN else materialised(bound, t)
            if ".**" in value:
                return self._wild(value)
            found = t.find(value, self.dialect)
            if found:
                return self.column(found)
            if value in self.operations:
                bound = self._bind(value)
                return bound and materialised(bound, t)
        return literal(value)

    def _leaf(self, c: dict) -> Column:
        name, op, t = c["name"], c["operator"], self.table
        binding = False
        if isinstance(name, str) and name.startswith("$"):
            bound = self._bind(name)
            binding, target, exists = True, bound if bound is None or op in _TARGET_BY_JOIN else materialised(bound, t), bound is not None
        elif isinstance(name, str) and ".**" in name:
            target = self._wild(name)
            exists, binding = target is not None, True
        else:
            found = t.find(str(name), self.dialect)
            name = found or t.resolve(str(name))
            exists, target = found is not None, self.column(found) if found else None
            if not exists and op in ("exists", "not_exists"):
                exists = self.study.define is not None if name == "define.xml" else any(name.upper() in (d.name.upper(), d.domain) for d in self.study.datasets.values())
        if self.dialect is Dialect.CORE1 and not exists and not binding and op not in ("exists", "not_exists"):
            return F.lit(False)
        if not exists and not binding and op not in ANSWERS_MISSING:
            raise MissingColumn(name)
        ctx = Context(name, exists, target, self._value(c), c, t, self.dialect, self.unresolved)
        return get(op)(ctx)
