"""Inputs that a rule needs before it may judge: without them a condition would compare with nothing and find faults that are none."""

from __future__ import annotations

from ..model import Rule, RuleSkipped, Study
from ..results import conditions
from .table import Table

#: Fields that some rule types give and others do not (fixed names).
_GIVEN_BY_TYPE = ("define_dataset_class", "define_dataset_is_non_standard", "define_key_sequence_is_unique", "variable_length")


def _named(rule: Rule) -> list[str]:
    return [str(c["name"]) for c in conditions(rule.check)] if isinstance(rule.check, dict) and rule.check else []


def _compared(rule: Rule) -> list[str]:
    values = [c.get("value") for c in conditions(rule.check)] if isinstance(rule.check, dict) and rule.check else []
    return [v for v in values if isinstance(v, str)]


def check_inputs(rule: Rule, table: Table, study: Study) -> None:
    """Refuse a rule whose define, library metadata or labels are not there."""
    if "Define" in rule.rule_type and study.define is None:
        raise RuleSkipped(f"rule type '{rule.rule_type}' needs define.xml, which this study does not have")
    named = _named(rule)
    library = [n for n in dict.fromkeys([*named, *_compared(rule), *rule.output]) if n.startswith("library_") and not table.has(n)]
    if library:
        raise RuleSkipped(f"needs variable metadata of the library, which is not loaded for this rule type: {', '.join(library)}")
    absent = [n for n in dict.fromkeys(named) if n in _GIVEN_BY_TYPE and not table.has(n)]
    if absent:
        raise RuleSkipped(f"needs metadata that this rule type does not give: {', '.join(absent)}")
    d = table.dataset
    if "variable_label" in named and d is not None and not d.file_name and not any(v.label.strip() for v in d.variables):
        raise RuleSkipped(f"compares variable labels, and {d.name} has none at all")
