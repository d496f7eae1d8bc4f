"""Rule files to rules, and the catalogue as a table."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path

from .model import Operation, Rule
from .plans import scope

_FLAGS = ("value_is_literal", "negative", "value_is_reference", "include_split_datasets", "type_insensitive", "where_populated", "strict_incremental_ordering", "case_insensitive")


def _flag(v: object) -> object:
    return {"true": True, "yes": True, "y": True, "false": False, "no": False, "n": False}.get(v.strip().lower(), v) if isinstance(v, str) else v


def _check(node: object) -> dict:
    if not isinstance(node, dict):
        raise ValueError(f"not a Check node: {node!r}")
    out = dict(node)
    for k in ("all", "any"):
        if k in out:
            out[k] = [_check(n) for n in out[k] or []]
    if "not" in out:
        out["not"] = _check(out["not"][0] if isinstance(out["not"], list) else out["not"])
    for k in _FLAGS:
        if k in out:
            out[k] = _flag(out[k])
    return out


def _list(v: object) -> list:
    return [] if v is None else v if isinstance(v, list) else [v]


def parse_rule(raw: dict, source: str = "") -> Rule:
    core, outcome, scope_ = raw.get("Core") or {}, raw.get("Outcome") or {}, raw.get("Scope") or {}
    standards, authorities = [], []
    for a in _list(raw.get("Authorities")):
        authorities.append(str(a.get("Organization", "")))
        standards += [(str(s.get("Name", "")), str(s.get("Version", "")), str(s.get("Substandard") or "")) for s in _list(a.get("Standards"))]
    operations = [Operation(str(o["id"]), str(o["operator"]), {k: v for k, v in o.items() if k not in ("id", "operator")}) for o in _list(raw.get("Operations"))]
    use_cases = [u.strip() for x in _list(scope_.get("Use Case")) for u in str(x).split(",")]
    return Rule(
        id=str(core.get("Id") or raw.get("id") or ""), check=raw["Check"] if isinstance(raw["Check"], str) else _check(raw["Check"]), rule_type=str(raw.get("Rule Type") or "Record Data"), sensitivity=str(raw.get("Sensitivity") or "Record"),
        operations=operations, match_datasets=_list(raw.get("Match Datasets")), output=[str(v) for v in _list(outcome.get("Output Variables"))], message=" ".join(str(outcome.get("Message") or "").split()),
        description=" ".join(str(raw.get("Description") or "").split()), classes=scope_.get("Classes") or {}, domains=scope_.get("Domains") or {}, entities=scope_.get("Entities") or {},
        use_cases=use_cases, standards=standards, authorities=authorities, grouping=_list(raw.get("Grouping_Variables")), executability=str(raw.get("Executability") or ""),
        status=str(core.get("Status") or "Published"), source=str(raw.get("source") or source),
    )


def load_rule(path: str | Path) -> Rule:
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return parse_rule(json.loads(text))
    import yaml

    return parse_rule(yaml.safe_load(text))


def load_rules(folder: str | Path) -> list[Rule]:
    """All rule files below a folder, by id."""
    paths = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml", ".json") and p.is_file())
    return sorted((load_rule(p) for p in paths), key=lambda r: r.id)


def list_rules(
    rules: Iterable[Rule], id: str | None = None, domain: str | None = None, standard: str | None = None, version: str | None = None,
    use_case: str | None = None, include_deprecated: bool = False, substandard: str | None = None,
) -> list[dict]:
    """The catalogue as rows, filtered."""
    out = []
    for r in rules:
        if id and r.id != id or not include_deprecated and r.status.lower() == "deprecated":
            continue
        if not scope.for_standard(r, standard, version, substandard):
            continue
        if domain and r.domains and not scope._in(r.domains, lambda p: scope.pattern_matches(p, domain)):
            continue
        if use_case and r.use_cases and use_case.upper() not in {u.upper() for u in r.use_cases}:
            continue
        out.append({"rule_id": r.id, "status": r.status, "rule_type": r.rule_type, "sensitivity": r.sensitivity, "message": r.message, "description": r.description, "standards": sorted({f"{n} {v}" for n, v, _ in r.standards})})
    return out
