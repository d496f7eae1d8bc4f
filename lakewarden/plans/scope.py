"""Which rules apply to which datasets; plain Python at plan time."""

from __future__ import annotations

import re

from ..model import Dataset, Dialect, Rule, Study
from .metadata import class_of, normal_version


def pattern_matches(pattern: str, domain: str) -> bool:
    p = pattern.upper().strip()
    if p == "ALL":
        return True
    if p == "NONE":
        return False
    return domain.upper().startswith(p[:-2]) if p.endswith("--") else p == domain.upper()


def _in(spec: dict, test) -> bool:
    include, exclude = spec.get("Include") or spec.get("include") or [], spec.get("Exclude") or spec.get("exclude") or []
    include, exclude = (x if isinstance(x, list) else [x] for x in (include, exclude))
    if any(test(str(e)) for e in exclude):
        return False
    return not include or any(test(str(i)) for i in include)


def class_matches(wanted: str, have: str) -> bool:
    w = re.sub(r"[-\s]+", " ", wanted).upper()
    return w == "ALL" or w == re.sub(r"[-\s]+", " ", have).upper() or (w == "FINDINGS" and have == "FINDINGS ABOUT")


def applies(rule: Rule, d: Dataset, study: Study) -> bool:
    names = {d.domain, d.name.upper()}
    if rule.domains and not _in(rule.domains, lambda p: any(pattern_matches(p, n) for n in names)):
        return False
    if rule.classes:
        cls = class_of(study, d)
        known = bool(cls)
        listed = {str(x).upper() for x in rule.domains.get("Include") or rule.domains.get("include") or []}
        # A class nobody can tell does not keep a rule from a domain it names outright.
        if not known and names & listed:
            return True
        if not _in(rule.classes, lambda c: class_matches(c, cls)):
            return False
    if rule.entities:
        return _in(rule.entities, lambda e: e.upper() == "ALL" or e.upper() == d.name.upper())
    if study.use_case and rule.use_cases and not {u.upper() for u in rule.use_cases} & {u.strip().upper() for u in re.split(r"[,;]", study.use_case)}:
        return False
    return True


def for_standard(rule: Rule, standard: str | None, version: str | None, substandard: str | None = None) -> bool:
    if not standard:
        return True
    for name, v, sub in rule.standards:
        if name.upper() == standard.upper() and (not version or normal_version(v) == normal_version(version)) and (not substandard or not sub or sub.upper() == substandard.upper()):
            return True
    return False


def of_family(rules: list[Rule], standard: str | None) -> list[Rule]:
    """One version of each rule. Where a rule was written anew, the older one stands for SEND and TIG, as far as it was not written for SDTMIG alone."""
    older = (standard or "").upper().startswith("SEND") or (standard or "").upper() == "TIG"
    by_id: dict[str, list[Rule]] = {}
    for rule in rules:
        by_id.setdefault(rule.id, []).append(rule)
    out = []
    for versions in by_id.values():
        new = [r for r in versions if r.dialect is Dialect.CORE1]
        old = [r for r in versions if r.dialect is Dialect.CDISC]
        if not new or not old:
            out += versions
        else:
            wider = [r for r in old if any(n.upper() != "SDTMIG" for n, _, _ in r.standards)]
            out += wider if older and wider else new
    return out


def other_domains(rule: Rule) -> set[str]:
    """Datasets a rule reads besides the one it checks."""
    found = {str(m.get("Name") or m.get("name") or "").upper() for m in rule.match_datasets if not (m.get("Child") or m.get("child"))}
    found |= {str(o.get("domain")).upper() for o in rule.operations if o.get("domain")}
    return {f for f in found if f and not f.startswith("--") and "--" not in f}
