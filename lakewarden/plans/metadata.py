"""Look-ups in the reference tables, at plan time."""

from __future__ import annotations

import re

from ..model import Dataset, RuleSkipped, Study

#: Topic variables that tell a dataset's class (fixed values), in the order they are looked for.
TOPICS = (("TERM", "EVENTS"), ("TRT", "INTERVENTIONS"), ("QNAM", "RELATIONSHIP"), ("TESTCD", "FINDINGS"))
OBSERVATION = {"EVENTS", "INTERVENTIONS", "FINDINGS", "FINDINGS ABOUT"}


def normal_version(v: object) -> str:
    return re.sub(r"[^0-9]+", ".", str(v or "").strip()).strip(".")


def prefixed(variable: str, domain: str) -> str:
    return domain[:2] + variable[2:] if variable.startswith("--") else variable


def guide_rows(study: Study) -> list[dict]:
    """The Implementation Guide's variables for the study's standard, or the newest version loaded."""
    rows = [v for v in study.library.variables if str(v.get("standard", "")).upper() == (study.product or "SDTMIG").upper()]
    if not rows:
        return []
    wanted = normal_version(study.version)
    exact = [v for v in rows if normal_version(v.get("version")) == wanted]
    if exact:
        return exact
    newest = max((normal_version(v.get("version")) for v in rows), key=lambda s: [int(x) for x in s.split(".") if x])
    return [v for v in rows if normal_version(v.get("version")) == newest]


def need_guide(study: Study) -> None:
    if not guide_rows(study):
        raise RuleSkipped(f"no Implementation Guide is loaded for {study.product or 'SDTMIG'}")


def domain_code(d: Dataset | None) -> str:
    name = d.domain if d else ""
    if name.startswith(("SUPP", "SQ")):
        return "SUPPQUAL"
    return name[2:] if re.match(r"AP.{2,}", name) else name


def guide_variables(study: Study, domain: str) -> list[dict]:
    rows = [v for v in guide_rows(study) if str(v.get("domain", "")).upper() == domain.upper()]
    return sorted(rows, key=lambda v: int(v.get("ordinal") or 0))


def standard_domains(study: Study, domain_class: object = None) -> list[str]:
    found = list(dict.fromkeys(str(v["domain"]) for v in guide_rows(study)))
    if domain_class:
        found = [d for d in found if study.library.domain_classes.get(d, "").upper() == str(domain_class).upper()]
    return found


def domain_label(study: Study, d: Dataset | None) -> str:
    wanted, code = normal_version(study.version), domain_code(d)
    rows = [r for r in study.library.dataset_labels if r["domain"] == code]
    exact = [r for r in rows if normal_version(r.get("version")) == wanted]
    if not rows:
        raise RuleSkipped(f"the standard has no label for {code}")
    return (exact or rows)[-1]["label"]


def class_of(study: Study | None, d: Dataset) -> str:
    """By the table of domains, else by the topic variable; empty if neither tells."""
    name = d.domain
    table = study.library.domain_classes if study else {}
    if name in table:
        return table[name].upper()
    if name.startswith(("SUPP", "SQ")):
        return "RELATIONSHIP"
    if re.match(r"AP.{2,}", name) and name[2:] in table:
        return table[name[2:]].upper()
    cols, prefix = {c.upper() for c in d.columns}, name[2:4] if re.match(r"AP.{2,}", name) else name[:2]
    for topic, cls in TOPICS:
        if prefix + topic in cols or (topic == "QNAM" and "QNAM" in cols):
            return "FINDINGS ABOUT" if cls == "FINDINGS" and prefix + "OBJ" in cols else cls
    return ""


def _of_class(study: Study, cls: str) -> list[dict]:
    rows = [v for v in study.library.model_variables if re.sub(r"[-\s]+", " ", str(v["class"])).upper() == cls]
    return sorted(rows, key=lambda v: int(v.get("ordinal") or 0))


def model_variables(study: Study, domain: str, d: Dataset | None = None) -> list[dict]:
    own = d or next(iter(study.of_domain(domain)), None)
    cls = study.library.domain_classes.get(domain, "").upper() or (class_of(study, own) if own else "")
    found = _of_class(study, cls)
    if cls == "FINDINGS ABOUT":
        found = found + _of_class(study, "FINDINGS")
    if cls in OBSERVATION:
        found = _of_class(study, "IDENTIFIERS") + found + _of_class(study, "TIMING")
    return found


def model_order(study: Study, d: Dataset) -> list[str]:
    found = model_variables(study, d.domain, d)
    if re.match(r"AP(?!ID).+", d.domain):
        found = found + _of_class(study, "ASSOCIATED PERSONS")
    return list(dict.fromkeys(prefixed(v["variable"], d.domain) for v in found))


def variable_order(study: Study, d: Dataset) -> list[str]:
    """The Model's skeleton with the Guide's own variables put in: identifiers first, timing last."""
    cls = class_of(study, d)
    guide = [(prefixed(v["variable"], d.domain), str(v.get("role", ""))) for v in guide_variables(study, d.domain)]
    if cls not in OBSERVATION:
        return [n for n, _ in guide]
    parts = [[prefixed(v["variable"], d.domain) for v in rows] for rows in (_of_class(study, "IDENTIFIERS"), _of_class(study, cls), _of_class(study, "TIMING"))]
    if cls == "FINDINGS ABOUT":
        findings = [prefixed(v["variable"], d.domain) for v in _of_class(study, "FINDINGS")]
        test = prefixed("--TEST", d.domain)
        cut = findings.index(test) + 1 if test in findings else len(findings)
        parts[1] = list(dict.fromkeys(findings[:cut] + parts[1] + findings[cut:]))
    known = {n for p in parts for n in p}
    extra = [(n, role) for n, role in guide if n not in known]
    ids = [n for n, role in extra if role == "Identifier"]
    timing = [n for n, role in extra if role == "Timing"]
    rest = [n for n, role in extra if role not in ("Identifier", "Timing")]
    return list(dict.fromkeys(parts[0] + ids + parts[1] + rest + parts[2] + timing))
