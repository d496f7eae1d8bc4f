"""Define-XML 2.x and stf.xml, as lists of plain rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attributes(e: ET.Element) -> dict[str, str]:
    return {_local(k): v for k, v in e.attrib.items()}


def _children(e: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in e if _local(c.tag) == name]


def _text(e: ET.Element) -> str:
    return next((" ".join("".join(t.itertext()).split()) for t in e.iter() if _local(t.tag) == "TranslatedText"), "")


def read_define(path: str | Path) -> dict:
    """datasets, variables, codelists, value_levels, standards, external_dictionaries, extended_terms."""
    root = ET.parse(path).getroot()
    items, lists, methods, wheres = {}, {}, {}, {}
    for e in root.iter():
        kind, a = _local(e.tag), _attributes(e)
        if kind == "ItemDef":
            items[a["OID"]] = e
        elif kind == "CodeList":
            lists[a["OID"]] = e
        elif kind == "ValueListDef":
            methods[a["OID"]] = e
        elif kind == "WhereClauseDef":
            wheres[a["OID"]] = e
    codelists, external, extended = [], [], []
    for oid, e in lists.items():
        a = _attributes(e)
        alias = next((_attributes(x).get("Name", "") for x in _children(e, "Alias")), "")
        terms = []
        for t in [c for c in e if _local(c.tag) in ("CodeListItem", "EnumeratedItem")]:
            ta = _attributes(t)
            terms.append(ta.get("CodedValue", ""))
            if ta.get("ExtendedValue") == "Yes":
                extended.append({"name": a.get("Name", ""), "codelist": alias, "value": ta.get("CodedValue", "")})
        for x in _children(e, "ExternalCodeList"):
            xa = _attributes(x)
            external.append({"dictionary": xa.get("Dictionary", ""), "version": xa.get("Version", "")})
        codelists.append({"oid": oid, "name": a.get("Name", ""), "code": alias, "terms": terms})
    by_list = {c["oid"]: c for c in codelists}

    def variable(ref: ET.Element, dataset: str, order: int) -> dict | None:
        ra = _attributes(ref)
        item = items.get(ra.get("ItemOID", ""))
        if item is None:
            return None
        ia = _attributes(item)
        code = next((by_list.get(_attributes(c).get("CodeListOID", "")) for c in _children(item, "CodeListRef")), None)
        origin = next((_attributes(o).get("Type", "") for o in _children(item, "Origin")), "")
        length = ia.get("Length")
        return {
            "define_dataset_name": dataset, "define_variable_name": ia.get("Name", ""), "define_variable_label": _text(item), "define_variable_data_type": ia.get("DataType", ""),
            "define_variable_length": float(length) if length else None, "define_variable_role": ra.get("Role", ""), "define_variable_mandatory": ra.get("Mandatory", ""),
            "define_variable_order_number": order, "define_variable_key_sequence": ra.get("KeySequence", ""), "define_variable_origin_type": origin,
            "define_variable_format": ia.get("DisplayFormat", ""), "define_variable_is_collected": origin == "Collected", "define_variable_has_codelist": code is not None,
            "define_variable_ccode": code["code"] if code else "", "define_variable_codelist_coded_values": "\x1f".join(code["terms"]) if code else "",
        }

    datasets, variables, levels = [], [], []
    for g in (e for e in root.iter() if _local(e.tag) == "ItemGroupDef"):
        a = _attributes(g)
        name = a.get("Name", "")
        refs = _children(g, "ItemRef")
        rows = [v for i, r in enumerate(refs) if (v := variable(r, name, i + 1))]
        keys = [v["define_variable_name"] for v in sorted((v for v in rows if v["define_variable_key_sequence"]), key=lambda v: int(v["define_variable_key_sequence"]))]
        datasets.append({
            "define_dataset_name": name, "define_dataset_label": _text(g) or a.get("Label", ""), "define_dataset_class": a.get("Class", ""), "define_dataset_structure": a.get("Structure", ""),
            "define_dataset_domain": a.get("Domain", ""), "define_dataset_location": a.get("ArchiveLocationID", ""), "define_dataset_key_sequence": ",".join(keys),
            "define_dataset_is_non_standard": a.get("IsNonStandard", ""), "define_dataset_has_no_data": a.get("HasNoData", ""),
        })
        variables += rows
        for r, v in zip(refs, rows):
            item = items.get(_attributes(r).get("ItemOID", ""))
            ref = next((_attributes(x).get("ValueListOID", "") for x in _children(item, "ValueListRef")), "") if item is not None else ""
            for vr in _children(methods[ref], "ItemRef") if ref in methods else []:
                level = variable(vr, name, 0)
                if not level:
                    continue
                where = []
                for w in _children(vr, "WhereClauseRef"):
                    clause = wheres.get(_attributes(w).get("WhereClauseOID", ""))
                    for check in _children(clause, "RangeCheck") if clause is not None else []:
                        ca = _attributes(check)
                        target = items.get(ca.get("ItemOID", ""))
                        where.append({"variable": _attributes(target).get("Name", "") if target is not None else "", "comparator": ca.get("Comparator", "EQ"), "values": [(x.text or "").strip() for x in _children(check, "CheckValue")]})
                levels.append({"define_dataset_name": name, "define_variable_name": v["define_variable_name"], "where": where, **{k.replace("define_variable", "define_vlm", 1): x for k, x in level.items() if k.startswith("define_variable")}})
    standards = [_attributes(e) for e in root.iter() if _local(e.tag) == "Standard"]
    return {"datasets": datasets, "variables": variables, "codelists": codelists, "value_levels": levels, "standards": standards, "external_dictionaries": external, "extended_terms": extended}


def read_stf(path: str | Path) -> list[dict]:
    """One row per document and file tag."""
    rows = []
    for doc in (e for e in ET.parse(path).getroot().iter() if _local(e.tag) == "doc-content"):
        a = _attributes(doc)
        title = next((" ".join("".join(t.itertext()).split()) for t in doc.iter() if _local(t.tag) == "title"), "")
        for tag in [e for e in doc.iter() if _local(e.tag) == "file-tag"] or [None]:
            ta = _attributes(tag) if tag is not None else {}
            rows.append({"stf_href": a.get("href", ""), "stf_title": title, "stf_file_tag": ta.get("name", ""), "stf_info_type": ta.get("info-type", "")})
    return rows
