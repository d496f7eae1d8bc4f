"""The rows a rule looks at: records, or tables about datasets, variables and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import RECORD, Dataset, Dialect, Rule, RuleSkipped, Study
from . import metadata as md
from .table import Table, kind_of, wildcard

#: Names of rule types (fixed values), by what their rows are: variables, values, define entries, studies, records, datasets.
VARIABLE_TYPES = {
    "Variable Metadata Check", "Variable Metadata Check against Library Metadata", "Variable Metadata Check against Define XML",
    "Variable Metadata Check against Define XML and Library Metadata",
}
VALUE_TYPES = {"Value Check with Variable Metadata", "Value Check with Dataset Metadata", "Value Check against Define XML Variable", "Value Check against Library Metadata"}
DEFINE_TYPES = {"Define Item Metadata Check", "Define Item Metadata Check against Library Metadata"}
STUDY_TYPES = {"Domain Presence Check", "Domain Presence Check against Define XML", "STF Metadata Check", "Global Value Check with Variable Metadata"}
RECORD_TYPES = {"Record Data", "Dataset Contents Check against Define XML", "Value Check against Define XML VLM"}
DATASET_TYPES = {"Dataset Metadata Check", "Dataset Metadata Check against Define XML"}
SUPPORTED = VARIABLE_TYPES | VALUE_TYPES | DEFINE_TYPES | STUDY_TYPES | RECORD_TYPES | DATASET_TYPES | {"JSONata"}


def rows_frame(spark: SparkSession, rows: list[dict], columns: list[str]) -> DataFrame:
    """A small table of text (or numbers, or lists of texts), numbered in order."""

    def kind(c: str) -> str:
        found = [r.get(c) for r in rows]
        if any(isinstance(v, list) for v in found):
            return "array<string>"
        return "double" if any(isinstance(v, (int, float)) and not isinstance(v, bool) for v in found) else "string"

    kinds = {c: kind(c) for c in columns}

    def cell(r: dict, c: str) -> object:
        v = r.get(c)
        if kinds[c] == "array<string>":
            return v
        if kinds[c] == "double":
            return None if v is None or v == "" else float(v)
        return ("True" if v else "False") if isinstance(v, bool) else "" if v is None else str(v)

    data = [(*(cell(r, c) for c in columns), i + 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"{RECORD} bigint"]))


def emptiness(d: Dataset) -> dict[str, tuple[bool, bool]]:
    """(has empty values, is all empty) of every column, in one pass over the data, which all rules share."""
    if "empty" in d.facts:
        return d.facts["empty"]
    kinds = {f.name: kind_of(f.dataType) for f in d.df.schema}
    aggs = []
    for i, c in enumerate(d.columns):
        b = tx.blank(F.col(f"`{c}`"), kinds[c]).cast("int")
        aggs += [F.max(b).alias(f"a{i}"), F.min(b).alias(f"b{i}")]
    row = d.df.agg(*aggs).first() if aggs else []
    d.facts["empty"] = {c: (row[2 * i] == 1, row[2 * i + 1] != 0) for i, c in enumerate(d.columns)}
    return d.facts["empty"]


def _define_variables(study: Study, d: Dataset) -> list[dict]:
    if study.define is None:
        raise RuleSkipped("needs define.xml, which this study does not have")
    return [v for v in study.define.get("variables", []) if v["define_dataset_name"].upper() in (d.name.upper(), d.domain)]


def _library(study: Study, d: Dataset) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for v in md.model_variables(study, d.domain, d) + md.guide_variables(study, d.domain):
        row = out.setdefault(md.prefixed(v["variable"], d.domain), {})
        for key in ("variable", "label", "role", "type", "core", "ordinal", "ccode"):
            if v.get(key) not in (None, ""):
                row[key] = v[key]
    return out


#: Names of library columns (fixed values) and the fields of a guide's variable they show.
_LIBRARY_COLUMNS = {"library_variable_name": "variable", "library_variable_label": "label", "library_variable_role": "role", "library_variable_data_type": "type", "library_variable_core": "core", "library_variable_ccode": "ccode", "library_variable_order_number": "ordinal"}


def _library_columns(row: dict | None) -> dict:
    row = row or {}
    return {k: row.get(f, "") for k, f in _LIBRARY_COLUMNS.items()} | {"library_variable_has_codelist": bool(row.get("ccode"))}


def _terms(study: Study, rows: list[dict]) -> None:
    """Add the terms and the name of each library variable's codelist in the study's terminology."""
    if not study.ct_package:
        raise RuleSkipped("needs controlled terminology, and this study does not say which version it follows")
    lists = {c["codelist_code"]: c for c in study.library.codelists if c["package"] == study.ct_package}
    for row in rows:
        found = lists.get(row.get("library_variable_ccode"))
        row["library_variable_codelist_value"] = found["codelist"] if found else ""
        row["library_variable_ccode_values"] = sorted({t[1] for t in found["terms"] if t[1] is not None}) if found else None


def variable_rows(rule: Rule, d: Dataset, study: Study) -> list[dict]:
    wants_library = "Library" in rule.rule_type or _mentions(rule, "library_")
    wants_define = "Define" in rule.rule_type or _mentions(rule, "define_")
    empty = emptiness(d) if _mentions(rule, "variable_has_empty_values") or _mentions(rule, "variable_is_empty") else {}
    library = _library(study, d) if wants_library else {}
    define = {v["define_variable_name"]: v for v in _define_variables(study, d)} if wants_define else {}
    rows = []
    for i, v in enumerate(d.variables):
        row = {
            "dataset_name": d.name.upper(), "variable_name": v.name, "variable_label": v.label, "variable_data_type": v.type, "variable_size": v.length, "variable_length": v.length,
            "variable_order_number": i + 1, "variable_name_length": len(v.name), "variable_label_length": len(v.label),
            "variable_has_empty_values": empty.get(v.name, (False, False))[0], "variable_is_empty": empty.get(v.name, (False, False))[1],
        }
        if wants_library:
            row |= _library_columns(library.get(v.name))
            row["library_variable_name"] = v.name if v.name in library else ""
        if wants_define:
            row |= define.get(v.name, {})
        rows.append(row)
    if rule.rule_type.endswith("Define XML and Library Metadata"):
        present = {v.name for v in d.variables}
        rows += [{"dataset_name": d.name.upper(), **v} for n, v in define.items() if n not in present]
    return rows


def _mentions(rule: Rule, what: str) -> bool:
    return what in repr((rule.check, rule.output, [o.options for o in rule.operations]))


def _wide(rows: list[dict], *always: str) -> list[str]:
    return list(dict.fromkeys([*always, *(k for r in rows for k in r)]))


def possible_variables(rule: Rule, d: Dataset, study: Study, about: list[dict]) -> list[str]:
    """The columns that can violate a Check over values, by those of its conditions that look at metadata alone.

    These are judged here, when the plan is made, on one row per variable; the other columns are never read.
    """
    from .early import row_by_row
    from .evaluate import Compiler

    known = _wide(about, "variable_name")
    parts = rule.check.get("all") if isinstance(rule.check, dict) else None
    sure = [c for c in parts or [] if c.get("name") in known and row_by_row(c) and not c.get("value_is_reference") and (c.get("value_is_literal") or not str(c.get("value")).startswith(("$", "variable_value")))]
    if not sure or rule.operations:
        return d.columns
    rows = as_table(rows_frame(d.df.sparkSession, about, known), d, study, rule.dialect)
    verdict = rows.add(Compiler(rows, study, rule.dialect).rule(Rule(rule.id, {"all": sure}, source=rule.source))[0])
    named = {r[0] for r in rows.df.filter(F.coalesce(verdict, F.lit(True))).select("variable_name").collect()}  # a row per variable
    return [c for c in d.columns if c in named] or d.columns[:1]


def value_table(d: Dataset, study: Study, rule: Rule) -> DataFrame:
    """One row per record and variable that may violate the rule; a streaming expansion of the scan, never stored."""
    spark = d.df.sparkSession
    about = [{"variable_name": v.name, "variable_label": v.label, "variable_data_type": v.type, "variable_size": v.length, "variable_length": v.length} for v in d.variables]
    if rule.rule_type == "Value Check against Define XML Variable":
        define = {v["define_variable_name"]: v for v in _define_variables(study, d)}
        about = [a | define[a["variable_name"]] for a in about if a["variable_name"] in define]
    if rule.rule_type == "Value Check against Library Metadata":
        library = _library(study, d)
        about = [a | _library_columns(library.get(a["variable_name"])) for a in about]
        _terms(study, about)
    columns = possible_variables(rule, d, study, about) if about else d.columns
    kinds = {f.name: kind_of(f.dataType) for f in d.df.schema}
    keep = [c for c in ("USUBJID", next((c for c in d.columns if c.endswith("SEQ")), None)) if c in d.columns]
    texts = [F.coalesce(tx.text_of(F.col(f"`{c}`"), kinds[c]), F.lit("")).alias(c) for c in columns]
    ids = [F.col(RECORD), *(F.col(f"`{c}`").alias(f"__id_{c}") for c in keep)]
    long = d.df.select(*ids, *texts).unpivot([RECORD, *(f"__id_{c}" for c in keep)], columns, "variable_name", "variable_value")
    for c in keep:
        long = long.withColumnRenamed(f"__id_{c}", c)
    long = long.withColumn("variable_value_length", F.char_length("variable_value").cast("double"))
    meta = rows_frame(spark, about, _wide(about, "variable_name")).drop(RECORD)
    out = long.join(F.broadcast(meta), "variable_name")  # one row per variable of the dataset
    if rule.rule_type == "Value Check with Dataset Metadata":
        count = d.df.agg(F.count(F.lit(1)).cast("double").alias("record_count"))
        out = out.withColumns({"dataset_name": F.lit(d.name.upper()), "dataset_label": F.lit(d.label)}).join(count, F.lit(True), "left")
    return out


def build(rule: Rule, d: Dataset, study: Study) -> DataFrame:
    """The table of rows for one rule type, before joins."""
    kind, spark = rule.rule_type, d.df.sparkSession
    if kind in ("Record Data", "Domain Presence Check"):
        return d.df
    if kind in DATASET_TYPES:
        rows = [{"dataset_name": d.name.upper(), "dataset_label": d.label, "dataset_size": d.file_size, "DOMAIN": d.domain_value or (d.domain if rule.dialect is Dialect.CORE1 else ""), "record_count": None}]
        if _mentions(rule, "record_count"):
            rows[0]["record_count"] = float(d.df.count())
        if "Define" in kind:
            rows[0] |= next((x for x in (study.define or {}).get("datasets", []) if x["define_dataset_name"].upper() == d.name.upper()), {})
        return rows_frame(spark, rows, _wide(rows))
    if kind in VARIABLE_TYPES:
        rows = variable_rows(rule, d, study)
        return rows_frame(spark, rows, _wide(rows, "variable_name"))
    if kind in VALUE_TYPES:
        return value_table(d, study, rule)
    if kind in DEFINE_TYPES:
        rows = _define_variables(study, d)
        if "Library" in kind:
            library = _library(study, d)
            rows = [v | _library_columns(library.get(v["define_variable_name"])) for v in rows]
            if rule.dialect is Dialect.CORE1:
                seen = {v["define_variable_name"] for v in rows}
                rows += [_library_columns(lib) for n, lib in library.items() if n not in seen]
        return rows_frame(spark, rows, _wide(rows, "define_variable_name"))
    if kind == "Domain Presence Check against Define XML":
        if study.define is None:
            raise RuleSkipped("needs define.xml, which this study does not have")
        rows = [x | {"domain": h.domain if (h := study.get(x["define_dataset_name"])) else "", "filename": h.file_name if h else ""} for x in study.define.get("datasets", [])]
        return rows_frame(spark, rows, _wide(rows, "domain", "filename"))
    if kind == "STF Metadata Check":
        if study.stf is None:
            raise RuleSkipped("needs stf.xml, which this study does not have")
        return rows_frame(spark, study.stf, _wide(study.stf))
    if kind == "Global Value Check with Variable Metadata":
        return global_lengths(study)
    if kind == "Dataset Contents Check against Define XML":
        return _contents(d, study)
    if kind == "Value Check against Define XML VLM":
        return _value_level(d, study)
    raise RuleSkipped(f"rule type not supported: {kind}")


def global_lengths(study: Study) -> DataFrame:
    """Per variable name of the study: declared and longest observed length."""
    parts = []
    for d in study.datasets.values():
        kinds = {f.name: kind_of(f.dataType) for f in d.df.schema}
        longest = d.df.agg(*(F.max(F.char_length(tx.text_of(F.col(f"`{c}`"), kinds[c]))).cast("double").alias(c) for c in d.columns))
        long = longest.unpivot([], d.columns, "variable_name", "variable_max_value_length")
        declared = {v.name: float(v.length) for v in d.variables if v.length is not None}
        length = F.create_map(*(F.lit(x) for kv in declared.items() for x in kv))[F.col("variable_name")] if declared else F.lit(None).cast("double")
        parts.append(long.withColumn("variable_length", length))
    found = reduce(DataFrame.union, parts).groupBy("variable_name").agg(F.max("variable_max_value_length").alias("variable_max_value_length"), F.max("variable_length").alias("variable_length"))
    from pyspark.sql import Window as W

    return found.withColumn(RECORD, F.row_number().over(W.orderBy("variable_name")).cast("bigint"))  # one row per variable name of the study


def _contents(d: Dataset, study: Study) -> DataFrame:
    from pyspark.sql import Window as W

    if study.define is None:
        raise RuleSkipped("needs define.xml, which this study does not have")
    about = next((x for x in study.define.get("datasets", []) if x["define_dataset_name"].upper() == d.name.upper()), None)
    if about is None:
        raise RuleSkipped(f"the define does not describe {d.name}")
    out = d.df
    for k, v in about.items():
        out = out.withColumn(k, F.lit(str(v)))
    keys = [v["define_variable_name"] for v in sorted(_define_variables(study, d), key=lambda v: int(v.get("define_variable_key_sequence") or 0)) if v.get("define_variable_key_sequence")]
    keys = [k for k in keys if k in d.columns]
    unique = F.count(F.lit(1)).over(W.partitionBy(*(F.col(f"`{k}`") for k in keys))) == 1 if keys else F.lit(True)
    return out.withColumn("define_key_sequence_is_unique", unique)


#: Comparators of a define's where clauses (fixed values).
_COMPARE = {"EQ": "==", "NE": "!=", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}


def _value_level(d: Dataset, study: Study) -> DataFrame:
    """The records that each value-level entry of the define selects, with that entry's attributes."""
    entries = [v for v in (study.define or {}).get("value_levels", []) if v["define_dataset_name"].upper() == d.name.upper() and v["define_variable_name"] in d.columns]
    if not entries:
        raise RuleSkipped(f"the define has no value-level metadata for {d.name}")
    kinds = {f.name: kind_of(f.dataType) for f in d.df.schema}
    parts = []
    for e in entries:
        take = F.lit(True)
        for c in e["where"]:
            if c["variable"] not in kinds:
                take = F.lit(False)
                break
            text = tx.text_of(F.col(f"`{c['variable']}`"), kinds[c["variable"]])
            if c["comparator"] in ("IN", "NOTIN"):
                hit = text.isin(list(c["values"]))
                take = take & (~hit if c["comparator"] == "NOTIN" else hit)
            else:
                take = take & (F.expr("1=0") if not c["values"] else {"==": text == c["values"][0], "!=": text != c["values"][0], "<": tx.number(text) < tx.number(F.lit(c["values"][0])), "<=": tx.number(text) <= tx.number(F.lit(c["values"][0])), ">": tx.number(text) > tx.number(F.lit(c["values"][0])), ">=": tx.number(text) >= tx.number(F.lit(c["values"][0]))}[_COMPARE[c["comparator"]]])
        value = F.coalesce(tx.text_of(F.col(f"`{e['define_variable_name']}`"), kinds[e["define_variable_name"]]), F.lit(""))
        rows = d.df.filter(F.coalesce(take, F.lit(False))).withColumns({"variable_name": F.lit(e["define_variable_name"]), "variable_value": value, "variable_value_length": F.char_length(value).cast("double")})
        for k, v in e.items():
            if k.startswith("define_vlm_"):
                rows = rows.withColumn(k, F.lit(str(v)))
        parts.append(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def as_table(df: DataFrame, d: Dataset, study: Study, dialect: Dialect) -> Table:
    return Table(df, d, study, wildcard(d))
