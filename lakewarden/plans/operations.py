"""Computed bindings (``$name``): aggregates as joins, metadata as plan-time values, row functions as Columns."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..functions import text as tx
from ..model import RECORD, Dialect, Operation, RuleSkipped, Study
from . import metadata as md
from . import relations as rel
from .table import Operand, Table, kind_of, literal, tidy

#: By name; the names are those of the rule language (fixed values).
OPERATIONS: dict[str, Callable] = {}


def operation(*names: str) -> Callable:
    def add(fn: Callable) -> Callable:
        for n in names:
            OPERATIONS[n] = fn
        return fn

    return add


class Request:
    """One operation for one table of one study."""

    def __init__(self, op: Operation, table: Table, study: Study, dialect: Dialect):
        self.op, self.table, self.study, self.dialect = op, table, study, dialect
        self.domain = table.resolve(str(op.get("domain"))) if op.get("domain") else None
        own = table.dataset
        self.wildcard = table.wildcard
        if self.domain and (own is None or self.domain.upper() not in (own.name.upper(), own.domain)):
            found = study.of_domain(self.domain)
            self.source = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.df for d in found]) if found else None
            self.wildcard = found[0].domain[:2] if found else self.domain[:2]
        else:
            files = study.of_domain(own.domain) if own is not None and own.domain_value else []
            self.source = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.df for d in files]) if len(files) > 1 else (own.df if own is not None else table.df)
        self.kinds = {f.name: kind_of(f.dataType) for f in self.source.schema} if self.source is not None else {}

    def name(self, key: str = "name") -> str:
        v = self.op.get(key)
        v = "" if v is None else str(v)
        return self.wildcard + v[2:] if v.startswith("--") else v

    def group(self) -> list[str]:
        g = self.op.get("group")
        out: list[str] = []
        for v in g if isinstance(g, list) else [g] if g else []:
            if str(v).startswith("$"):
                bound = self.table.bindings.get(v)
                out += [str(x) for x in (bound.values or [])] if bound else []
            else:
                out.append(self.table.resolve(str(v)))
        return out

    def write_out(self, *exprs: Column) -> list[str]:
        """Names of helper columns of the source, added in one step."""
        names = [f"__s{len(self.source.columns) + i}" for i in range(len(exprs))]
        self.source = self.source.withColumns(dict(zip(names, exprs)))
        return names

    def need(self, *cols: str) -> None:
        absent = [c for c in cols if c not in self.kinds]
        if absent:
            raise RuleSkipped(f"an operation uses {', '.join(absent)}, which the dataset does not have")

    def chosen(self) -> Column:
        """The rows that the operation's filter takes."""
        out = F.lit(True)
        for col, wanted in (self.op.get("filter") or {}).items():
            col = self.wildcard + col[2:] if col.startswith("--") else col
            self.need(col)
            out = out & tx.like_filter(F.col(f"`{col}`"), self.kinds[col], wanted, self.dialect.wildcard)
        return out

    def grouped(self, value: Column, kind: str, absent: Column | None = None) -> Operand:
        """An aggregate per group, joined back on the group's columns."""
        cols = self.group()
        self.need(*cols)
        aliases = self.op.get("group_aliases") or cols
        here = [self.table.resolve(a) for a in aliases]
        missing = [c for c in here if not self.table.has(c)]
        if missing:
            raise RuleSkipped(f"{self.op.id} is computed per {', '.join(missing)}, which this dataset does not have")
        per = self.source.groupBy(*(F.col(f"`{c}`") for c in cols)).agg(value.alias("__v"))
        out = self.table.join(per, [(self.table.col(h), c) for h, c in zip(here, cols)], "__v", kind)
        return Operand(F.coalesce(out, absent) if absent is not None else out, kind)

    def single(self, value: Column, kind: str, collection: bool = False) -> Operand:
        """An aggregate of the whole table: one row, joined."""
        per = self.source.agg(value.alias("__v"))
        return Operand(self.table.join(per, [], "__v", kind), kind, collection=collection)

    def other(self, ref: object) -> list[str]:
        """The plan-time values an operation names."""
        if isinstance(ref, str) and ref.startswith("$"):
            bound = self.table.bindings.get(ref)
            if bound is None:
                raise RuleSkipped(f"{ref} could not be computed for this dataset")
            if bound.values is not None:
                return [tidy(v) for v in bound.values]
            raise LookupError(ref)
        return [tidy(v) for v in ref] if isinstance(ref, list) else [tidy(ref)] if ref is not None else []


def compute(op: Operation, table: Table, study: Study, dialect: Dialect) -> Operand | None:
    if op.operator not in OPERATIONS:
        raise RuleSkipped(f"unimplemented Operations type: {op.operator}")
    req = Request(op, table, study, dialect)
    if req.source is None and op.operator not in _NEED_NO_TABLE:
        if dialect is Dialect.CORE1 and op.operator == "distinct":
            return literal([])
        return None
    return OPERATIONS[op.operator](req)


def _absent_ok(c: Column) -> Column:
    return F.filter(F.array_sort(F.collect_set(F.when(c != "", c))), lambda x: x.isNotNull())


@operation("distinct")
def distinct(r: Request) -> Operand | None:
    name = r.name()
    r.need(name)
    value = tx.text_of(F.col(f"`{name}`"), r.kinds[name])
    value = F.when(r.chosen(), value)
    if r.op.get("value_is_reference"):
        ref = str(r.op.get("referenced_domain_variable") or "RDOMAIN")
        if ref not in r.kinds:
            return None
        known = F.lit(False)
        for d in r.study.datasets.values():
            known = known | ((F.upper(F.col(f"`{ref}`")) == d.name.upper()) & value.isin(d.columns))
        value = F.when(known, value)
    if r.group():
        return r.grouped(_absent_ok(value), "set")
    source = r.source.select(value.alias("v")).filter("v <> ''").distinct()
    return Operand(F.array().cast("array<string>"), "set", collection=True, source=source)


@operation("record_count")
def record_count(r: Request) -> Operand:
    count = F.count(F.when(r.chosen(), 1)).cast("double")
    if not r.group():
        return r.single(count, "num")
    regex = r.op.get("regex")
    if regex:
        # Keys are cut to their match before they are counted, on both sides.
        def cut(c: Column) -> Column:
            m = F.regexp_extract(c, f"^(?:{regex})", 0)
            return F.when(m != "", m).otherwise(c)

        cols = r.group()
        r.need(*cols)
        per = r.source.groupBy(*(cut(F.col(f"`{c}`")).alias(c) if r.kinds[c] == "text" else F.col(f"`{c}`") for c in cols)).agg(count.alias("__v"))
        keys = [(cut(r.table.col(c)) if r.kinds[c] == "text" else r.table.col(c), c) for c in cols]
        return Operand(r.table.join(per, keys, "__v", "num"), "num")
    return r.grouped(count, "num", F.lit(0.0) if r.dialect is Dialect.CORE1 else None)


def _extreme(biggest: bool) -> Callable:
    def run(r: Request) -> Operand:
        ref = r.op.get("name")
        agg = F.max if biggest else F.min
        if isinstance(ref, str) and ref.startswith("$"):
            bound = r.table.bindings.get(ref)
            if bound is None:
                raise RuleSkipped(f"{ref} could not be computed for this dataset")
            if bound.values is not None:
                numbers = [float(v) for v in bound.values if str(v).replace(".", "", 1).lstrip("-").isdigit()]
                picked = (max if biggest else min)(numbers if len(numbers) == len(bound.values) else map(tidy, bound.values))
                return literal(picked)
            if bound.source is not None:  # by value if all members are numbers, else as text
                n = tx.number(F.col("v"))
                every = F.coalesce(F.bool_and(n.isNotNull()), F.lit(False))
                per = bound.source.agg(F.when(every, tx.number_text(agg(n))).otherwise(agg("v")).alias("__v"))
                return Operand(r.table.join(per, [], "__v", "text"), "text")
            per = r.table.df.agg(agg(bound.number() if bound.kind == "num" else bound.text()).alias("__v"))
            return Operand(r.table.join(per, [], "__v", bound.kind), bound.kind)
        name = r.name()
        r.need(name)
        c, kind = F.col(f"`{name}`"), r.kinds[name]
        value = F.when(r.chosen() & ~tx.blank(c, kind), c)
        return r.grouped(agg(value), kind) if r.group() else r.single(agg(value), kind)

    return run


operation("max")(_extreme(True))
operation("min")(_extreme(False))


def _date_extreme(biggest: bool) -> Callable:
    def run(r: Request) -> Operand:
        name = r.name()
        r.need(name)
        text = F.coalesce(tx.text_of(F.col(f"`{name}`"), r.kinds[name]), F.lit(""))
        chosen = r.chosen()
        if r.dialect is Dialect.CORE1:
            value = F.when(chosen, dt.known_date_core1(text))
            agg = F.max(value) if biggest else F.min(value)
        else:
            parts = dt.date_parts(text, r.write_out)
            good = chosen & F.expr(f"{parts.valid} AND {parts.precision} >= 0")
            moment = F.when(good, parts.instant(parts.precision))
            # Of equal moments the first record's text.
            order = F.struct(moment, -F.col(RECORD)) if biggest else F.struct(moment, F.col(RECORD))
            agg = (F.max_by if biggest else F.min_by)(F.when(good, text), F.when(good, order))
        return r.grouped(agg, "text") if r.group() else r.single(agg, "text")

    return run


operation("max_date")(_date_extreme(True))
operation("min_date")(_date_extreme(False))


def set_difference(left: list[str], right: list[str], plain: bool = False) -> list[str]:
    """What ``left`` has beyond ``right``; unless ``plain``, order counts: an item out of order is not found."""
    if plain:
        gone = set(right)
        return [x for x in left if x not in gone]
    out, at = [], 0
    for item in right:
        try:
            spot = left.index(item, at)
        except ValueError:
            continue
        out += left[at:spot]
        at = spot
        while at < len(left) and left[at] == item:
            at += 1
    return out + left[at:]


def _side(r: Request, ref: object) -> Operand:
    """An operand of a set operation: a binding, or the rule's own list."""
    bound = r.table.bindings.get(ref) if isinstance(ref, str) else None
    return literal(r.other(ref)) if bound is None else bound


def _set_pair(r: Request, fold: bool) -> tuple[DataFrame, DataFrame] | tuple[Operand, Operand]:
    """Both sides as relations; where one differs from row to row, both as operands."""
    sides = _side(r, r.op.get("name")), _side(r, r.op.get("subtract"))
    tables = [rel.relation(x, r.table) for x in sides]
    if any(t is None for t in tables):
        return sides
    return tuple(rel.folded(t) if fold else t for t in tables)


def _own_set(x: Operand, table: Table, fold: bool) -> Column:
    """A row's own set as an array; a relation that a row's set is taken from has to be one, too."""
    x = materialised(x, table)
    members = x.col if x.is_set else F.array(x.text())
    return F.transform(members, lambda v: F.upper(v)) if fold else members


@operation("minus")
def minus(r: Request) -> Operand:
    """What a set has beyond another. Lists known when the plan is made keep their order, and order counts in them; relations have none."""
    fold = r.dialect is Dialect.CORE1 and r.op.get("case_sensitive") is False
    try:
        left, right = r.other(r.op.get("name")), r.other(r.op.get("subtract"))
    except LookupError:
        a, b = _set_pair(r, fold)
        if isinstance(a, DataFrame):
            return rel.difference(a, b)
        own = _own_set(a, r.table, fold) if a.source is None else None
        if own is not None and b.source is not None:
            members = rel.folded(b.source) if fold else b.source
            return Operand(F.array_except(own, rel.among(r.table, own, members)), "set")
        return Operand(F.array_except(_own_set(a, r.table, fold), _own_set(b, r.table, fold)), "set")
    if fold:
        left, right = [x.upper() for x in left], [x.upper() for x in right]
    if r.dialect is Dialect.CORE1:
        return literal(list(dict.fromkeys(x for x in left if x not in set(right))))
    return literal(set_difference(left, right, r.op.get("order_insensitive") is True))


@operation("intersect")
def intersect(r: Request) -> Operand:
    up = r.op.get("case_sensitive") is False
    try:
        left, right = r.other(r.op.get("name")), r.other(r.op.get("subtract"))
    except LookupError:
        a, b = _set_pair(r, up)
        if isinstance(a, DataFrame):
            return rel.intersection(a, b)
        if a.source is not None or b.source is not None:
            own, members = (_own_set(b, r.table, up), a.source) if a.source is not None else (_own_set(a, r.table, up), b.source)
            return Operand(F.array_distinct(rel.among(r.table, own, rel.folded(members) if up else members)), "set")
        return Operand(F.array_intersect(_own_set(a, r.table, up), _own_set(b, r.table, up)), "set")
    if up:
        left, right = [x.upper() for x in left], [x.upper() for x in right]
    return literal(list(dict.fromkeys(x for x in left if x in set(right))))


@operation("split_by")
def split_by(r: Request) -> Operand | None:
    name, mark = r.name(), r.op.get("delimiter")
    if not mark:
        raise RuleSkipped("split_by needs a delimiter")
    if not r.table.has(name):
        return None
    text = r.table.col(name)
    parts = F.split(text, "\\Q" + str(mark) + "\\E")
    # No empty part after a closing delimiter.
    trimmed = F.when(F.endswith(text, F.lit(str(mark))), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return Operand(F.when(text == "", F.array().cast("array<string>")).otherwise(trimmed), "set")


@operation("map")
def map_(r: Request) -> Operand:
    entries = r.op.get("map") or []
    if not entries:
        raise RuleSkipped("map operation declares no entries")
    keys = list(dict.fromkeys(k for e in entries for k in e if k != "output"))
    if not keys:
        if len(entries) != 1:
            raise RuleSkipped("map operation has several entries but no keys to choose between them")
        return literal(tidy(entries[0]["output"]))
    absent = [k for k in keys if not r.table.has(k)]
    if absent:
        raise RuleSkipped(f"map operation keys on column(s) the dataset does not have: {', '.join(absent)}")
    out = F.lit(None).cast("string")
    for e in reversed(entries):
        hit = F.lit(True)
        for k in keys:
            hit = hit & tx.text_of(r.table.col(k), r.table.kind(k)).eqNullSafe(F.lit(tidy(e[k]) if e.get(k) is not None else None))
        out = F.when(hit, F.lit(tidy(e["output"]))).otherwise(out)
    return Operand(out, "text")


@operation("dy")
def dy(r: Request) -> Operand:
    """Days since the subject's reference start; there is no day 0."""
    t, name = r.table, r.table.resolve(str(r.op.get("name")))
    nothing = Operand(F.lit(None).cast("double"), "num")
    if r.dialect is Dialect.CORE1:
        start = t.col("RFSTDTC") if t.has("RFSTDTC") else None
    else:
        dm = r.study.get("DM")
        start = None
        if dm and "RFSTDTC" in dm.columns and t.has("USUBJID"):
            per = dm.df.groupBy("USUBJID").agg(F.min_by("RFSTDTC", RECORD).alias("__v"))
            start = t.join(per, [(t.col("USUBJID"), "USUBJID")], "__v", "text")
    if start is None or not t.has(name):
        return nothing
    a, b = (F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}($|T)"), F.left(c, F.lit(10))).try_cast("date") for c in (t.col(name), start))
    days = F.datediff(a, b)
    return Operand(F.when(days < 0, days).otherwise(days + 1).cast("double"), "num")


@operation("variable_exists")
def variable_exists(r: Request) -> Operand:
    return literal(r.source is not None and r.name() in r.kinds)


@operation("variable_count")
def variable_count(r: Request) -> Operand:
    wanted = str(r.op.get("name"))
    return literal(sum((d.domain[:2] + wanted[2:] if wanted.startswith("--") else wanted) in d.columns for d in r.study.datasets.values()))


@operation("dataset_names")
def dataset_names(r: Request) -> Operand:
    return literal(sorted(r.study.datasets))


@operation("study_domains")
def study_domains(r: Request) -> Operand:
    return literal(sorted({d.domain if r.dialect is Dialect.CORE1 else d.domain_value for d in r.study.datasets.values()}))


@operation("get_column_order_from_dataset")
def get_column_order_from_dataset(r: Request) -> Operand:
    return literal([c for c in r.source.columns if not c.startswith("__")])


@operation("referenced_domain_variable_names")
def referenced_domain_variable_names(r: Request) -> Operand:
    t, name = r.table, str(r.op.get("name"))
    none = F.array().cast("array<string>")
    if not t.has(name):
        return Operand(none, "set")
    out = none
    for d in r.study.datasets.values():
        key = d.domain if r.dialect is Dialect.CORE1 else d.domain_value.upper()
        if key:
            out = F.when(F.upper(F.trim(t.col(name))) == key, F.array(*(F.lit(c.upper()) for c in d.columns))).otherwise(out)
    return Operand(out, "set")


@operation("extract_metadata")
def extract_metadata(r: Request) -> Operand:
    d, what = r.table.dataset, str(r.op.get("name") or "")
    if what == "dataset_name" and d:
        return literal(d.name.upper())
    if what == "dataset_size" and d:
        if d.file_size is None:
            raise RuleSkipped("the size of the dataset's file is not known")
        return literal(float(d.file_size))
    raise RuleSkipped(f"extract_metadata has no {what}")


def _lengths(r: Request, declared: bool, biggest: bool) -> Operand:
    """Per variable name over the study; the table checked has one row per variable."""
    t = r.table
    if not t.has("variable_name"):
        raise RuleSkipped(f"{r.op.id} is computed per variable_name, which this dataset does not have")
    pick = max if biggest else min
    if declared:
        seen: dict[str, list[int]] = {}
        for d in r.study.datasets.values():
            for v in d.variables:
                if v.length is not None:
                    seen.setdefault(v.name, []).append(v.length)
        out = F.lit(None).cast("double")
        if seen:
            out = F.create_map(*(F.lit(x) for k, v in seen.items() for x in (k, float(pick(v)))))[t.col("variable_name")]
        return Operand(out, "num")
    parts = []
    for d in r.study.datasets.values():
        kinds = {f.name: kind_of(f.dataType) for f in d.df.schema}
        longest = [F.max(F.char_length(tx.text_of(F.col(f"`{c}`"), kinds[c]))).cast("double").alias(c) for c in d.columns]
        parts.append(d.df.agg(*longest).unpivot([], d.columns, "variable_name", "n"))
    per = reduce(DataFrame.union, parts).groupBy("variable_name").agg(F.max("n").alias("__v"))
    return Operand(t.join(per, [(t.col("variable_name"), "variable_name")], "__v", "num"), "num")


operation("max_variable_value_length")(lambda r: _lengths(r, False, True))
operation("global_max_variable_length")(lambda r: _lengths(r, True, True))
operation("global_min_variable_length")(lambda r: _lengths(r, True, False))


@operation("get_xhtml_errors")
def get_xhtml_errors(r: Request) -> Operand:
    """Well-formedness errors per cell, found once per distinct value."""
    name = r.name()
    if not r.table.has(name):
        raise RuleSkipped(f"needs {name}, which this dataset does not have")

    @F.pandas_udf("array<string>")
    def errors(values: pd.Series) -> pd.Series:
        def one(v: str) -> list[str]:
            try:
                ET.fromstring(f"<div>{v}</div>")
            except ET.ParseError as e:
                return [str(e)]
            return []

        return values.map(one)

    per = r.table.df.select(F.coalesce(r.table.col(name), F.lit("")).alias("k")).distinct().withColumn("__v", errors("k"))
    return Operand(r.table.join(per, [(F.coalesce(r.table.col(name), F.lit("")), "k")], "__v", "set"), "set")


# Metadata: plan-time values from the reference tables.


@operation("domain_is_custom")
def domain_is_custom(r: Request) -> Operand:
    return literal(md.domain_code(r.table.dataset) not in md.standard_domains(r.study))


@operation("domain_label")
def domain_label(r: Request) -> Operand:
    return literal(md.domain_label(r.study, r.table.dataset))


@operation("standard_domains")
def standard_domains(r: Request) -> Operand:
    return literal(md.standard_domains(r.study, r.op.get("domain_class")))


def _core_variables(core: str) -> Callable:
    def run(r: Request) -> Operand:
        md.need_guide(r.study)
        domain = r.domain or (r.table.dataset.domain if r.table.dataset else "")
        return literal([md.prefixed(v["variable"], domain) for v in md.guide_variables(r.study, domain) if v.get("core") == core])

    return run


operation("required_variables")(_core_variables("Req"))
operation("expected_variables")(_core_variables("Exp"))


@operation("get_column_order_from_library")
def get_column_order_from_library(r: Request) -> Operand:
    found = md.variable_order(r.study, r.table.dataset)
    if not found:
        raise RuleSkipped(f"needs the SDTM Model class of {r.table.dataset.name}, which its variables do not tell")
    return literal(found)


@operation("get_model_column_order")
def get_model_column_order(r: Request) -> Operand:
    found = md.model_order(r.study, r.table.dataset)
    if not found:
        raise RuleSkipped(f"the SDTM Model describes no variables for {r.table.dataset.name}")
    return literal(found)


@operation("get_parent_model_column_order")
def get_parent_model_column_order(r: Request) -> Operand | None:
    t = r.table
    if r.dialect is Dialect.CORE1:
        parent = t.dataset.name.upper().removeprefix("SUPP").removeprefix("SQ")
        return literal([v["variable"] for v in md.model_variables(r.study, parent)]) if parent != t.dataset.name.upper() else None
    if not t.has("RDOMAIN"):
        return None
    out = F.array().cast("array<string>")
    for d in {x.domain for x in r.study.datasets.values()}:
        names = [md.prefixed(v["variable"], d) for v in md.model_variables(r.study, d)]
        out = F.when(F.upper(t.col("RDOMAIN")) == d, F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")).otherwise(out)
    return Operand(out, "set")


def _matching(r: Request, rows: list[dict]) -> list[dict]:
    key, wanted = str(r.op.get("key_name") or ""), str(r.op.get("key_value") or "")
    return [v for v in rows if str(v.get(key) or "").lower() == wanted.lower()] if key else rows


@operation("get_model_filtered_variables")
def get_model_filtered_variables(r: Request) -> Operand | None:
    found = [md.prefixed(v["variable"], r.table.dataset.domain) for v in _matching(r, md.model_variables(r.study, r.table.dataset.domain, r.table.dataset))]
    return literal(found) if found else None


@operation("get_dataset_filtered_variables")
def get_dataset_filtered_variables(r: Request) -> Operand | None:
    d = r.table.dataset
    rows = _matching(r, md.guide_variables(r.study, d.domain) + md.model_variables(r.study, d.domain, d))
    found = [v for v in dict.fromkeys(md.prefixed(x["variable"], d.domain) for x in rows) if v in d.columns]
    return literal(found) if found else None


@operation("label_referenced_variable_metadata")
def label_referenced_variable_metadata(r: Request) -> Operand:
    md.need_guide(r.study)
    attribute = str(r.op.get("attribute_name") or "role")
    fieldname = "variable" if attribute == "name" else attribute
    seen: dict[str, list[str]] = {}
    for v in md.guide_rows(r.study):
        if v.get(fieldname):
            seen.setdefault(v.get("label", ""), []).append(str(v[fieldname]))
    spark = r.table.df.sparkSession
    rows = [(k, list(dict.fromkeys(v))) for k, v in seen.items()]
    per = spark.createDataFrame(rows, "k string, __v array<string>")
    return Operand(r.table.join(per, [(r.table.col(str(r.op.get("name"))), "k")], "__v", "set"), "set")


@operation("get_countries")
def get_countries(r: Request) -> Operand:
    if not r.study.library.countries:
        raise RuleSkipped("needs the table of countries, which is not loaded")
    attribute = str(r.op.get("attribute_name") or "code")
    return literal([str(c[attribute]) for c in r.study.library.countries if c.get(attribute)])


@operation("valid_codelist_dates")
def valid_codelist_dates(r: Request) -> Operand | None:
    types = r.op.get("ct_package_types") or r.op.get("ct_package_type") or []
    types = {str(t).upper() for t in (types if isinstance(types, list) else [types])}
    found = sorted({str(p["package_date"]) for p in r.study.library.packages if not types or str(p["package_type"]).upper() in types})
    return literal(found) if found else None


def _package(r: Request) -> str:
    if not r.study.ct_package:
        raise RuleSkipped("needs controlled terminology, and this study does not say which version it follows")
    if not any(c["package"] == r.study.ct_package for c in r.study.library.codelists):
        raise RuleSkipped(f"no controlled terminology package named '{r.study.ct_package}' is loaded")
    return r.study.ct_package


#: Attribute names of codelist operations (fixed values) and the fields of a term they ask for.
_TERM = {"Term CCODE": 0, "Term Value": 1, "Term Submission Value": 1, "Term Preferred Term": 2}


def _attribute(r: Request, package: str) -> list[str]:
    attribute = str(r.op.get("ct_attribute") or "Term CCODE")
    out: list[str] = []
    for c in r.study.library.codelists:
        if c["package"] == package:
            out += [c["codelist_code"]] if attribute == "Codelist CCODE" else [c["codelist"]] if attribute == "Codelist Value" else [t[_TERM.get(attribute, 0)] for t in c["terms"]]
    return list(dict.fromkeys(out))


@operation("get_codelist_attributes")
def get_codelist_attributes(r: Request) -> Operand:
    version = str(r.op.get("version") or "")
    if not r.table.has(version):
        return literal(_attribute(r, _package(r)))
    family = str(r.op.get("ct_package_type") or (r.study.product[:4] + "ct" if r.study.product else "sdtmct")).lower()
    names = {c["package"] for c in r.study.library.codelists if str(c["package"]).startswith(family)}
    if not names:
        raise RuleSkipped("no row names a controlled terminology package that is loaded")
    out = F.array().cast("array<string>")
    for p in sorted(names):
        out = F.when(F.concat(F.lit(family + "-"), F.trim(r.table.col(version))) == p, F.array(*map(F.lit, _attribute(r, p)))).otherwise(out)
    return Operand(out, "set")


@operation("codelist_terms")
def codelist_terms(r: Request) -> Operand:
    wanted = {str(x) for x in (r.op.get("codelists") or [r.op.get("codelist") or r.op.get("codelist_code")]) if x}
    level, field = str(r.op.get("level") or "term"), {"code": 0, "value": 1, "pref_term": 2}.get(str(r.op.get("returntype") or "value"), 1)
    lookup = next((k for k in ("term_code", "term_value", "term_pref_term") if r.op.get(k)), None)
    package = _package(r)
    lists = [c for c in r.study.library.codelists if c["package"] == package and (not wanted or c["codelist_code"] in wanted or c["codelist"] in wanted)]
    if lookup is None:
        if level == "codelist":
            return literal([c["codelist_code"] if field == 0 else c["codelist"] for c in lists])
        return literal(list(dict.fromkeys(t[field] for c in lists for t in c["terms"])))
    at = {"term_code": 0, "term_value": 1, "term_pref_term": 2}[lookup]
    rows = {(t[at] or "").lower(): t[field] for c in lists for t in c["terms"]}
    per = r.table.df.sparkSession.createDataFrame(sorted(rows.items()), "k string, __v string")
    ref = str(r.op.get(lookup))
    key = r.table.bindings[ref].text() if ref in r.table.bindings else r.table.col(r.table.resolve(ref))
    return Operand(r.table.join(per, [(F.lower(key), "k")], "__v", "text"), "text")


@operation("codelist_extensible")
def codelist_extensible(r: Request) -> Operand:
    version = str(r.op.get("version") or r.op.get("ct_version") or "")
    if not r.table.has(version):
        raise RuleSkipped(f"codelist_extensible needs a column of CT versions; '{version}' is not one")
    ref = r.op.get("codelist_code")
    code = r.table.bindings[ref].text() if ref in r.table.bindings else r.table.col(str(ref)) if r.table.has(str(ref)) else F.lit(str(ref))
    family = str(r.op.get("ct_package_type") or "sdtmct").lower()
    rows = [(f"{c['package']}\r{c['codelist_code']}", str(c.get("extensible", "")).lower() in ("true", "yes")) for c in r.study.library.codelists]
    if not rows:
        raise RuleSkipped("the controlled terminology is not loaded")
    per = r.table.df.sparkSession.createDataFrame(rows, "k string, __v boolean")
    key = F.concat(F.lit(family + "-"), F.trim(r.table.col(version)), F.lit("\r"), code)
    return Operand(r.table.join(per, [(key, "k")], "__v", "bool"), "bool")


def _define(r: Request) -> dict:
    if r.study.define is None:
        raise RuleSkipped("needs define.xml, which this study does not have")
    return r.study.define


@operation("get_define_external_dictionary_version")
def get_define_external_dictionary_version(r: Request) -> Operand:
    wanted = str(r.op.get("external_dictionary_type") or "")
    for d in (r.study.define or {}).get("external_dictionaries", []):
        if d["dictionary"].lower() == wanted.lower() and d.get("version"):
            return literal(d["version"])
    raise RuleSkipped(f"the define cites no version of {wanted or 'the dictionary'}")


@operation("get_external_dictionary_version")
def get_external_dictionary_version(r: Request) -> Operand:
    raise RuleSkipped(f"needs the {r.op.get('external_dictionary_type') or 'external'} dictionary, which is not supplied")


@operation("define_variable_metadata")
def define_variable_metadata(r: Request) -> Operand:
    name, attribute = r.table.resolve(str(r.op.get("name"))), str(r.op.get("attribute_name"))
    d = r.table.dataset
    for v in _define(r).get("variables", []):
        if v["define_dataset_name"].upper() in (d.name.upper(), d.domain) and v["define_variable_name"] == name and attribute in v:
            value = v[attribute]
            return literal(str(value) if isinstance(value, bool) else tidy(value))
    raise RuleSkipped(f"the define has no {attribute} for {name}")


@operation("define_extended_terms_in_ct")
def define_extended_terms_in_ct(r: Request) -> Operand:
    extended, package = _define(r).get("extended_terms", []), _package(r)
    fold = r.op.get("case_sensitive") is False
    low = str.lower if fold else str
    terms: dict[str, set[str]] = {}
    for c in r.study.library.codelists:
        if c["package"] == package:
            words = terms.setdefault(c["codelist_code"], set())
            for t in c["terms"]:
                words |= {low(w) for w in (t[1], *(t[3] if len(t) > 3 else ())) if w}
    return literal([e["value"] for e in extended if low(e["value"]) in terms.get(e["codelist"], set())])


_NEED_NO_TABLE = {
    "variable_exists", "variable_count", "dataset_names", "study_domains", "domain_is_custom", "domain_label", "standard_domains", "required_variables", "expected_variables",
    "get_column_order_from_library", "get_model_column_order", "get_model_filtered_variables", "extract_metadata", "get_countries", "valid_codelist_dates", "minus", "intersect",
    "get_define_external_dictionary_version", "get_external_dictionary_version", "define_variable_metadata", "define_extended_terms_in_ct", "max_variable_value_length",
    "global_max_variable_length", "global_min_variable_length", "codelist_terms", "get_codelist_attributes", "map",
}


#: Members of a set that the text of a finding shows, of a larger set the first ones and how many there are;
#: ``results.binding_sets`` has them all.
REPORTED = 1000


def shown(members: DataFrame) -> DataFrame:
    """A set that is a table as a finding shows it: one row with one text (Value) of bounded length."""
    some = members.select("v").orderBy("v").limit(REPORTED).agg(F.array_sort(F.collect_list("v")).alias("some"))
    whole = members.agg(F.count(F.lit(1)).alias("n"))
    quoted = F.array_join(F.transform("some", lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    rest = F.when(F.col("n") > REPORTED, F.concat(F.lit(", ... ("), F.col("n").cast("string"), F.lit(" in all)"))).otherwise("")
    return some.join(whole, F.lit(True)).select(F.concat(F.lit("["), quoted, rest, F.lit("]")).alias("Value"))  # a row each


def materialised(x: Operand, table: Table) -> Operand:
    """A dataset-wide set as one array column, for the operators that look at its order or its text."""
    if x.source is None:
        return x
    per = x.source.agg(F.array_sort(F.collect_set("v")).alias("__v"))
    return Operand(table.join(per, [], "__v", "set"), "set", collection=True)
