"""Joins of other datasets to the one checked (Match Datasets).

A joined row keeps the record number of the row it came from, so a record with
any violating joined row counts once. Which tables and keys a dynamic join needs
is read from the few distinct (RDOMAIN, IDVAR) pairs; records then stand once per
key variable, and all are joined at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..model import RECORD, Dataset, Dialect, Rule, RuleSkipped, Study
from .table import kind_of


def _kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema}


def _union(found: list[Dataset]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.df for d in found])


def _key(c: Column, kind: str) -> Column:
    return F.coalesce(tx.key_text(c, kind), F.lit(""))


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _key_pair(left: DataFrame, a: str, right: DataFrame, b: str) -> tuple[Column, Column, bool]:
    """The keys of two columns, and whether they are numbers: whole numbers meet as they are, all else as text."""
    lt, rt = left.schema[a].dataType, right.schema[b].dataType
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    if isinstance(lt, _WHOLE) and isinstance(rt, _WHOLE):
        return x.cast("bigint"), y.cast("bigint"), True
    return _key(x, kind_of(lt)), _key(y, kind_of(rt)), False


def _pairs(spec: dict, wild: str, other: str) -> list[tuple[str, str]]:
    """(left, right) key names of a join."""

    def name(v: str, prefix: str) -> str:
        return prefix + v[2:] if v.startswith("--") else v

    out = []
    keys = spec.get("Keys") or spec.get("keys") or []
    for k in keys if isinstance(keys, list) else [keys]:
        if isinstance(k, dict):
            left, right = k.get("Left") or k.get("left"), k.get("Right") or k.get("right")
            out.append((name(left, wild), name(right, other)))
        else:
            out.append((name(k, wild), name(k, other)))
    return out


def match(df: DataFrame, rule: Rule, d: Dataset, study: Study) -> DataFrame:
    """Apply the rule's joins in order."""
    for spec in rule.match_datasets:
        name = str(spec.get("Name") or spec.get("name") or "")
        upper = name.upper()
        if spec.get("Child") or spec.get("child"):
            df = child_to_parent(df, spec, d, study, rule.dialect)
        elif upper == "RELREC":
            df = relationship(df, d, study)
        elif upper.startswith("SUPP") or upper.startswith("SQ"):
            df = supplemental(df, spec, d, study, rule.dialect)
        else:
            df = keyed(df, spec, d, study, rule.dialect)
    return df


def keyed(df: DataFrame, spec: dict, d: Dataset, study: Study, dialect: Dialect) -> DataFrame:
    name = str(spec.get("Name") or spec.get("name")).upper()
    name = d.domain[:2] + name[2:] if name.startswith("--") else name
    declared_left = str(spec.get("Join Type") or spec.get("join_type") or "").lower() == "left"
    found = study.of_domain(name)
    if not found:
        if declared_left and dialect is Dialect.CDISC:
            return df
        raise RuleSkipped(f"needs {name}, which is not in this study")
    right = _union(found).drop(RECORD)
    pairs = _pairs(spec, d.domain[:2], name[:2])
    lk, rk = _kinds(df), _kinds(right)
    absent = [a for a, b in pairs if a not in lk] + [b for a, b in pairs if b not in rk]
    if absent or not pairs:
        raise RuleSkipped(f"joins {name} by {', '.join(absent) or 'nothing'}, which is not there")
    keep = dialect is Dialect.CDISC or declared_left
    renamed = {c: f"{name}.{c}" for c in right.columns if not c.startswith("__")}
    keys = [_key_pair(df, a, right, b) for a, b in pairs]
    right = right.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), *(k.alias(f"__k{i}") for i, (_, k, _) in enumerate(keys)))
    on = F.lit(True)
    for i, (left, _, numbers) in enumerate(keys):
        theirs = F.col(f"__k{i}")
        if dialect is Dialect.CDISC:  # blanks pair with nothing
            on = on & (left == theirs) & (F.lit(True) if numbers else left != "")
        else:
            on = on & (left.eqNullSafe(theirs) if numbers else left == theirs)
    out = df.join(right, on, "left" if keep else "inner").drop(*(f"__k{i}" for i in range(len(pairs))))
    # Columns whose name is free also go by that name; of two with one name the joined one goes by both orders.
    theirs = {b for _, b in pairs}
    extra = {c if c not in lk else f"{c}.{name}": F.col(f"`{n}`") for c, n in renamed.items() if c not in lk or c not in theirs}
    out = out.withColumns(extra) if extra else out
    if declared_left and dialect is Dialect.CDISC:
        fill = [n for n in (*renamed.values(), *extra) if _kinds(out)[n] == "text"]
        out = out.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit("")) for n in fill})
    return out


def supplemental(df: DataFrame, spec: dict, d: Dataset, study: Study, dialect: Dialect) -> DataFrame:
    """Supplemental qualifiers as columns, joined by the variable that IDVAR names."""
    name = str(spec.get("Name") or spec.get("name")).upper().replace("--", d.domain[:2])
    supp = study.get(name) or next((x for x in study.datasets.values() if x.name.upper().startswith(("SUPP" + d.domain, "SQ" + d.domain))), None)
    if supp is None:
        if dialect is Dialect.CORE1:
            return df
        raise RuleSkipped(f"needs {name}, which is not in this study")
    s = supp.df
    static = [k for k in ("STUDYID", "USUBJID", "APID") if k in s.columns and k in df.columns]
    about = s.select(F.coalesce("IDVAR", F.lit("")).alias("v"), "QNAM").distinct().orderBy("v", "QNAM").collect()  # one row per qualifier name
    kinds = _kinds(df)
    for idvar in dict.fromkeys(r["v"] for r in about):
        names = [r["QNAM"] for r in about if r["v"] == idvar]
        if idvar and idvar not in kinds:
            raise RuleSkipped(f"{supp.name} is keyed by {idvar}, which {d.name} does not have")
        rows = s.filter(F.coalesce("IDVAR", F.lit("")) == idvar)
        if dialect is Dialect.CORE1 and "RDOMAIN" in s.columns:
            rows = rows.filter(F.upper("RDOMAIN") == d.domain)
        keys = [F.coalesce(tx.key_text(F.col(k), _kinds(s)[k]), F.lit("")).alias(f"__s{i}") for i, k in enumerate(static)]
        idkey = _key(F.col("IDVARVAL"), _kinds(s)["IDVARVAL"]).alias("__id") if idvar else F.lit("").alias("__id")
        wide = rows.select(*keys, idkey, "QNAM", "QVAL", RECORD).groupBy(*(f"__s{i}" for i in range(len(static))), "__id").pivot("QNAM", names).agg(F.min_by("QVAL", RECORD))
        wide = wide.select(*(c for c in wide.columns if c.startswith("__")), *(F.col(f"`{n}`").alias(f"__q_{n}") for n in names))
        on = F.lit(True)
        for i, k in enumerate(static):
            on = on & (_key(F.col(k), kinds[k]) == F.col(f"__s{i}"))
        if idvar:
            on = on & (_key(F.col(f"`{idvar}`"), kinds[idvar]) == F.col("__id"))
        df = df.join(wide, on, "left").drop("__id", *(f"__s{i}" for i in range(len(static))))
        # Later keys only fill what is still open.
        df = df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.col(f"`__q_{n}`")) if n in df.columns else F.col(f"`__q_{n}`") for n in names}).drop(*(f"__q_{n}" for n in names))
    return df


def _any_type(cols: list[tuple[Column, str]]) -> Column:
    """The first value that is there; as text where the columns are of unlike kinds."""
    kinds = {k for _, k in cols}
    return F.coalesce(*(c if len(kinds) == 1 else tx.text_of(c, k) for c, k in cols))


def child_to_parent(df: DataFrame, spec: dict, d: Dataset, study: Study, dialect: Dialect) -> DataFrame:
    """Each row of a child dataset with the first matching record of the dataset it names.

    A parent's record stands once for each key variable in use, as (domain, variable,
    value); so all parents are reduced to the first of a key, and joined, together.
    """
    if "RDOMAIN" not in df.columns:
        raise RuleSkipped(f"{d.name} has no RDOMAIN")
    for c in ("IDVAR", "IDVARVAL"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    blank_val = F.coalesce("IDVARVAL", F.lit("")) == ""
    df = df.withColumns({"__rd": F.upper(F.coalesce("RDOMAIN", F.lit(""))), "__iv": F.when(blank_val, "").otherwise(F.coalesce("IDVAR", F.lit("")))})
    kinds, seen = _kinds(df), df.select("__rd", "__iv").distinct().collect()  # a row per domain and key variable
    parents: dict[str, DataFrame] = {rd: _union(found) for rd in dict.fromkeys(r["__rd"] for r in seen) if (found := study.of_domain(rd))}
    if not parents:
        return df.drop("__rd", "__iv")
    held = {rd: _kinds(p) for rd, p in parents.items()}
    common = [k for k in ("STUDYID", "USUBJID") if k in kinds]
    by_id = [(r["__rd"], r["__iv"]) for r in seen if r["__rd"] in parents and r["__iv"] and r["__iv"] in held[r["__rd"]]]
    whole = {r["__rd"] for r in seen if r["__rd"] in parents} - {rd for rd in parents if all((rd, r["__iv"]) in by_id for r in seen if r["__rd"] == rd)}

    sides, on = [], ["__prd", "__piv", "__pid", *(f"__p{i}" for i in range(len(common)))]
    for rd, parent in parents.items():
        pk = held[rd]
        ways = [F.struct(F.lit(iv).alias("iv"), _key(F.col(f"`{iv}`"), pk[iv]).alias("id")) for r, iv in by_id if r == rd]
        ways += [F.struct(F.lit("").alias("iv"), F.lit("").alias("id"))] if rd in whole else []
        own = [(_key(F.col(f"`{k}`"), pk[k]) if k in pk else F.lit("")).alias(f"__p{i}") for i, k in enumerate(common)]
        sides.append(parent.select(F.lit(rd).alias("__prd"), F.explode(F.array(*ways)).alias("w"), *own, RECORD, *(F.col(f"`{c}`").alias(f"__c_{rd}_{c}") for c in pk if not c.startswith("__"))))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides).select("*", F.col("w.iv").alias("__piv"), F.col("w.id").alias("__pid"))
    values = [c for c in every.columns if c.startswith("__c_")]
    first = every.groupBy(*on).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in values)), RECORD).alias("__first"))

    use = reduce(Column.__or__, ((F.col("__rd") == rd) & (F.col("__iv") == iv) for rd, iv in by_id), F.lit(False))
    mine = {"__prd": F.col("__rd"), "__piv": F.when(use, F.col("__iv")).otherwise(""), "__pid": F.when(use, _key(F.col("IDVARVAL"), kinds["IDVARVAL"])).otherwise("")}
    for i, k in enumerate(common):
        mine[f"__p{i}"] = F.when(F.col("__rd").isin([rd for rd in parents if k in held[rd]]), _key(F.col(f"`{k}`"), kinds[k])).otherwise("")
    joined = df.withColumns(mine | {"__use": use}).join(first, on, "left")

    out: dict[str, Column] = {}
    new: dict[str, list[tuple[Column, str]]] = {}
    for rd, pk in held.items():
        for c in (c for c in pk if not c.startswith("__")):
            value = F.col(f"__first.`__c_{rd}_{c}`")
            if c not in kinds:
                new.setdefault(c, []).append((value, pk[c]))
            elif dialect is Dialect.CORE1:
                out[f"{rd}.{c}"] = value
            else:
                ids = any(r == rd for r, _ in by_id)
                if ids and c not in common and pk[c] == kinds[c]:
                    out[c] = F.coalesce(F.when(F.col("__use"), value), out.get(c, F.col(f"`{c}`")))
                if rd in whole or (ids and c in common):
                    out[f"{c}.{rd}"] = value if c in common and ids else F.when(~F.col("__use"), value)
    out |= {c: _any_type(found) for c, found in new.items()}
    return joined.withColumns(out).drop("__rd", "__iv", "__use", "__first", *on)


#: A link that names neither subject nor value relates whole domains; their rows are dealt to so many tasks.
_DEAL = 64


def relationship(df: DataFrame, d: Dataset, study: Study) -> DataFrame:
    """Records paired with those of other domains that RELREC relates them to; unrelated records go.

    A record stands once for each key variable in use, as (variable, value), and
    links are joined by that; so do the partners, all domains together. How many
    variables and domains are related adds no join.
    """
    relrec = study.get("RELREC")
    if relrec is None:
        raise RuleSkipped("needs RELREC, which is not in this study")
    kinds = _kinds(df)
    cols = ("STUDYID", "USUBJID", "RELID", "RDOMAIN", "IDVAR", "IDVARVAL")
    r = relrec.df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in relrec.columns else F.lit("").alias(c) for c in cols))
    value = F.when(F.col("IDVARVAL") != "", _key(F.col("IDVARVAL"), "text"))
    # A subject or a value that is not named meets all; 1 and 2 mark them, so that it is not taken for a blank one.
    all_subjects = F.col("USUBJID") == "" if "USUBJID" in kinds else F.lit(True)
    all_values = (F.col("IDVARVAL") == "") | (F.col("IDVAR") == "")
    wide = F.when(all_subjects, 1).otherwise(0) + F.when(all_values, 2).otherwise(0)
    same = ("STUDYID", "USUBJID", "RELID")
    mine = r.filter(F.upper("RDOMAIN") == d.domain).select(*(F.col(c).alias(f"__l_{c}") for c in same), F.col("IDVAR").alias("__v"), wide.alias("__w"), F.when(all_subjects, "").otherwise(F.col("USUBJID")).alias("__u"), F.when(all_values, "").otherwise(value).alias("__x"))
    theirs = r.filter(F.upper("RDOMAIN") != d.domain).select(*(F.col(c).alias(f"__l_{c}") for c in same), F.col("RDOMAIN").alias("__d"), F.col("IDVAR").alias("__t"), value.alias("__given"))
    links = mine.join(theirs, [f"__l_{c}" for c in same]).drop(*(f"__l_{c}" for c in same))
    shapes = links.select("__v", "__w", "__d", "__t").distinct().collect()  # a row per pair of key variables

    partners = {n: _union(found) for n in dict.fromkeys(s["__d"] for s in shapes) if (found := study.of_domain(n))}
    held = {n: _kinds(p) for n, p in partners.items()}
    shapes = [s for s in shapes if (not s["__v"] or s["__v"] in kinds) and s["__d"] in held and (not s["__t"] or s["__t"] in held[s["__d"]])]
    if not shapes:
        return df.filter(F.lit(False))

    def own(v: str) -> Column:
        return _key(F.col(f"`{v}`"), kinds[v]) if v else F.lit(None).cast("string")

    deal = F.pmod(F.col(RECORD), F.lit(_DEAL)).cast("int")
    ways = []
    for v, w in dict.fromkeys((s["__v"], s["__w"]) for s in shapes):
        u = F.lit("") if w & 1 else F.col("USUBJID").cast("string")
        ways.append(F.struct(F.lit(v).alias("__v"), F.lit(w).alias("__w"), u.alias("__u"), (F.lit("") if w & 2 else own(v)).alias("__x"), (deal if w == 3 else F.lit(0)).alias("__s"), own(v).alias("__own")))
    names = df.columns
    left = df.withColumn("__way", F.explode(F.array(*ways))).select(*(F.col(f"`{c}`") for c in names), "__way.*")
    dealt = links.withColumn("__s", F.explode(F.when(F.col("__w") == 3, F.sequence(F.lit(0), F.lit(_DEAL - 1))).otherwise(F.array(F.lit(0)))))
    left = left.join(dealt, ["__v", "__w", "__u", "__x", "__s"])

    both = {c: [n for n in held if c in held[n]] for c in ("USUBJID", "STUDYID") if c in kinds}
    left = left.withColumns({f"__m_{c}": F.when(F.col("__d").isin(of), F.col(c).cast("string")).otherwise("") for c, of in both.items()} | {"__y": F.when(F.col("__t") == "", "").otherwise(F.coalesce("__given", "__own"))})
    sides = []
    for n, partner in partners.items():
        pk = held[n]
        to = [F.struct(F.lit(t).alias("__t"), (_key(F.col(f"`{t}`"), pk[t]) if t else F.lit("")).alias("__y")) for t in dict.fromkeys(s["__t"] for s in shapes if s["__d"] == n)]
        if to:
            keys = [(F.col(c).cast("string") if c in pk else F.lit("")).alias(f"__m_{c}") for c in both]
            sides.append(partner.select(F.lit(n).alias("__d"), F.explode(F.array(*to)).alias("w"), *keys, *(F.col(f"`{c}`").alias(f"RELREC.{c}") for c in pk if not c.startswith("__"))).select("*", "w.*").drop("w"))
    right = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    extra = [c for c in right.columns if c.startswith("RELREC.")]
    out = left.join(right, ["__d", "__t", "__y", *(f"__m_{c}" for c in both)])
    return out.select(*(F.col(f"`{c}`") for c in (*names, *extra)))
