"""Column helpers for text, numbers and blanks. All of them are total: none raises under ANSI mode."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column, kind: str = "text") -> Column:
    """NULL or, for text, the empty string; for sets, no member that is filled."""
    if kind == "set":
        return c.isNull() | (F.size(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")) == 0)
    return c.isNull() | (c == "") if kind == "text" else c.isNull()


def number(c: Column, kind: str = "text") -> Column:
    """The number a value reads as, or NULL."""
    if kind == "num":
        return c.cast("double")
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")


def _typed(c: Column, *names: str) -> Column:
    """Whether the column has one of the types; known when the plan is made, so the other branch goes."""
    return F.typeof(c).isin(*names)


def number_text(c: Column) -> Column:
    """A number in plain digits: whole numbers without a point, others to 15 significant digits. Integers are exact."""
    d = c.cast("double")
    whole = F.when(d == F.floor(d), F.when(F.abs(d) < 9e18, d.cast("bigint").cast("string")).otherwise(d.try_cast("decimal(38,0)").cast("string")))
    # Decimals by magnitude, so that small values keep their digits.
    small = F.rtrim(d.try_cast("decimal(38,24)").cast("string"), F.lit("0"))
    middle = F.rtrim(F.round(d, 14).try_cast("decimal(38,14)").cast("string"), F.lit("0"))
    other = F.coalesce(whole, F.when(F.abs(d) < 1e-3, small), middle, d.cast("string"))
    return F.when(_typed(c, "tinyint", "smallint", "int", "bigint"), c.cast("string")).otherwise(other)


def text_of(c: Column, kind: str = "text") -> Column:
    """Any scalar as text."""
    if kind == "num":
        return number_text(c)
    if kind == "bool":
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if kind == "set":
        members = F.transform(c, lambda x: F.concat(F.lit("'"), F.coalesce(x, F.lit("")), F.lit("'")))
        return F.concat(F.lit("["), F.array_join(members, ", "), F.lit("]"))
    return c.cast("string")


def canonical(c: Column, kind: str = "text") -> Column:
    """Text in which numbers of equal value are equal ("200.00" and 200). Whole numbers of any length stay exact."""
    if kind == "num":
        return number_text(c)
    t, n = text_of(c, kind), number(c, kind)
    digits = F.trim(t)
    plain = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    plain = F.when(plain == "-0", "0").otherwise(plain)
    return F.when(digits.rlike(r"^[+-]?\d+$"), plain).when(n.isNotNull(), number_text(n)).otherwise(t)


def key_text(c: Column, kind: str = "text") -> Column:
    """A join key: trimmed text, numbers by value."""
    return canonical(F.trim(c) if kind == "text" else c, kind)


def group_key(c: Column, kind: str = "text") -> Column:
    """A grouping key in which all blanks are one value."""
    t = text_of(c, kind)
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("\x1fblank")).otherwise(t)


def like_filter(c: Column, kind: str, wanted: object, wildcard: str) -> Column:
    """Equality, or a prefix where ``wanted`` ends in the wildcard; NULL matches nothing."""
    if isinstance(wanted, list):
        out = F.lit(False)
        for w in wanted:
            out = out | like_filter(c, kind, w, wildcard)
        return out
    if isinstance(wanted, str) and wanted.endswith(wildcard) and wanted != wildcard:
        return F.coalesce(F.startswith(text_of(c, kind), F.lit(wanted[: -len(wildcard)])), F.lit(False))
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(number(c, kind) == F.lit(float(wanted)), F.lit(False))
    if isinstance(wanted, bool):
        wanted = str(wanted).lower() if kind == "bool" else ("Y" if wanted else "N")
    return F.coalesce(canonical(c, kind) == canonical(F.lit(str(wanted))) if kind == "num" else text_of(c, kind) == F.lit(str(wanted)), F.lit(False))


def literal_regex(pattern: str) -> str:
    """A pattern in which a named group is written as Java writes it."""
    return re.sub(r"\(\?P<", "(?<", pattern)
