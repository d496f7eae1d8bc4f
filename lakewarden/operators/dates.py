"""Partial dates, durations and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..model import RuleSkipped
from ..plans.table import Context, Operand
from .registry import known, operator, unknown


#: First and last character of a 1.0 rule's date_component (fixed values).
_COMPONENT = {"year": (1, 4), "month": (6, 7), "day": (9, 10), "hour": (12, 13), "minute": (15, 16), "second": (18, 19), "microsecond": (21, 26)}


def _parts(ctx: Context, x: Operand) -> dt.DateParts:
    """Date parts, written out once per column of the table."""
    known_ = ctx.table.dates
    if x.column not in known_ or x.column is None:
        known_[x.column] = dt.date_parts(x.text(), ctx.table.add_all)
    return known_[x.column]


def _compare(name: str, test: Callable[[Column, Column], Column]) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        if ctx.core1:
            return _compare_text(ctx, test)
        a, b = _parts(ctx, ctx.target), _parts(ctx, ctx.value)
        level = f"least({a.precision}, {b.precision})"
        readable = F.expr(f"{a.valid} AND {b.valid} AND {a.precision} >= 0 AND {b.precision} >= 0")
        verdict = test(a.instant(level), b.instant(level))
        if name == "eq":
            verdict = F.expr(f"{a.precision} = {b.precision}") & verdict
        if name == "ne":
            verdict = F.expr(f"{a.precision} <> {b.precision}") | verdict
        neither = F.expr(f"NOT ({a.text} = '' AND {b.text} = '')") if name == "ne" else F.lit(False)
        return F.coalesce(F.when(readable, verdict).otherwise(neither), F.lit(False))

    return run


def _compare_text(ctx: Context, test: Callable[[Column, Column], Column]) -> Column:
    """1.0 rules compare texts: a component of both, or both dates cut to the shorter one. What is no date, or too short, compares with nothing."""
    component = ctx.condition.get("date_component")
    if component is not None and component not in _COMPONENT:
        raise RuleSkipped(f"unknown date_component: {component}")
    a, b = ctx.target.text(), ctx.value.text()
    if component:
        first, last = _COMPONENT[component]
        x, y = (F.when(F.char_length(c) >= last, F.substring(c, first, last - first + 1)) for c in (a, b))
    else:
        n = F.least(F.char_length(a), F.char_length(b))
        x, y = (F.when((c != "") & dt.outline(c).rlike(dt.DATE_OUTLINE), F.left(c, n)) for c in (a, b))
    return F.coalesce(test(x, y), F.lit(False))


operator("date_equal_to")(_compare("eq", lambda a, b: a == b))
operator("date_not_equal_to")(_compare("ne", lambda a, b: a != b))
operator("date_greater_than")(_compare("gt", lambda a, b: a > b))
operator("date_less_than")(_compare("lt", lambda a, b: a < b))
operator("date_greater_than_or_equal_to")(_compare("ge", lambda a, b: a >= b))
operator("date_less_than_or_equal_to")(_compare("le", lambda a, b: a <= b))


@operator("is_complete_date")
def is_complete_date(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(False)
    text = F.coalesce(ctx.target.text(), F.lit(""))
    if ctx.core1:
        return dt.outline(text).rlike(dt.WHOLE_OUTLINE)
    p = _parts(ctx, ctx.target)
    return F.expr(f"coalesce({p.valid} AND {p.precision} >= 2 AND NOT contains({p.text}, '/'), false)")


@operator("is_incomplete_date")
def is_incomplete_date(ctx: Context) -> Column:
    return ~is_complete_date(ctx) if ctx.exists else F.lit(False)


@operator("invalid_date")
def invalid_date(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(False)
    return ~dt.valid_date_core1(ctx.target.text()) if ctx.core1 else ~F.col(_parts(ctx, ctx.target).valid)


@operator("invalid_duration")
def invalid_duration(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(False)
    text, negative = ctx.target.text(), ctx.condition.get("negative")
    if ctx.core1:
        return text.isNotNull() & ~dt.valid_duration(text, negative is True, core1=True)
    return ~dt.valid_duration(text, negative is not False)


@operator("invalid_date_interval")
def invalid_date_interval(ctx: Context) -> Column:
    """Not a/b of two dates, or of a date and a duration that is not negative, all as 1.0 rules know them."""
    if not ctx.exists:
        return F.lit(False)
    text = ctx.table.add(F.coalesce(ctx.target.text(), F.lit("")))
    ends = [F.split_part(text, F.lit("/"), F.lit(i)) for i in (1, 2)]
    dates = [ctx.table.add(dt.valid_date_core1(e)) for e in ends]
    spans = [dt.valid_duration(e, negative=False, core1=True) for e in ends]
    paired = (dates[0] & dates[1]) | (dates[0] & spans[1]) | (spans[0] & dates[1])
    return ~(text.rlike("^[^/]+/[^/]+$") & paired)
