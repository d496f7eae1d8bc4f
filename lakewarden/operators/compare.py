"""Equality and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import RuleSkipped
from ..plans.table import Context, Operand
from .registry import known, operator, unknown




def _as_set(x: Operand) -> Column:
    return x.col if x.is_set else F.array(x.text())


def _sides(ctx: Context) -> tuple[Column, Column, bool]:
    """Both sides brought to one type, and whether they can only differ."""
    t, v, flag = ctx.target, ctx.value, ctx.condition.get("type_insensitive")
    differ = (t.kind == "num") != (v.kind == "num")
    if ctx.core1 and differ and not flag and v.column is not None:
        raise RuleSkipped("compares a text column with a numeric one, which CORE 1.0 cannot do")
    if ctx.core1 and flag is True:
        return t.text(), v.text(), False
    if ctx.core1 and flag == "numeric":
        return t.number(), v.number(), False
    if flag or (ctx.core1 and differ):
        return tx.canonical(t.col, t.kind), tx.canonical(v.col, v.kind), False
    if differ:
        return t.text(), v.text(), True
    if t.kind == "num":
        return t.col.cast("double"), v.col.cast("double"), False
    return t.text(), v.text(), False


def _equality(ctx: Context, negative: bool, fold: bool) -> Column:
    if not known(ctx):
        return unknown()
    t, v = ctx.target, ctx.value
    if t.is_set or v.is_set:
        a, b = _as_set(t), _as_set(v)
        if fold:
            raise RuleSkipped(f"comparison of set-valued operands is not implemented for {ctx.condition['operator']}")
        empty = (F.size(F.coalesce(a, F.array().cast("array<string>"))) == 0) & (F.size(F.coalesce(b, F.array().cast("array<string>"))) == 0)
        same = F.coalesce(a == b, F.lit(False))
        return F.when(empty, False).otherwise(~same if negative else same)
    a, b, unlike = _sides(ctx)
    if fold:
        a, b = F.upper(a), F.upper(b)
    verdict = F.lit(negative) if unlike else (a != b if negative else a == b)
    if ctx.core1 and ctx.condition.get("type_insensitive") == "numeric":
        # Two values that are no numbers are alike.
        verdict = ~a.eqNullSafe(b) if negative else a.eqNullSafe(b)
    if unlike:
        verdict = F.when(a.isNotNull() & b.isNotNull(), verdict)
    tb, vb = t.blank(), v.blank()
    if negative:
        out = F.when(tb & ~vb, True)
        if v.per_row:
            out = out.when(~tb & vb, True).when(tb & vb, False)
    else:
        out = F.when(tb, False)
        if v.per_row:
            out = out.when(vb, False)
    out = out.otherwise(verdict)
    if ctx.core1 and v.no_column is not None and not fold:
        if negative:
            out = F.when(tb, vb).otherwise(out)
        out = F.when(v.no_column, False).otherwise(out)
    return out


@operator("equal_to")
def equal_to(ctx: Context) -> Column:
    return _equality(ctx, False, False)


@operator("not_equal_to")
def not_equal_to(ctx: Context) -> Column:
    return _equality(ctx, True, False)


@operator("equal_to_case_insensitive")
def equal_to_case_insensitive(ctx: Context) -> Column:
    return _equality(ctx, False, True)


@operator("not_equal_to_case_insensitive")
def not_equal_to_case_insensitive(ctx: Context) -> Column:
    return _equality(ctx, True, True)


def _ordinal(compare):
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        if ctx.target.is_set or ctx.value.is_set:
            raise RuleSkipped(f"comparison of set-valued operands is not implemented for {ctx.condition['operator']}")
        v = ctx.value
        if v.values and v.kind == "text" and str(v.values[0]) != "":
            try:
                float(str(v.values[0]).strip())
            except ValueError:
                return ctx.refuse_rows(f"{ctx.condition['operator']} compares with '{v.values[0]}', which is neither a number nor a column of this dataset")
        return F.coalesce(compare(ctx.target.number(), v.number()), F.lit(False))

    return run


operator("less_than")(_ordinal(lambda a, b: a < b))
operator("less_than_or_equal_to")(_ordinal(lambda a, b: a <= b))
operator("greater_than")(_ordinal(lambda a, b: a > b))
operator("greater_than_or_equal_to")(_ordinal(lambda a, b: a >= b))
