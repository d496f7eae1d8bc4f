"""Membership and relations of sets. None of them gives NULL for a NULL member."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import relations as rel
from ..plans.table import Context, Operand, tidy
from .registry import known, negated, operator, unknown


def _members(x: Operand) -> Column:
    """One set per row; NULL members count as empty text."""
    if not x.is_set:
        return F.array(F.coalesce(x.text(), F.lit("")))
    return F.transform(F.coalesce(x.col, F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")))


@operator("is_contained_by")
def is_contained_by(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    t, v = ctx.target, ctx.value
    if t.is_set and not t.collection:
        a = _members(t)
        if v.source is not None:
            found = rel.among(ctx.table, a, v.source)
            return (F.size(a) > 0) & (F.size(found) == F.size(a)) if ctx.core1 else F.size(found) > 0
        b = _members(v)
        if ctx.core1:
            return (F.size(a) > 0) & F.forall(a, lambda x: F.array_contains(b, x))
        return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    text = F.coalesce(t.text(), F.lit(""))
    if v.source is not None:  # an existence join, however many members there are
        return rel.holds(ctx.table, text, v.source)
    if v.values is not None and not v.per_row and v.is_set and len(v.values) <= 200:
        return text.isin([tidy(x) for x in v.values]) if v.values else F.lit(False)
    return F.array_contains(_members(v), text)


negated("is_not_contained_by", "is_contained_by")


@operator("is_contained_by_case_insensitive")
def is_contained_by_case_insensitive(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    text = F.upper(F.coalesce(ctx.target.text(), F.lit("")))
    if ctx.value.source is not None:
        return rel.holds(ctx.table, text, rel.folded(ctx.value.source))
    return F.array_contains(F.transform(_members(ctx.value), F.upper), text)


negated("is_not_contained_by_case_insensitive", "is_contained_by_case_insensitive")


def _all_in(ctx: Context) -> Column:
    """Every value is among the targets: per row where a side is a set per row, else one verdict for the dataset.

    Whole columns and sets that are tables are compared by joins; no task gathers one of them.
    """
    t, v = ctx.target, ctx.value
    if v.is_set and not v.collection and t.source is not None:
        b = _members(v)
        return F.size(rel.among(ctx.table, b, t.source)) == F.size(b)
    if t.is_set and not t.collection and v.source is not None:
        many = ctx.table.join(v.source.agg(F.count(F.lit(1)).alias("n")), [], "n", "num")
        return F.size(F.array_distinct(rel.among(ctx.table, _members(t), v.source))) == many
    if (t.is_set and not t.collection) or (v.is_set and not v.collection):
        a, b = _members(t), _members(v)
        return F.forall(b, lambda x: F.array_contains(a, x))
    if t.is_set and t.source is None and v.source is None:
        a = _members(t)
        return F.forall(_members(v), lambda x: F.array_contains(a, x))
    seen = rel.relation(t, ctx.table) if t.is_set else ctx.table.df.select(F.coalesce(t.text(), F.lit("")).alias("v"))
    if v.values is not None:
        wanted = sorted({tidy(x) for x in v.values})
        all_there = seen.filter(F.col("v").isin(wanted)).agg((F.count_distinct("v") == len(wanted)).alias("all"))
    else:
        all_there = rel.relation(v, ctx.table).join(seen.distinct(), "v", "left_anti").agg((F.count(F.lit(1)) == 0).alias("all"))
    return ctx.table.join(all_there, [], "all", "bool")


def _verdict(ctx: Context, negative: bool) -> Column:
    if not known(ctx):
        return unknown()
    out = _all_in(ctx)
    out = ~out if negative else out
    per_row = (ctx.target.is_set and not ctx.target.collection) or (ctx.value.is_set and not ctx.value.collection)
    return out if per_row or ctx.core1 else out & (ctx.table.record == 1)


operator("contains_all")(lambda ctx: _verdict(ctx, False))
operator("not_contains_all")(lambda ctx: _verdict(ctx, True))


@operator("shares_no_elements_with")
def shares_no_elements_with(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    t, v = ctx.target, ctx.value
    if t.source is None and v.source is None:
        return ~F.arrays_overlap(_members(t), _members(v))
    left, right = rel.relation(t, ctx.table), rel.relation(v, ctx.table)
    if left is not None and right is not None:
        return rel.disjoint(ctx.table, left, right)
    own, members = (t, right) if left is None else (v, left)
    if own.is_set:
        return F.size(rel.among(ctx.table, _members(own), members)) == 0
    return ~rel.holds(ctx.table, F.coalesce(own.text(), F.lit("")), members)


@operator("is_ordered_subset_of")
def is_ordered_subset_of(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    b = _members(ctx.value)
    at = F.transform(_members(ctx.target), lambda x: F.array_position(b, x))
    return F.forall(at, lambda p: p > 0) & (at == F.array_sort(at))


negated("is_not_ordered_subset_of", "is_ordered_subset_of")


@operator("in_enumerated_columns")
def in_enumerated_columns(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    base = re.sub(r"\d+$", "", ctx.name)
    cols = [c for c in ctx.table.names if re.fullmatch(re.escape(base) + r"\d*", c)]
    fold, regex = ctx.condition.get("case_insensitive"), ctx.condition.get("regex")

    def form(c: Column) -> Column:
        c = F.regexp_extract(c, regex, 1 if "(" in regex else 0) if regex else c
        return F.upper(c) if fold else c

    wanted = form(F.coalesce(ctx.value.text(), F.lit("")))
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(form(Operand(ctx.table.col(c), ctx.table.kind(c)).text()) == wanted, F.lit(False))
    return out


negated("not_in_enumerated_columns", "in_enumerated_columns")
