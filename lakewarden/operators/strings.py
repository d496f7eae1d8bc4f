"""Regular expressions, lengths, parts of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import RuleSkipped
from ..plans.table import Context, Operand
from .registry import known, negated, operator, unknown




def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _pattern(ctx: Context, anchored: bool = True) -> str:
    p = tx.literal_regex(str(ctx.condition["value"]))
    return f"^(?:{p})" if anchored and not ctx.core1 else p


def _matches(negative: bool, fold: bool) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        t = ctx.target.text()
        hit = t.rlike(("(?i)" if fold else "") + _pattern(ctx))
        return F.coalesce(_filled(t) & (~hit if negative else hit), F.lit(False))

    return run


operator("matches_regex")(_matches(False, False))
operator("not_matches_regex")(_matches(True, False))
operator("matches_regex_case_insensitive")(_matches(False, True))
operator("not_matches_regex_case_insensitive")(_matches(True, True))


def _length(compare: Callable) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        if not ctx.core1 and ctx.target.kind == "num":
            raise RuleSkipped(f"{ctx.condition['operator']} measures text, and {ctx.name} is numeric")
        t, v = ctx.target.text(), ctx.value
        literal = v.values[0] if v.values else None
        wanted = F.lit(int(float(literal))) if literal is not None and str(literal).replace(".", "", 1).isdigit() else (v.number().cast("int") if v.kind == "num" else F.char_length(v.text()))
        out = compare(F.char_length(F.coalesce(t, F.lit(""))), wanted)
        return F.coalesce(out & _filled(t) if ctx.core1 else out, F.lit(False))

    return run


operator("longer_than")(_length(lambda a, b: a > b))
operator("longer_than_or_equal_to")(_length(lambda a, b: a >= b))
operator("shorter_than")(_length(lambda a, b: a < b))
operator("shorter_than_or_equal_to")(_length(lambda a, b: a <= b))
operator("has_equal_length")(_length(lambda a, b: a == b))
operator("has_not_equal_length")(_length(lambda a, b: a != b))


def _any(ctx: Context, test: Callable[[Column, Column], Column], fold: bool = False) -> Column:
    """The test holds for any of the values."""
    t, v = ctx.target.text(), ctx.value
    up = F.upper if fold else (lambda c: c)
    if v.is_set:
        return F.coalesce(F.exists(v.col, lambda x: F.coalesce(test(up(t), up(x)), F.lit(False))), F.lit(False))
    return F.coalesce(test(up(t), up(v.text())), F.lit(False))


def _contains(fold: bool) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        t, v = ctx.target, ctx.value
        if not t.is_set:
            return _any(ctx, F.contains, fold)
        up = F.upper if fold else (lambda c: c)
        members = F.transform(t.col, up) if fold else t.col
        if v.is_set:
            return F.coalesce(F.exists(v.col, lambda x: F.array_contains(members, up(x))), F.lit(False))
        return F.coalesce(F.array_contains(members, up(v.text())), F.lit(False))

    return run


operator("contains")(_contains(False))
negated("does_not_contain", "contains")
operator("contains_case_insensitive")(_contains(True))
negated("does_not_contain_case_insensitive", "contains_case_insensitive")


@operator("starts_with")
def starts_with(ctx: Context) -> Column:
    return _any(ctx, F.startswith) if known(ctx) else unknown()


@operator("ends_with")
def ends_with(ctx: Context) -> Column:
    return _any(ctx, F.endswith) if known(ctx) else unknown()


def _affix(ctx: Context, front: bool) -> Column:
    n = int(ctx.condition.get("prefix" if front else "suffix") or 0)
    return F.left(ctx.target.text(), F.lit(n)) if front else F.right(ctx.target.text(), F.lit(n))


def _affix_matches(front: bool, negative: bool, fold: bool) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        hit = _affix(ctx, front).rlike(("(?i)" if fold else "") + _pattern(ctx, anchored=False))
        guard = _filled(ctx.target.text())
        return F.coalesce(guard & (~hit if negative else hit) if negative or fold or not front else hit, F.lit(False))

    return run


for _front, _word in ((True, "prefix"), (False, "suffix")):
    for _fold, _tail in ((False, ""), (True, "_case_insensitive")):
        operator(f"{_word}_matches_regex{_tail}")(_affix_matches(_front, False, _fold))
        operator(f"not_{_word}_matches_regex{_tail}")(_affix_matches(_front, True, _fold))


def _among(part: Column, v: Operand, fold: bool) -> Column:
    low = F.lower if fold else (lambda c: c)
    if v.is_set:
        return F.coalesce(F.exists(v.col, lambda x: low(part) == low(x)), F.lit(False))
    return F.coalesce(low(part) == low(v.text()), F.lit(False))


def _affix_equal(front: bool) -> Callable[[Context], Column]:
    def run(ctx: Context) -> Column:
        if not known(ctx):
            return unknown()
        fold = ctx.core1 or not front
        out = _among(_affix(ctx, front), ctx.value, fold)
        return out & _filled(ctx.target.text()) if fold else out

    return run


operator("prefix_equal_to")(_affix_equal(True))
negated("prefix_not_equal_to", "prefix_equal_to")
operator("suffix_equal_to")(_affix_equal(False))
negated("suffix_not_equal_to", "suffix_equal_to")


def _affix_among(front: bool, fold: bool) -> Callable[[Context], Column]:
    return lambda ctx: _among(_affix(ctx, front), ctx.value, fold) if known(ctx) else unknown()


for _front, _word in ((True, "prefix"), (False, "suffix")):
    for _fold, _tail in ((False, ""), (True, "_case_insensitive")):
        operator(f"{_word}_is_contained_by{_tail}")(_affix_among(_front, _fold))
        negated(f"{_word}_is_not_contained_by{_tail}", f"{_word}_is_contained_by{_tail}")


@operator("does_not_equal_string_part")
def does_not_equal_string_part(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    t, v, p = ctx.target.text(), ctx.value.text(), tx.literal_regex(str(ctx.condition["regex"]))
    found = F.coalesce(v.rlike(p), F.lit(False))
    part = F.when(found, F.regexp_extract(v, p, 1))
    if ctx.core1:
        return F.coalesce(_filled(t) & _filled(v) & found & (t != part), F.lit(False))
    return F.coalesce(F.coalesce(t, F.lit("")) != F.coalesce(part, v), F.lit(False))


@operator("is_substring_of")
def is_substring_of(ctx: Context) -> Column:
    if not known(ctx):
        return unknown()
    t, v = ctx.target.text(), ctx.value
    filled = ~ctx.target.blank()
    if v.is_set and v.column == "library_variable_ccode_values":  # the terms of a codelist are asked for as a whole
        return filled & F.coalesce(F.array_contains(v.col, t), F.lit(False))
    if v.is_set:
        return filled & F.coalesce(F.exists(v.col, lambda x: (x != "") & F.contains(x, t)), F.lit(False))
    return filled & F.coalesce(F.contains(v.text(), t), F.lit(False))


negated("is_not_substring_of", "is_substring_of")
