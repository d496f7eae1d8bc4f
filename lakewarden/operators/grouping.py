"""Uniqueness, relationships and consistency: aggregates per key, joined back where they tell a violation.

No window gathers the rows of a key, so a key may hold any share of them (``Table.of_key``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import RECORD, RuleSkipped
from ..plans.table import Context
from .registry import negated, operator


def _key(ctx: Context, name: str) -> Column:
    return tx.group_key(ctx.table.col(name), ctx.table.kind(name))


def _first_values(ctx: Context, df: DataFrame) -> dict[str, str | None]:
    """The first filled value of every text column, found in one pass and kept with the dataset."""
    if RECORD not in df.columns:
        return {}
    facts = ctx.table.dataset.facts if ctx.table.dataset is not None else {}
    if "first" not in facts or not set(ctx.table.names) <= set(facts["first"]):
        texts = [c for c in ctx.table.names if ctx.table.kind(c) == "text"]
        row = df.agg(*(F.min_by(ctx.table.col(c), F.when(ctx.table.col(c) != "", F.col(RECORD))).alias(f"c{i}") for i, c in enumerate(texts))).first() if texts else []
        facts["first"] = dict.fromkeys(ctx.table.names) | dict(zip(texts, row))
    return facts["first"]


def _reduced(ctx: Context, name: str, df: DataFrame) -> Column:
    """The key of a column after the condition's regex, if the column's first filled value matches it at the start."""
    regex = ctx.condition.get("regex")
    if not regex or ctx.table.kind(name) != "text":
        return _key(ctx, name)
    p = tx.literal_regex(str(regex))
    c = ctx.table.col(name)
    first = _first_values(ctx, df).get(name)
    if not first or not re.match(p, first):
        return _key(ctx, name)
    groups = re.compile(p).groups
    if ctx.core1:
        part = F.regexp_extract(c, f"^(?:{p})", 0)
        return tx.group_key(F.when(part != "", part).otherwise(c))
    if not groups:
        return tx.group_key(F.regexp_extract(c, p, 0))
    joined = F.concat_ws("\x1f", *(F.regexp_extract(c, p, i + 1) for i in range(groups)))
    return tx.group_key(F.when(c.rlike(p), joined).otherwise(""))


@operator("is_not_unique_set")
def is_not_unique_set(ctx: Context) -> Column:
    if ctx.core1 and not ctx.exists:
        return F.lit(False)
    cols = [c for c in dict.fromkeys([ctx.name, *ctx.names(ctx.condition.get("value") or [])]) if ctx.table.has(c)]
    if not cols:
        if ctx.core1:
            return F.lit(False)
        raise RuleSkipped(f"needs {ctx.name}, none of which this dataset has")
    keys = [_reduced(ctx, c, ctx.table.df) for c in cols]
    siblings = _siblings(ctx)
    if not siblings:
        return ctx.table.of_key(keys, F.col("__n") > 1)
    # A split domain: keys that other files hold, counted before they are joined.
    key = F.concat_ws("\x1e", *keys)
    own = ctx.table.df.select(key.alias("k"))
    for d in siblings:
        own = own.union(d.df.select(F.concat_ws("\x1e", *(tx.group_key(F.col(f"`{c}`")) if c in d.columns else F.lit("\x1fblank") for c in cols)).alias("k")))
    counts = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return F.coalesce(ctx.table.join(counts, [(key, "k")], "n", "num") > 1, F.lit(False))


def _siblings(ctx: Context) -> list:
    d = ctx.table.dataset
    if d is None:
        return []
    return [o for o in ctx.table.study.datasets.values() if o is not d and o.name != d.name and o.domain == d.domain and o.domain_value]


@operator("is_unique_set")
def is_unique_set(ctx: Context) -> Column:
    if ctx.core1 and not ctx.exists:
        return F.lit(False)
    return ~is_not_unique_set(ctx)


@operator("is_not_unique_relationship")
def is_not_unique_relationship(ctx: Context) -> Column:
    if not ctx.exists or ctx.value is None:
        return F.lit(False)
    wanted = ctx.names(ctx.condition["value"])
    present = [c for c in wanted if ctx.table.has(c)]
    if not present:
        return F.lit(False)

    def text(c: str) -> Column:
        return F.coalesce(tx.text_of(ctx.table.col(c), ctx.table.kind(c)), F.lit(""))

    t = F.coalesce(ctx.target.text(), F.lit(""))
    joined = text(present[0]) if len(wanted) == 1 else F.concat_ws("|", *map(text, present))
    if len(wanted) > 1 and not ctx.core1:
        blank = F.lit(True)
        for c in present:
            blank = blank & (text(c) == "")
        joined = F.when(blank, "").otherwise(joined)
    c = joined

    def many(key: Column, val: Column) -> Column:
        """Whether a key has several values; unless by 1.0, a blank key has none, and a blank value is one beside a filled one."""
        having = F.col("lo") != F.col("hi")
        return ctx.table.of_key([key], having if ctx.core1 else having & (F.col("k0") != ""), lo=F.min(val), hi=F.max(val))

    return many(t, c) | many(c, t)


@operator("is_unique_relationship")
def is_unique_relationship(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(not ctx.core1)
    return ~is_not_unique_relationship(ctx)


@operator("has_same_values")
def has_same_values(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(False)
    t = F.coalesce(ctx.target.text(), F.lit(""))
    spread = ctx.table.df.agg((F.min(t).eqNullSafe(F.max(t))).alias("same"))
    return ctx.table.join(spread, [], "same", "bool")


@operator("present_on_multiple_rows_within")
def present_on_multiple_rows_within(ctx: Context) -> Column:
    within = ctx.table.resolve(ctx.condition.get("within"))
    if ctx.exists and not ctx.table.has(within) and not ctx.core1:
        raise RuleSkipped(f"groups by {within}, which this dataset does not have")
    if not ctx.exists or not ctx.table.has(within):
        return F.lit(False)
    return ctx.table.of_key([_key(ctx, within), tx.group_key(ctx.target.col, ctx.target.kind)], F.col("__n") > 1)


negated("not_present_on_multiple_rows_within", "present_on_multiple_rows_within")


@operator("is_inconsistent_across_dataset")
def is_inconsistent_across_dataset(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(False)
    cols = [c for c in ctx.names(ctx.condition.get("value") or []) if ctx.table.has(c)]
    if not cols:
        return F.lit(False)
    filled = [ctx.name, *cols] if ctx.condition.get("where_populated") else []
    asked = ctx.condition.get("where_populated_columns")
    if asked:
        named = [c for c in ctx.names(asked) if ctx.table.has(c)]
        if not named and not filled:
            raise RuleSkipped("none of the where_populated_columns is a column of this dataset")
        filled = list(dict.fromkeys([*filled, *named]))
    take = F.lit(True)
    for c in filled:
        take = take & ~tx.blank(ctx.table.col(c), ctx.table.kind(c))
    # NULL and empty text are two values here.
    value = F.coalesce(ctx.target.text(), F.lit("\x1enull"))
    keys = [F.coalesce(tx.text_of(ctx.table.col(c), ctx.table.kind(c)), F.lit("\x1enull")) for c in cols]
    counted = F.when(take, value)
    return take & ctx.table.of_key(keys, F.col("lo") != F.col("hi"), lo=F.min(counted), hi=F.max(counted))

