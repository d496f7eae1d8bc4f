"""Presence of variables and values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import relations as rel
from ..plans.table import Context
from .registry import negated, operator


@operator("exists")
def exists(ctx: Context) -> Column:
    return F.lit(ctx.exists)


@operator("not_exists")
def not_exists(ctx: Context) -> Column:
    return F.lit(not ctx.exists)


@operator("empty")
def empty(ctx: Context) -> Column:
    if not ctx.exists:
        return F.lit(None).cast("boolean")
    t = ctx.target
    if t.source is not None:
        return rel.is_blank(ctx.table, t.source)
    if t.kind == "text" and not ctx.core1 and t.per_row:
        return F.coalesce(t.col == "", F.lit(False))
    return t.blank()


negated("non_empty", "empty")


def siblings(ctx: Context) -> list[str]:
    """X, X1, X2 ... in the order of their numbers."""
    base = re.sub(r"\d+$", "", ctx.name)
    found = {int(m[1] or 0): c for c in ctx.table.names if (m := re.fullmatch(re.escape(base) + r"(\d*)", c))}
    return [found[k] for k in sorted(found)]


@operator("inconsistent_enumerated_columns")
def inconsistent_enumerated_columns(ctx: Context) -> Column:
    """A blank followed by a filled sibling."""
    cols = siblings(ctx)
    out, gap = F.lit(False), F.lit(False)
    for c in cols:
        b = tx.blank(ctx.table.col(c), ctx.table.kind(c))
        out, gap = out | (gap & ~b), gap | b
    return out

