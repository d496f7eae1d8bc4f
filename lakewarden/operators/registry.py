"""The operator registry. ``@operator(name)`` is the engine's extension point: a function from Context to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RuleSkipped
from ..plans.table import Context

OPERATORS: dict[str, Callable[[Context], Column]] = {}
#: Operators that have an answer of their own where the dataset lacks the variable.
ANSWERS_MISSING = {
    "exists", "not_exists", "inconsistent_enumerated_columns", "is_unique_set", "is_not_unique_set", "is_unique_relationship",
    "is_not_unique_relationship", "is_inconsistent_across_dataset",
}


def operator(*names: str) -> Callable:
    def add(fn: Callable[[Context], Column]) -> Callable[[Context], Column]:
        for name in names:
            OPERATORS[name] = fn
        return fn

    return add


def negated(name: str, of: str) -> None:
    OPERATORS[name] = lambda ctx: ~OPERATORS[of](ctx)


def get(name: str) -> Callable[[Context], Column]:
    if name not in OPERATORS:
        raise RuleSkipped(f"Unimplemented operator: {name}")
    return OPERATORS[name]


def known(ctx: Context) -> bool:
    """Both sides are there; otherwise the answer is unknown."""
    return ctx.exists and ctx.value is not None




def unknown() -> Column:
    return F.lit(None).cast("boolean")
