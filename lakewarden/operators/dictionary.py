"""Operators that need a dictionary nobody supplied: they refuse, and say which. One looks up releases by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as dt
from ..model import RuleSkipped
from ..plans.asof import as_of
from ..plans.table import Context
from .registry import operator

_DICTIONARIES = {"meddra": "MedDRA", "whodrug": "WHODrug", "unii": "UNII", "loinc": "LOINC", "snomed": "SNOMED", "medrt": "MED-RT"}

#: Release dates of the MedDRA dictionary (fixed values).
MEDDRA_RELEASES = (
    ("23.1", "2020-09-01"), ("24.0", "2021-03-01"), ("24.1", "2021-09-01"), ("25.0", "2022-03-01"), ("25.1", "2022-09-01"), ("26.0", "2023-03-01"),
    ("26.1", "2023-09-01"), ("27.0", "2024-03-01"), ("27.1", "2024-09-01"), ("28.0", "2025-03-01"), ("28.1", "2025-09-01"), ("29.0", "2026-03-01"),
)


def _refuses(dictionary: str):
    def run(ctx: Context) -> Column:
        raise RuleSkipped(f"needs the {dictionary} dictionary")

    return run


for _key, _name in _DICTIONARIES.items():
    for _what in ("code", "term"):
        operator(f"is_valid_{_key}_{_what}_reference", f"is_not_valid_{_key}_{_what}_reference")(_refuses(_name))
operator("is_valid_whodrug_level_reference", "is_not_valid_whodrug_level_reference")(_refuses("WHODrug"))


def release_on(day: Column, releases: tuple = MEDDRA_RELEASES) -> Column:
    """The release in force on a day, of the few that are known here: the last one not later."""
    out = F.lit(None).cast("string")
    for version, since in releases:
        out = F.when(day >= F.lit(since), F.lit(version)).otherwise(out)
    return out


def _release_of_table(ctx: Context, day: Column, releases: DataFrame, dictionary: str) -> Column:
    """The same from a table of releases, by an as-of join of the days that occur."""
    own = releases.filter(F.lower("dictionary") == dictionary.lower()).select(F.col("since").alias("day"), "version")
    days = ctx.table.df.select(day.alias("day")).dropna().distinct()
    return ctx.table.join(as_of(days, own, [], "day", "version"), [(day, "day")], "version", "text")


def _latest(negative: bool):
    def run(ctx: Context) -> Column:
        if not ctx.exists:
            return F.lit(False)
        dictionary = str(ctx.condition.get("external_dictionary_type") or "")
        releases = ctx.table.study.library.releases
        if releases is None and dictionary.lower() != "meddra":
            raise RuleSkipped(f"no release dates are known for the {dictionary} dictionary")
        text = F.trim(F.coalesce(ctx.target.text(), F.lit("")))
        whole = text.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ][0-9:.]+$)")
        day = F.when(whole, F.left(text, F.lit(10)))
        # A date that cannot be read stops the rule if the row is otherwise selected.
        ctx.unresolved.append(f"{ctx.name} is not a full date")
        asked = ctx.condition.get("version")
        version = ctx.table.col(asked) if isinstance(asked, str) and ctx.table.has(asked) else F.lit(str(asked))
        if isinstance(asked, str) and asked.startswith("$"):
            bound = ctx.table.bindings.get(asked)
            if bound is None:
                raise RuleSkipped(f"cannot resolve {asked}")
            version = bound.text()
        in_force = release_on(day) if releases is None else _release_of_table(ctx, ctx.table.add(day), releases, dictionary)
        same = F.coalesce(version == in_force, F.lit(False))
        return F.when(whole, ~same if negative else same)

    return run


operator("is_latest_available_external_dictionary_version")(_latest(False))
operator("is_not_latest_available_external_dictionary_version")(_latest(True))
