"""Partial ISO 8601 dates and durations as Columns.

Whole dates, and dates with a time to the second, are cut at fixed places. For all
other values one anchored pattern is run once per value: it rewrites a match into its
fields, set apart by U+001F, and leaves anything else as it is.

1.0 rules look at the outline of a value: its text with each digit written as 9.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of the date grammar (fixed values): fields of a date, a time and a zone; "-" stands for a part left open.
_YEAR, _MONTH, _DAY = r"(-?[0-9]{4}|-)", r"(1[0-2]|0[1-9]|-)", r"(3[01]|0[1-9]|[12][0-9]|-)"
_HOUR, _SIXTY, _ZONE = r"(2[0-3]|[01][0-9]|-)", r"([0-5][0-9]|-)", r"(Z|[+-](?:2[0-3]|[01][0-9]):[0-5][0-9])?"
_TIME = rf"T{_HOUR}(?::{_SIXTY}(?::{_SIXTY}?(?:\.([0-9]+))?)?)?{_ZONE}"
_MOMENT = rf"{_YEAR}(?:-{{1,2}}{_MONTH})?(?:-{{1,2}}{_DAY})?(?:{_TIME})?"
_PATTERN = rf"^(?:{_MOMENT}(?:/{_MOMENT})?|-{{4,8}}{_TIME})$"
_FIELDS = 8 + 8 + 5
_REWRITE = "\x1f".join(f"${i}" for i in range(1, _FIELDS + 1)) + "\x1e"

#: ISO 8601 durations (fixed format): parts may be set apart by commas, at least one is given, weeks stand alone.
_N = r"\d+(?:[.,]\d*)?"
DURATION = rf"P(?!$)(?:(?:{_N}Y)?,?(?:{_N}M)?,?(?:{_N}D)?,?(?:T(?=\d)(?:{_N}H)?,?(?:{_N}M)?,?(?:{_N}S)?)?|{_N}W)$"
#: Outlines that 1.0 rules know (fixed formats): a whole date with an optional clock; any date a comparison takes.
WHOLE_OUTLINE = r"^9999-99-99(T99:99(:99)?(\.9+)?([+-]99:?99|Z)?)?$"
DATE_OUTLINE = r"^9999(-99(-99([T ]99(:99(:99(\.9+)?)?)?(Z|[+-]99:?99)?)?)?)?$"
#: A date of which 1.0 rules take the latest or earliest (fixed format): parts may be open, the zone follows the time.
_CORE1_DATE = rf"^(?!0000)([0-9]{{4}}|-)(-{_MONTH}(-{_DAY}(T{_HOUR}(:{_SIXTY}(:([0-5][0-9](\.[0-9]+)?|-))?)?(Z|[+-](2[0-3]|[01][0-9])(:?[0-5][0-9])?)?)?)?)?$"

PRECISIONS = ("year", "month", "day", "hour", "minute", "second", "microsecond")


_EPOCH, _DAY_US = "DATE'1970-01-01'", 86_400_000_000
#: Writes expressions out as columns and gives their names.
Add = Callable[..., list[str]]


@dataclass
class DateParts:
    """Names of columns derived from one text column.

    What follows from a written column is put as SQL text: it is parsed in one step, where a tree of
    Columns is built call by call, which for dates took longer than reading them.
    """

    text: str
    valid: str
    #: Place in ``PRECISIONS`` of the last part before the first open one; -1 without a year.
    precision: str
    #: Microseconds since 1970 in UTC; open parts are those of 1970-01-01T00:00:00.
    micros: str

    def instant(self, precision: str) -> Column:
        """The moment cut to a precision, in microseconds."""
        m = self.micros

        def cut(us: int) -> str:
            return f"{m} - pmod({m}, {us})"

        def first(unit: str) -> str:
            day = f"date_add({_EPOCH}, CAST(({cut(_DAY_US)}) div {_DAY_US} AS INT))"
            return f"CAST(datediff(trunc({day}, '{unit}'), {_EPOCH}) AS BIGINT) * {_DAY_US}"

        cuts = {6: m, 5: cut(1_000_000), 4: cut(60_000_000), 3: cut(3_600_000_000), 2: cut(_DAY_US), 1: first("MM"), 0: first("YEAR")}
        return F.expr(f"CASE {precision} {' '.join(f'WHEN {k} THEN {v}' for k, v in cuts.items())} END")


def date_fields(text: Column) -> Column:
    """The fields of the pattern as an array; NULL where the text is no date."""
    out = F.regexp_replace(text, _PATTERN, _REWRITE)
    return F.when(F.endswith(out, F.lit("\x1e")), F.split(F.substring(out, F.lit(1), F.length(out) - 1), "\x1f"))


def _open(x: str) -> str:
    return f"({x} = '' OR {x} = '-')"


def _day_number(year: str, month: str, day: str) -> str:
    """Days since 1970-01-01, counted in years that begin in March, so that the leap day comes last."""
    y = f"({year} - IF({month} <= 2, 1, 0))"
    in_year = f"((153 * pmod({month} + 9, 12) + 2) div 5 + {day} - 1)"
    return f"CAST({y} * 365 + floor({y} / 4) - floor({y} / 100) + floor({y} / 400) + {in_year} - 719468 AS BIGINT)"


def date_parts(text: Column, add: Add) -> DateParts:
    """``add`` writes expressions out as columns, so that what follows reads them and does not repeat them."""
    (t,) = add(F.coalesce(text, F.lit("")))
    # Most values are whole dates, cut at fixed places; the fields are sought in the others.
    dated = f"length({t}) IN (10, 19) AND substring({t}, 5, 1) = '-' AND substring({t}, 8, 1) = '-' AND right({t}, 1) BETWEEN '0' AND '9'"
    timed = f"substring({t}, 11, 9) RLIKE '^T(2[0-3]|[01][0-9]):[0-5][0-9]:[0-5][0-9]$'"
    date = f"CASE WHEN {dated} AND (length({t}) = 10 OR {timed}) THEN try_cast(left({t}, 10) AS DATE) END"
    (day,) = add(F.expr(f"CASE WHEN year({date}) >= 1 THEN datediff({date}, {_EPOCH}) END"))
    plain = f"{day} IS NOT NULL"
    hour, minute, second = (f"try_cast(substring({t}, {at}, 2) AS INT)" for at in (12, 15, 18))
    seconds = f"IF(length({t}) = 19, {hour} * 3600 + {minute} * 60 + {second}, 0)"
    (fields,) = add(F.when(F.col(day).isNull(), date_fields(F.col(t))))
    # The later date of an interval, or a time alone, counts only if the first date is wholly open.
    own, time_alone = f"slice({fields}, 1, 8)", f"concat(array('', '', ''), slice({fields}, 17, 5))"
    later = f"zip_with(slice({fields}, 9, 8), {time_alone}, (a, b) -> IF({_open('a')}, b, a))"
    (parts,) = add(F.expr(f"CASE WHEN {fields} IS NULL THEN NULL WHEN exists({own}, x -> NOT {_open('x')}) THEN {own} ELSE {later} END"))

    def given(i: int) -> str:
        # Casts that fail are slow, so open parts are kept from them; the others are digits by the pattern.
        x = f"get({parts}, {i})"
        return f"try_cast(CASE WHEN NOT {_open(x)} THEN {x} END AS INT)"

    def part(i: int, default: int) -> str:
        return f"coalesce({given(i)}, {default})"

    first_open = f"array_position(transform(slice({parts}, 1, 7), x -> {_open('x')}), true)"
    precision = f"CASE WHEN {plain} THEN IF(length({t}) = 19, 5, 2) WHEN {first_open} = 0 THEN 6 ELSE CAST({first_open} AS INT) - 2 END"
    clock = f"({part(3, 0)} * 3600 + {part(4, 0)} * 60 + {part(5, 0)})"
    fraction = f"coalesce(try_cast(rpad(substring(get({parts}, 6), 1, 6), 6, '0') AS INT), 0)"
    zone = f"get({parts}, 7)"
    ahead = f"IF(startswith({zone}, '-'), 1, -1) * (try_cast(substring({zone}, 2, 2) AS INT) * 60 + try_cast(substring({zone}, 5, 2) AS INT))"
    shift = f"CASE WHEN NOT {_open(f'get({parts}, 3)')} AND {zone} <> '' AND {zone} <> 'Z' THEN {ahead} ELSE 0 END"
    found = f"({_day_number(part(0, 1970), part(1, 1), part(2, 1))} * 86400 + {clock} + {shift} * 60) * 1000000 + {fraction}"
    micros = f"CASE WHEN {plain} THEN CAST({day} AS BIGINT) * {_DAY_US} + CAST({seconds} AS BIGINT) * 1000000 WHEN {fields} IS NOT NULL THEN {found} END"
    # Without a mark of uncertainty: a year from 1 on, no day without a month, a real day, and no open time.
    year, month, monthday = (given(i) for i in range(3))
    leap = f"(({year} % 4 = 0 AND {year} % 100 <> 0) OR {year} % 400 = 0)"
    days = f"CASE WHEN {month} = 2 THEN IF({leap}, 29, 28) WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    real = f"coalesce({monthday} <= {days}, true) AND NOT ({monthday} IS NOT NULL AND {month} IS NULL)"
    strict = f"coalesce({year} >= 1, false) AND NOT startswith({t}, '-') AND {real} AND NOT {t} RLIKE 'T-|:-'"
    uncertain = " OR ".join(f"contains({t}, '{mark}')" for mark in ("/", "--", "-:"))
    valid = f"{plain} OR ({fields} IS NOT NULL AND ({uncertain} OR ({strict})))"
    return DateParts(t, *add(F.expr(valid), F.expr(precision), F.expr(micros)))


def valid_duration(text: Column, negative: bool = True, core1: bool = False) -> Column:
    """One decimal part at most, and that the last one given; for 1.0 rules one separator of any kind at most."""
    text = F.coalesce(text, F.lit(""))
    shape = text.rlike(("^-?" if negative else "^") + DURATION)
    if core1:
        return shape & (F.regexp_count(text, F.lit("[.,]")) <= 1)
    decimals = F.regexp_count(text, F.lit(r"\d[.,]\d*[A-Z]"))
    last = text.rlike(r"\d[.,]\d*[A-Z]$")
    return shape & ((decimals == 0) | ((decimals == 1) & last))


def outline(text: Column) -> Column:
    """The text with each digit written as 9."""
    return F.translate(text, "0123456789", "9999999999")


def _real_day(text: Column) -> Column:
    """Whether the first ten characters are a day of the calendar."""
    return F.left(text, F.lit(10)).try_cast("date").isNotNull()


def valid_date_core1(text: Column) -> Column:
    """By outline: years and months, alone, before a mark of what is left out or as a range of months, ranges of days, and whole dates."""
    x = F.coalesce(text, F.lit(""))
    form = outline(x)
    unsigned = F.when(F.startswith(form, F.lit("-")), F.substring(form, F.lit(2), F.length(form))).otherwise(form)
    month = F.right(x, F.lit(2)).between("01", "12")
    clock = ~F.substring(x, 12, 2).between("24", "99") & ~x.rlike(":[6-9]")
    return ~F.contains(x, F.lit("-:")) & (
        F.when(unsigned.isin("9999", "9999--", "9999-99--"), True)
        .when(unsigned == "9999-99", month)
        .when((form == "9999-99/9999-99") | F.startswith(form, F.lit("9999-99-99/9999-99-99")), True)
        .when(form.rlike(WHOLE_OUTLINE), _real_day(x) & clock)
        .otherwise(False)
    )


def known_date_core1(text: Column) -> Column:
    """What a date gives up to its first open part, a space before the time read as T; NULL if it gives none or no real day."""
    value = F.translate(F.regexp_replace(text, r"\s+$", ""), " ", "T")
    known = F.regexp_replace(value, "(^-|--|T-|:-).*$", "")
    return F.when(value.rlike(_CORE1_DATE) & (known != "") & ((F.length(known) < 10) | _real_day(known)), known)
