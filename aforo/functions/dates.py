"""Date text to zone-free timestamps, and the calendar columns derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels and column names of the result tables.
WEEKEND_LABEL = "Fin de semana"
WORKDAY_LABEL = "Laborable"
CALENDAR_COLUMNS = ("año", "mes", "día", "hora", "día_semana", "es_fin_semana")

ISO_SHAPE = "____-__-__ __:__:__"
DAYFIRST_SHAPE = "__/__/____ __:__:__"


def parse_iso(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to ``timestamp_ntz``; anything else, 31 February too, is NULL.

    The cast alone also takes bare dates and zone suffixes, hence the shape test. LIKE with a
    cast is faster than a pattern-based parse and never looks at the session zone.
    """
    return F.when(text.like(ISO_SHAPE), text.try_cast("timestamp_ntz"))


def parse_dayfirst(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` to ``timestamp_ntz``; anything else is NULL."""
    iso = F.concat(
        F.substring(text, 7, 4),
        F.lit("-"),
        F.substring(text, 4, 2),
        F.lit("-"),
        F.substring(text, 1, 2),
        F.substring(text, 11, 9),
    )
    return F.when(text.like(DAYFIRST_SHAPE), iso.try_cast("timestamp_ntz"))


def parse_either(text: Column) -> Column:
    return F.coalesce(parse_iso(text), parse_dayfirst(text))


DATE_PARSERS = {"iso": parse_iso, "dayfirst": parse_dayfirst, "either": parse_either}


def is_weekend(ts: Column, rule: str = "sat_sun") -> Column:
    """``sat_sun`` is the plain meaning; ``fri_sat`` reproduces a Sunday-first count read as Monday-first.

    A reading without a date is on no weekend.
    """
    if rule == "sat_sun":
        return F.coalesce(F.weekday(ts).isin(5, 6), F.lit(False))
    if rule == "fri_sat":
        return F.coalesce(F.dayofweek(ts).isin(6, 7), F.lit(False))
    raise ValueError(f"unknown weekend rule {rule!r}")


def weekday_number(ts: Column, base: str = "sunday1") -> Column:
    """Day of week as Sunday = 1 .. Saturday = 7 (``sunday1``) or Monday = 0 .. Sunday = 6 (``monday0``)."""
    if base == "sunday1":
        return F.dayofweek(ts)
    if base == "monday0":
        return F.weekday(ts)
    raise ValueError(f"unknown weekday base {base!r}")


def day_type(weekend: Column) -> Column:
    return F.when(weekend, WEEKEND_LABEL).otherwise(WORKDAY_LABEL)


def calendar(ts: Column, weekend: str = "sat_sun", weekday: str = "sunday1") -> list[Column]:
    """Year, month, day, hour, day of week and weekend flag, named as in the result tables."""
    exprs = (
        F.year(ts),
        F.month(ts),
        F.dayofmonth(ts),
        F.hour(ts),
        weekday_number(ts, weekday),
        is_weekend(ts, weekend),
    )
    return [e.alias(name) for e, name in zip(exprs, CALENDAR_COLUMNS)]
