"""Assign readings to periods by date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.operators.clean import TS
from aforo.periods import PERIODS, Period

PERIOD_ENDS = ("instant", "day")
#: Segments up to which the lookup side is broadcast.
BROADCAST_ENTRIES = 100_000
# Days by which dates are moved, so that all are counted from zero on; and the binary levels of their positions.
FIRST_DAY = 1 << 31
LEVELS = 33


def _check(period_end: str) -> None:
    if period_end not in PERIOD_ENDS:
        raise ValueError(f"period_end must be one of {PERIOD_ENDS}, not {period_end!r}")


def _midnight(day: dt.date) -> Column:
    return F.expr(f"timestamp_ntz'{day.isoformat()}'")


def in_period(ts: Column, period: Period, period_end: str = "instant") -> Column:
    """Whether ``ts`` lies in the period.

    ``instant`` closes the period at the first instant of its last day, ``day`` takes that whole day.
    """
    _check(period_end)
    if period_end == "instant":
        return ts.between(_midnight(period.inicio), _midnight(period.fin))
    return (ts >= _midnight(period.inicio)) & (ts < _midnight(period.fin + dt.timedelta(days=1)))


def _first_match(cases: Sequence[tuple[Column, object]]) -> Column:
    head, *rest = cases
    return reduce(lambda chosen, case: chosen.when(*case), rest, F.when(*head))


def in_any_period(ts: Column, periods: Sequence[Period], period_end: str = "instant") -> Column:
    """The same test over all periods: plain comparisons, so it reaches the Parquet scan."""
    return reduce(or_, (in_period(ts, p, period_end) for p in periods))


def period_number(ts: Column, periods: Sequence[Period] = PERIODS, period_end: str = "instant") -> Column:
    """Number of the first period that holds ``ts``, NULL outside all of them."""
    return _first_match([(in_period(ts, p, period_end), p.num) for p in periods])


def period_name(ts: Column, periods: Sequence[Period] = PERIODS, period_end: str = "instant") -> Column:
    return _first_match([(in_period(ts, p, period_end), p.nombre) for p in periods])


def classify(
    df: DataFrame,
    periods: Sequence[Period] = PERIODS,
    period_end: str = "instant",
    keep_unclassified: bool = False,
    only: Sequence[int] | None = None,
    ts: str = TS,
) -> DataFrame:
    """Add ``periodo_num`` and ``periodo``, replacing labels set by folder.

    ``only`` keeps the periods with these numbers, and has the scan read no more than their dates.

    Rows outside all periods are dropped through a range predicate, not through a test on the
    derived label, because only the former is pushed to the scan. Number and name are two
    independent expressions over ``ts``: whichever is not used is pruned.
    """
    if not periods:
        raise ValueError("at least one period is needed")
    inside = {p.num: in_period(F.col(ts), p, period_end) for p in periods}
    number = _first_match([(inside[p.num], p.num) for p in periods])
    name = _first_match([(inside[p.num], p.nombre) for p in periods])
    rows = df
    if only is not None:
        rows = rows.filter(reduce(or_, (inside[n] for n in only))).filter(number.isin(*only))
    elif not keep_unclassified:
        rows = rows.filter(reduce(or_, inside.values()))
    return rows.withColumns({"periodo_num": number, "periodo": name})


def _position(day: Column) -> Column:
    """Two positions a day: an even one for its first instant, and after it one for the rest."""
    return (F.unix_date(day).cast("long") + FIRST_DAY) * 2


def _resolved(sound: DataFrame, period_end: str, unfolded: int) -> DataFrame:
    """``_position`` and ``_period``, the lowest period there, for every position that a period holds.

    Bounds are dates, so positions are the finest segments that all bounds together can cut, and disjoint. Where
    unfolding every period by itself would make more rows than can be broadcast, a period is first taken as its few
    binary blocks of positions; equal blocks of all periods become one, and only these are unfolded. So what is
    made is bounded by the calendar, not by how many periods overlap.
    """
    first, last = _position(F.col("inicio")), _position(F.col("fin"))
    end = last + (1 if period_end == "instant" else 2)
    spans = sound.select(first.alias("_first"), end.alias("_end"), F.struct("num", "nombre").alias("_period"))
    if unfolded > BROADCAST_ENTRIES:
        # By level: the block that begins or ends the span, unless a block of the next level holds it.
        blocks = f"""transform(sequence(0, {LEVELS}), k -> named_struct(
            'level', k, 'low', shiftright(_first + shiftleft(1L, k) - 1, k), 'high', shiftright(_end, k)))"""
        edges = f"""flatten(transform(filter({blocks}, b -> b.low < b.high), b -> array_compact(array(
            if(b.low % 2 = 1, named_struct('level', b.level, 'at', b.low), null),
            if(b.high % 2 = 1, named_struct('level', b.level, 'at', b.high - 1), null)))))"""
        spans = spans.select("_period", F.inline(F.expr(edges))).groupBy("level", "at").agg(F.min("_period").alias("_period"))
        spans = spans.select(F.expr("shiftleft(at, level)").alias("_first"), F.expr("shiftleft(at + 1, level)").alias("_end"), "_period")
    each = spans.select("_period", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("_position"))
    return each.groupBy("_position").agg(F.min("_period").alias("_period"))


def classify_by_table(
    df: DataFrame,
    table: DataFrame,
    period_end: str = "instant",
    broadcast: bool | None = None,
    ts: str = TS,
) -> DataFrame:
    """Left lookup of each reading in a period table given as data (``num, nombre, inicio, fin``).

    The periods are cut into disjoint segments, a day's first instant or the rest of it, for each of which the lowest
    number that holds it is found once, however many overlap. A reading then meets one row by an equality: no range
    join, no list of periods, no test of one after another. A period that ends before it begins, or lacks a bound, holds
    nothing. Dates of any year may occur. Unless ``broadcast`` says, the segments are broadcast where the bounds show
    that there are at most ``BROADCAST_ENTRIES``, so that readings are not shuffled; beyond that Spark decides.
    """
    _check(period_end)
    for name in ("inicio", "fin"):
        if not isinstance(table.schema[name].dataType, T.DateType):
            raise TypeError(f"period column {name} must be a date")
    sound = table.filter(F.col("inicio") <= F.col("fin"))
    extent = sound.agg(
        F.coalesce(F.sum(F.datediff("fin", "inicio") + 1), F.lit(0)).alias("days"),
        F.coalesce(F.datediff(F.max("fin"), F.min("inicio")) + 1, F.lit(0)).alias("calendar"),
    ).first()
    if broadcast is None:
        broadcast = 2 * min(extent.days, extent.calendar) <= BROADCAST_ENTRIES
    segments = _resolved(sound, period_end, 2 * extent.days)

    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("periodo_num", "periodo")]
    day = F.col(ts).cast("date")
    later = (F.col(ts) != day.cast("timestamp_ntz")).cast("long")
    joined = df.select(*kept, (_position(day) + later).alias("_position")).join(F.broadcast(segments) if broadcast else segments, "_position", "left")
    return joined.select(*kept, F.col("_period.num").alias("periodo_num"), F.col("_period.nombre").alias("periodo"))
