"""Cleaning: parse the date, derive the calendar columns, settle missing and invalid values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aforo.functions.dates import CALENDAR_COLUMNS, DATE_PARSERS, calendar
from aforo.functions.values import is_floating, nan_to_null, within

TS = "fecha_ts"


def timestamp_of(df: DataFrame, fecha: str = "fecha", date_format: str = "iso") -> Column:
    """The reading's wall-clock time; text goes through the parser, date types are cast."""
    data_type = df.schema[fecha].dataType
    column = F.col(f"`{fecha}`")
    if isinstance(data_type, T.StringType):
        return DATE_PARSERS[date_format](column)
    if isinstance(data_type, T.TimestampNTZType):
        return column
    return column.cast("timestamp_ntz")


def clean(
    df: DataFrame,
    fecha: str = "fecha",
    date_format: str = "iso",
    weekend: str = "sat_sun",
    weekday: str = "sunday1",
    nan: str = "skip",
    ranges: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Add ``fecha_ts`` and the calendar columns. No row is dropped.

    ``nan="skip"`` turns NaN into NULL so that aggregates pass over it, ``"propagate"`` keeps it.
    ``ranges`` maps a column to its valid closed range; values outside become NULL.

    A date column is passed on as it is, so that predicates on ``fecha_ts`` reach the scan. A text
    date is parsed in a one-row ``inline``: predicates stay above it, where each would otherwise
    be rewritten to parse the text again, once per period bound.
    """
    if nan not in ("skip", "propagate"):
        raise ValueError(f"unknown NaN policy {nan!r}")
    ranges = ranges or {}
    derived = {TS, *CALENDAR_COLUMNS}

    def value(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if nan == "skip" and is_floating(field.dataType):
            column = nan_to_null(column)
        if field.name in ranges:
            column = within(column, *ranges[field.name])
        return column.alias(field.name)

    kept = [value(f) for f in df.schema.fields if f.name not in derived]
    stamp = timestamp_of(df, fecha, date_format).alias(TS)
    if isinstance(df.schema[fecha].dataType, T.StringType):
        stamp = F.inline(F.array(F.struct(stamp)))
    return df.select(*kept, stamp).select("*", *calendar(F.col(TS), weekend, weekday))
