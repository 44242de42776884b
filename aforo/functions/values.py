"""Value-level rules: text to numbers, missing values, valid ranges, rounding, dictionary lookup."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")


def number_from_text(text: Column, type_name: str) -> Column:
    """Text to a number without raising. Integers also accept ``12.0``, but ``12.7`` becomes NULL.

    Text that does not fit is counted by ``operators.profile.cast_losses``.
    """
    if type_name not in INTEGER_TYPES:
        return text.try_cast(type_name)
    wide = text.try_cast("double")
    return F.coalesce(
        text.try_cast(type_name),
        F.when(wide == F.floor(wide), wide.try_cast(type_name)),
    )


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """True where the value is NULL or NaN."""
    column = F.col(f"`{name}`")
    if is_floating(df.schema[name].dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def within(column: Column, low: float, high: float) -> Column:
    """The value, or NULL outside the closed range ``[low, high]``."""
    return F.when(column.between(low, high), column)


def round_half_even(df: DataFrame, decimals: int | None) -> DataFrame:
    """Round every floating column half-to-even; ``None`` leaves the table as it is."""
    if decimals is None:
        return df
    return df.select(
        *(
            F.bround(F.col(f"`{f.name}`"), decimals).alias(f.name) if is_floating(f.dataType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def lookup(key: Column, mapping: Mapping) -> Column:
    """Value of ``key`` in a small dictionary, NULL where absent."""
    entries = F.create_map(*(F.lit(x) for x in chain.from_iterable(mapping.items())))
    return F.try_element_at(entries, key)
