"""Types of text columns, found from their cells.

A cell is the set of kinds it can be read as, written as bits; the kinds of a column are those that all its cells
share. That meet is associative and needs one number per column, so any number of columns and files
takes one aggregate, and files that disagree are settled by the same rule as cells that do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds, narrowest first.
KINDS = ("int", "bigint", "decimal(38,0)", "double", "boolean", "date")
TEXT = "string"
_BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}
_WHOLE = r"^[+-]?[0-9]+$"
_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def kinds_of(cell: Column) -> Column:
    """The kinds a cell can be read as, as bits; 0 for text that is nothing else, NULL for NULL and empty cells.

    A whole number is also every wider kind of number. ``NaN`` is a double. A day is a date, a time is text.
    """

    def bit(kind: str) -> Column:
        return F.when(cell.try_cast(kind).isNotNull(), _BIT[kind]).otherwise(0)

    whole = F.when(cell.rlike(_WHOLE), bit("int").bitwiseOR(bit("bigint")).bitwiseOR(bit("decimal(38,0)"))).otherwise(0)
    truth = F.when(F.lower(cell).isin("true", "false"), _BIT["boolean"]).otherwise(0)
    day = F.when(cell.rlike(_DAY), bit("date")).otherwise(0)
    return F.when(cell != "", whole.bitwiseOR(bit("double")).bitwiseOR(truth).bitwiseOR(day))


def settled(text: DataFrame) -> dict[str, str]:
    """The narrowest type that reads every cell, by column. One job, one pass over the text.

    A column of NULL and empty cells only, or of a table without rows, is text.
    """
    if not text.columns:
        return {}
    shared = text.agg(*(F.bit_and(kinds_of(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(text.columns))).first()
    return {c: next((k for k in KINDS if (bits or 0) & _BIT[k]), TEXT) for c, bits in zip(text.columns, shared, strict=True)}


def as_kinds(text: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The cells read by their column's type; empty cells of other types than text are NULL."""
    columns = [(c, F.col(f"`{c}`"), types.get(c, TEXT)) for c in text.columns]
    return text.select(*((cell if kind == TEXT else cell.try_cast(kind)).alias(c) for c, cell, kind in columns))
