"""Long to wide: one output column per category and measure."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.functions.values import lookup

#: Alias of the NULL category.
NULL_ALIAS = "nulo"
_REST = object()


def wide(
    df: DataFrame,
    index: str,
    columns: str,
    values: Mapping[str, str],
    cells: Sequence[tuple[str, Column]],
    rest: str | None = None,
) -> DataFrame:
    """Pivot ``columns`` against ``index``; cell columns are called ``<cell>_<alias>``.

    ``values`` maps each category, among them None for NULL, to its alias. They are given, not looked up: that
    saves a job, and the result has the same columns whatever the data holds. No row is lost: those of all other
    categories together make one more column per cell, ``<cell>_<rest>``, or without ``rest`` an error that
    names one of them (``categories`` finds them all).
    """
    category = F.col(f"`{columns}`")
    place = {value: f"c{i}" for i, value in enumerate(values)}
    number = lookup(category, {v: p for v, p in place.items() if v is not None})
    if None in place:
        number = F.when(category.isNull(), F.lit(place[None])).otherwise(number)
    if rest is None:
        named = F.coalesce(category.cast("string"), F.lit("NULL"))
        other = F.raise_error(F.concat(F.lit(f"{columns} has a category without a column: "), named)).cast("string")
    else:
        if rest in values.values():
            raise ValueError(f"{rest} already names a category")
        other = F.lit("rest")
        values, place = {**values, _REST: rest}, {**place, _REST: "rest"}
    placed = df.withColumn("_category", F.coalesce(number, other))
    pivoted = placed.groupBy(index).pivot("_category", list(place.values())).agg(*(c.alias(name) for name, c in cells))
    # A single aggregate is named after the category alone, several get a suffix.
    source = (lambda value, cell: place[value]) if len(cells) == 1 else (lambda value, cell: f"{place[value]}_{cell}")
    return pivoted.select(
        index,
        *(F.col(f"`{source(value, cell)}`").alias(f"{cell}_{alias}") for cell, _ in cells for value, alias in values.items()),
    ).orderBy(index)


def spread(df: DataFrame, index: str, columns: str, values: Mapping[str, str], measures: Sequence[str]) -> DataFrame:
    """Reshape a table that already has one row per index and category; one that is not listed is an error.

    Any aggregate takes that row's value; ``max`` lets Catalyst drop a sort of the input.
    """
    return wide(df, index, columns, values, [(m, F.max(m)) for m in measures])


def mean_matrix(
    df: DataFrame, index: str, columns: str, values: Mapping[str, str], measures: Sequence[str], rest: str | None = None
) -> DataFrame:
    """Group, average and reshape straight from readings; with ``rest``, one more column for the categories not listed."""
    return wide(df, index, columns, values, [(m, F.avg(m)) for m in measures], rest)


def categories(df: DataFrame, column: str) -> dict[str | None, str]:
    """The categories present, NULL among them, as a ``values`` mapping with distinct aliases.

    Runs a job on the distinct values, so it is meant for aggregated tables, not for readings.
    Spark's own limit on pivot columns holds here too: more categories are an error.
    """
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} categories")
    aliases: dict[str | None, str] = {}
    for (value,) in found:
        alias = name = NULL_ALIAS if value is None else re.sub(r"\s+", "_", str(value).strip().lower())
        n = 1
        while alias in aliases.values():
            n += 1
            alias = f"{name}_{n}"
        aliases[value] = alias
    return aliases
