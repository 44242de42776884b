"""Writers for result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.functions.values import is_floating, nan_to_null, round_half_even


def write_csv(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = (),
    decimals: int | None = None,
    sep: str = ",",
    mode: str = "overwrite",
) -> None:
    """Flat CSV with a header, in key order; NULL and NaN are empty cells.

    No coalesce: AQE brings a small result into one part file by itself, and a large table is
    written by many tasks as ordered part files.
    """
    table = round_half_even(df, decimals)
    table = table.select(
        *(nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if is_floating(f.dataType) else f"`{f.name}`" for f in table.schema.fields)
    )
    if keys:
        table = table.orderBy(*keys)
    table.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
