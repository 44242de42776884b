"""Statistics by group, built from a specification of measures and statistic names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aforo.functions.values import round_half_even

STATISTICS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "median_approx": lambda c: F.percentile_approx(c, 0.5, 10_000),
}


class Stat(NamedTuple):
    """One output column: statistic ``stat`` of ``measure``, called ``name``."""

    name: str
    measure: str
    stat: str

    def column(self) -> Column:
        return STATISTICS[self.stat](F.col(f"`{self.measure}`")).alias(self.name)


def spec_stats(spec: Mapping[str, Sequence[str]]) -> list[Stat]:
    """``{measure: [statistic, ...]}`` to flat columns called ``<measure>_<statistic>``."""
    return [Stat(f"{m}_{s}", m, s) for m, names in spec.items() for s in names]


def named_stats(measure: str, pairs: Sequence[tuple[str, str]]) -> list[Stat]:
    """``[(output name, statistic), ...]`` of one measure."""
    return [Stat(name, measure, stat) for name, stat in pairs]


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: Sequence[Stat],
    decimals: int | None = None,
    sort: bool = True,
) -> DataFrame:
    """Statistics by ``keys``, sorted by them.

    One hash aggregate with partial results in each input task, so what is shuffled is groups,
    not readings, and a group holding most of the rows costs no more than the others. The exact
    median cannot be merged that way and is computed by ``operators.median`` in a second pass.
    """
    if any(s.stat == "median" for s in stats):
        from aforo.operators.median import group_stats_with_median

        result = group_stats_with_median(df, keys, stats)
    else:
        result = df.groupBy(*keys).agg(*(s.column() for s in stats))
    result = round_half_even(result, decimals)
    return result.orderBy(*keys) if sort else result
