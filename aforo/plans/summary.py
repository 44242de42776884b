"""All period analyses from one scan.

Each analysis alone reads the whole table. ``summarize`` reads it once and keeps, for every
period, hour, day type and road type, the count, sum, sum of squared deviations, minimum and
maximum of each measure: a few hundred rows however many readings there are. These merge
exactly, so ``rollup`` derives any coarser statistic from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aforo.functions.values import round_half_even
from aforo.operators.stats import Stat, named_stats, spec_stats
from aforo.plans.analyses import CLOCK_STATS, HOUR_STATS, PERIOD_STATS, SPLIT_STATS, YEAR_WEEKEND_STATS, with_day_type

MEASURES = ("intensidad", "ocupacion", "carga")
GRAIN = ("periodo_num", "periodo", "hora", "tipo_día", "tipo_elem")


def moments(df: DataFrame, measures: Sequence[str], grain: Sequence[str]) -> DataFrame:
    """Rows, and count, sum, squared deviations, minimum and maximum of each measure, at the given grain."""
    columns: list[Column] = [F.count(F.lit(1)).alias("filas")]
    for m in measures:
        c = F.col(m)
        columns += [
            F.count(c).alias(f"{m}_n"),
            F.sum(c.cast("double")).alias(f"{m}_sum"),
            (F.var_pop(c) * F.count(c)).alias(f"{m}_m2"),
            F.min(c).alias(f"{m}_min"),
            F.max(c).alias(f"{m}_max"),
        ]
    return df.groupBy(*grain).agg(*columns)


def summarize(df: DataFrame, measures: Sequence[str] = MEASURES, grain: Sequence[str] = GRAIN) -> DataFrame:
    """Mergeable moments of each measure at the finest grain the analyses need."""
    return moments(with_day_type(df), measures, grain)


def rollup(
    summary: DataFrame,
    keys: Sequence[str],
    stats: Sequence[Stat],
    decimals: int | None = None,
) -> DataFrame:
    """Statistics by coarser keys. Squared deviations are moved to the common mean, which avoids cancellation."""
    group = Window.partitionBy(*keys)

    def mean_over_group(m: str) -> Column:
        return F.try_divide(F.sum(f"{m}_sum").over(group), F.sum(f"{m}_n").over(group))

    spread = dict.fromkeys(s.measure for s in stats if s.stat == "std")
    centred = summary.select("*", *(mean_over_group(m).alias(f"_{m}_mean") for m in spread))

    def column(s: Stat) -> Column:
        m = s.measure
        n = F.sum(f"{m}_n")
        if s.stat == "count":
            value = n
        elif s.stat == "mean":
            value = F.try_divide(F.sum(f"{m}_sum"), n)
        elif s.stat == "std":
            shift = F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n")) - F.col(f"_{m}_mean")
            squares = F.sum(F.col(f"{m}_m2") + F.col(f"{m}_n") * shift * shift)
            value = F.sqrt(F.try_divide(squares, n - 1))
        elif s.stat in ("min", "max"):
            value = (F.min if s.stat == "min" else F.max)(f"{m}_{s.stat}")
        else:
            raise ValueError(f"{s.stat} cannot be merged from a summary")
        return value.alias(s.name)

    result = centred.groupBy(*keys).agg(*(column(s) for s in stats))
    return round_half_even(result, decimals).orderBy(*keys)


def period_stats(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    return rollup(summary, ["periodo"], spec_stats(PERIOD_STATS), decimals)


def load_by_hour(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    return rollup(summary, ["periodo", "hora"], named_stats("carga", HOUR_STATS), decimals)


def day_type_split(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    return rollup(summary, ["periodo", "tipo_día"], spec_stats(SPLIT_STATS), decimals)


def road_type_split(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    return rollup(summary, ["periodo", "tipo_elem"], spec_stats(SPLIT_STATS), decimals)


def rows_per_period(summary: DataFrame) -> DataFrame:
    return summary.groupBy("periodo").agg(F.sum("filas").alias("count")).orderBy("periodo")


def intensity_by_hour(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    """From moments of the intensity by year, hour and weekend; rows without a date have no hour."""
    return rollup(summary.filter("hora IS NOT NULL"), ["hora"], named_stats("intensidad", CLOCK_STATS), decimals)


def intensity_year_weekend(summary: DataFrame, decimals: int | None = None) -> DataFrame:
    dated = summary.filter("`año` IS NOT NULL")
    return rollup(dated, ["año", "es_fin_semana"], named_stats("intensidad", YEAR_WEEKEND_STATS), decimals)
