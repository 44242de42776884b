"""The analyses: statistics of the three measures by period, hour, day type, road type and year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.functions.dates import day_type
from aforo.operators.clean import TS
from aforo.operators.stats import Stat, group_stats, named_stats, spec_stats

# The statistics of each analysis, in the order of its result columns.
PERIOD_STATS: dict[str, list[str]] = {
    "intensidad": ["mean", "std", "max", "min"],
    "ocupacion": ["mean", "std", "max"],
    "carga": ["mean", "std", "max"],
}
SPLIT_STATS: dict[str, list[str]] = {
    "carga": ["mean", "std"],
    "intensidad": ["mean", "std"],
    "ocupacion": ["mean", "std"],
}
HOUR_STATS: list[tuple[str, str]] = [("mean", "mean"), ("std", "std")]
YEAR_STATS: list[tuple[str, str]] = [
    ("media", "mean"),
    ("mediana", "median"),
    ("máximo", "max"),
    ("mínimo", "min"),
    ("desv_est", "std"),
    ("contador", "count"),
]
CLOCK_STATS: list[tuple[str, str]] = [("media", "mean"), ("desv_est", "std")]
YEAR_WEEKEND_STATS: list[tuple[str, str]] = [("media", "mean"), ("desv_est", "std"), ("n_registros", "count")]


def with_day_type(df: DataFrame) -> DataFrame:
    """Add ``tipo_día`` from the weekend flag."""
    return df.withColumn("tipo_día", day_type(F.col("es_fin_semana")))


def _dated(df: DataFrame) -> DataFrame:
    """Rows whose date could be read; a reading without a date belongs to no year or hour."""
    return df.filter(F.col(TS).isNotNull())


def period_stats(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Intensity, occupancy and load by period."""
    return group_stats(df, ["periodo"], spec_stats(PERIOD_STATS), decimals)


def load_by_hour(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Load by period and hour of day."""
    return group_stats(df, ["periodo", "hora"], named_stats("carga", HOUR_STATS), decimals)


def day_type_split(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """The three measures on working days against weekends, by period."""
    return group_stats(with_day_type(df), ["periodo", "tipo_día"], spec_stats(SPLIT_STATS), decimals)


def road_type_split(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """The three measures by period and road type."""
    return group_stats(df, ["periodo", "tipo_elem"], spec_stats(SPLIT_STATS), decimals)


def rows_per_period(df: DataFrame) -> DataFrame:
    return df.groupBy("periodo").count().orderBy("periodo")


def distinct_periods(df: DataFrame) -> DataFrame:
    return df.select("periodo").distinct()


def hour_profile(df: DataFrame, periodo: str, decimals: int | None = None) -> DataFrame:
    """The load curve of one period, by hour. ``classify(..., only=[n])`` keeps the scan to that period."""
    return load_by_hour(df.filter(F.col("periodo") == periodo), decimals)


def intensity_by_year(df: DataFrame, decimals: int | None = None, approx: bool = False) -> DataFrame:
    """Intensity by year, with the exact median (two passes) or an approximate one (one pass)."""
    pairs = [(name, "median_approx" if approx and stat == "median" else stat) for name, stat in YEAR_STATS]
    return group_stats(_dated(df), ["año"], named_stats("intensidad", pairs), decimals)


def intensity_by_hour(df: DataFrame, decimals: int | None = None) -> DataFrame:
    return group_stats(_dated(df), ["hora"], named_stats("intensidad", CLOCK_STATS), decimals)


def intensity_year_weekend(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """Intensity by year, weekends against other days."""
    stats = named_stats("intensidad", YEAR_WEEKEND_STATS)
    return group_stats(_dated(df), ["año", "es_fin_semana"], stats, decimals)


def measure_stats(df: DataFrame, keys: Sequence[str], spec: dict[str, list[str]], decimals: int | None = None) -> DataFrame:
    """Any statistics of any measures by any keys, from ``{measure: [statistic, ...]}``."""
    stats: list[Stat] = spec_stats(spec)
    return group_stats(df, keys, stats, decimals)
