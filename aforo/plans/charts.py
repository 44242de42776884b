"""The table behind each chart, from the result of its analysis; drawing is left to the caller.

The results may come from ``plans.analyses`` or, without another scan, from ``plans.summary``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aforo.functions.dates import WEEKEND_LABEL, WORKDAY_LABEL
from aforo.functions.values import lookup
from aforo.operators.reshape import categories, spread
from aforo.periods import PERIODS, Period

# The categories of the charts, with the names of their columns.
DAY_TYPES: dict[str, str] = {WEEKEND_LABEL: "fin_de_semana", WORKDAY_LABEL: "laborable"}
CHART_MEASURES = ("carga", "intensidad")


def period_means(stats: DataFrame, periods: Sequence[Period] = PERIODS) -> DataFrame:
    """The three means per period, in chronological order."""
    number = lookup(F.col("periodo"), {p.nombre: p.num for p in periods}).alias("periodo_num")
    return stats.select(number, "periodo", "intensidad_mean", "ocupacion_mean", "carga_mean").orderBy("periodo_num")


def load_curves(by_hour: DataFrame) -> DataFrame:
    """Mean load by hour, one line per period (long form)."""
    return by_hour.select("periodo", "hora", "mean")


def load_curves_wide(by_hour: DataFrame, periods: Sequence[Period] = PERIODS) -> DataFrame:
    """Mean load by hour, one column per period."""
    names = {p.nombre: f"periodo_{p.num}" for p in periods}
    return spread(by_hour.withColumnRenamed("mean", "carga"), "hora", "periodo", names, ["carga"])


def _bars(split: DataFrame, column: str, values: Mapping[str, str]) -> DataFrame:
    means = split.select("periodo", column, *(F.col(f"{m}_mean").alias(m) for m in CHART_MEASURES))
    return spread(means, "periodo", column, values, CHART_MEASURES)


def day_type_bars(split: DataFrame) -> DataFrame:
    """Mean load and intensity, period against day type."""
    return _bars(split, "tipo_día", DAY_TYPES)


def road_type_bars(split: DataFrame, values: Mapping[str, str] | None = None) -> DataFrame:
    """Mean load and intensity, period against road type: all that the table has, or the given ones.

    ``split`` is a result of a few rows; without ``values`` a job lists its road types.
    """
    return _bars(split, "tipo_elem", categories(split, "tipo_elem") if values is None else values)


def hour_error_bars(by_hour: DataFrame) -> DataFrame:
    """Mean intensity by hour with one standard deviation either side."""
    media, desv = F.col("media"), F.col("desv_est")
    return by_hour.select("hora", "media", "desv_est", (media - desv).alias("inferior"), (media + desv).alias("superior"))
