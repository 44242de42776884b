"""The period table: which named stretch of days a reading belongs to."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Period:
    num: int
    nombre: str
    inicio: dt.date
    fin: dt.date
    carpeta: str | None = None

    def __post_init__(self) -> None:
        if self.fin < self.inicio:
            raise ValueError(f"period {self.num} ends before it starts")


# The four periods, their bounds and the folders their files lie in.
PERIODS: tuple[Period, ...] = (
    Period(1, "Pre-pandemia", dt.date(2019, 1, 1), dt.date(2020, 1, 31), "periodo_1_PrePandemia"),
    Period(2, "Primeros casos", dt.date(2020, 2, 1), dt.date(2020, 3, 15), "periodo_2_PrimerosCasos"),
    Period(3, "Confinamiento estricto", dt.date(2020, 3, 16), dt.date(2020, 5, 2), "periodo_3_Confinamiento"),
    Period(4, "Nueva normalidad", dt.date(2020, 5, 3), dt.date(2020, 12, 31), "periodo_4_NuevaNormalidad"),
)

PERIOD_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("num", T.IntegerType(), False),
        T.StructField("nombre", T.StringType(), False),
        T.StructField("inicio", T.DateType(), False),
        T.StructField("fin", T.DateType(), False),
    ]
)


def period_table(spark: SparkSession, periods: Iterable[Period] = PERIODS) -> DataFrame:
    """The periods as a table, for ``classify_by_table``."""
    rows = [(p.num, p.nombre, p.inicio, p.fin) for p in periods]
    return spark.createDataFrame(rows, PERIOD_TABLE_SCHEMA)


def pick(periods: Iterable[Period], nums: Iterable[int]) -> tuple[Period, ...]:
    """The periods with the given numbers, in the order asked for."""
    by_num = {p.num: p for p in periods}
    return tuple(by_num[n] for n in nums)


def read_period_file(spark: SparkSession, path: str) -> tuple[Period, ...]:
    """Periods from a small CSV with the columns ``num``, ``nombre``, ``inicio``, ``fin`` and optionally ``carpeta``."""
    rows = spark.read.option("header", True).csv(path).collect()
    return tuple(
        Period(int(r["num"]), r["nombre"], dt.date.fromisoformat(r["inicio"]), dt.date.fromisoformat(r["fin"]), r.asDict().get("carpeta"))
        for r in rows
    )
