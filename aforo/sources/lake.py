"""Readings as Parquet, partitioned by month: written once, so that later runs prune folders and columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.operators.classify import in_any_period
from aforo.operators.clean import TS
from aforo.periods import Period

PARTITIONS = ("año", "mes")


def write_readings(df: DataFrame, path: str, rebalance: bool = True, mode: str = "errorifexists") -> None:
    """Write cleaned readings partitioned by year and month, each file in time order.

    The rebalance hint brings a month's rows together and lets AQE split a month that is larger
    than the advised partition size over several tasks, so one month holding most of the data is
    no bottleneck and small months make no crumbs. Input that already lies in month files needs
    no shuffle: ``rebalance=False`` writes each task's rows as they come.

    Rows without a readable date go to the null partition.
    """
    rows = df.hint("rebalance", *(F.col(c) for c in PARTITIONS)) if rebalance else df
    rows.sortWithinPartitions(*PARTITIONS, TS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def _months(periods: Sequence[Period], period_end: str) -> Column:
    """Months the periods touch, as a test on the partition columns alone."""
    month = F.col("año") * 12 + F.col("mes")

    def span(p: Period) -> Column:
        last: dt.date = p.fin
        return month.between(p.inicio.year * 12 + p.inicio.month, last.year * 12 + last.month)

    return reduce(or_, (span(p) for p in periods))


def read_readings(
    spark: SparkSession,
    path: str,
    periods: Sequence[Period] | None = None,
    period_end: str = "instant",
) -> DataFrame:
    """Cleaned readings; with ``periods``, only their rows: months are pruned, row groups skipped by date."""
    df = spark.read.parquet(path)
    if periods is None:
        return df
    return df.filter(_months(periods, period_end)).filter(in_any_period(F.col(TS), periods, period_end))
