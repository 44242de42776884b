"""Readings projected from general tables: event logs and order lines take the place of sensor files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aforo.periods import PERIODS, Period


def _dated(*bounds: tuple[str, str]) -> tuple[Period, ...]:
    """The known periods moved to other dates."""
    days = [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in bounds]
    return tuple(Period(p.num, p.nombre, a, b, p.carpeta) for p, (a, b) in zip(PERIODS, days))


EVENT_PERIODS = _dated(
    ("2024-01-01", "2024-01-10"),
    ("2024-01-11", "2024-01-15"),
    ("2024-01-16", "2024-01-20"),
    ("2024-01-21", "2024-01-28"),
)
LINEITEM_PERIODS = _dated(
    ("1995-01-01", "1996-12-31"),
    ("1997-01-01", "1998-06-30"),
    ("1998-07-01", "1999-12-31"),
    ("2000-01-01", "2001-06-30"),
)


# The columns the views need. Given, so that no footer is opened to plan a query.
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINEITEM_SCHEMA = (
    "l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_returnflag string, l_shipdate timestamp_ntz"
)


def events_readings(spark: SparkSession, sf_dir: str, missing: str = "null") -> DataFrame:
    """Readings from ``events``; every seventh has no occupancy, as NULL or as NaN."""
    gap = F.lit(None).cast("double") if missing == "null" else F.lit(float("nan"))
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.col("user_id").alias("id"),
        F.col("ts").alias("fecha"),
        F.when(F.col("event_type").isin("click", "view", "signup"), "URB").otherwise("M30").alias("tipo_elem"),
        # props is a flat object with one integer; a pattern reads it six times as fast as a JSON parser.
        (F.regexp_extract("props", r'"k": *(\d+)', 1).cast("int") * 10).alias("intensidad"),
        F.when(F.col("event_id") % 7 == 0, gap).otherwise(F.col("value") / 5).alias("ocupacion"),
        F.col("value").alias("carga"),
        (F.floor("value") - 20).cast("int").alias("vmed"),
    )


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings from ``lineitem``."""
    return spark.read.schema(LINEITEM_SCHEMA).parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("id"),
        F.col("l_shipdate").alias("fecha"),
        F.col("l_returnflag").alias("tipo_elem"),
        F.col("l_extendedprice").alias("intensidad"),
        (F.col("l_discount") * 100).alias("ocupacion"),
        F.col("l_quantity").alias("carga"),
        (F.col("l_linenumber") - 3).alias("vmed"),
    )
