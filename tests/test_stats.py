import math
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aforo.functions.values import lookup, number_from_text, round_half_even, within
from aforo.operators import median
from aforo.operators.clean import clean
from aforo.operators.stats import Stat, group_stats, named_stats, spec_stats

QUIET = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_spec_names_columns_by_measure_and_statistic():
    assert [s.name for s in spec_stats({"a": ["mean", "std"], "b": ["max"]})] == ["a_mean", "a_std", "b_max"]
    assert named_stats("a", [("media", "mean")]) == [Stat("media", "a", "mean")]


def test_one_row_group_has_no_deviation(spark):
    df = spark.createDataFrame([("x", 3.0)], "k string, v double")
    assert tuple(group_stats(df, ["k"], spec_stats({"v": ["mean", "std", "count"]})).first()) == ("x", 3.0, None, 1)


@pytest.mark.parametrize("policy, expected", [("skip", (6.0, 7.0, 2)), ("propagate", None)])
def test_missing_occupancy(spark, policy, expected):
    rows = [("2020-01-01 00:00:00", float(v)) for v in ("5", "NaN", "7")]
    df = clean(spark.createDataFrame(rows, "fecha string, ocupacion double"), nan=policy)
    row = tuple(group_stats(df, ["año"], spec_stats({"ocupacion": ["mean", "max", "count"]})).first())[1:]
    if expected:
        assert row == expected
    else:
        assert math.isnan(row[0]) and math.isnan(row[1]) and row[2] == 3


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0.125, 0.375, 7, "a")], "a double, b double, c int, d string")
    assert tuple(round_half_even(df, 2).first()) == (0.12, 0.38, 7, "a")
    assert round_half_even(df, None) is df


def test_valid_range_turns_sentinels_to_null(spark):
    df = spark.createDataFrame([(-127,), (0,), (99_999,), (None,), (900,)], "v int")
    assert [r[0] for r in df.select(within(F.col("v"), 0, 900)).collect()] == [None, 0, None, None, 900]


@pytest.mark.parametrize(
    "text, kind, expected",
    [
        ("12", "int", 12),
        ("12.0", "int", 12),
        ("12.7", "int", None),
        (" 12 ", "int", 12),
        ("-127", "int", -127),
        ("99999999999", "int", None),
        ("99999999999", "bigint", 99_999_999_999),
        ("9007199254740993", "bigint", 9_007_199_254_740_993),
        ("NaN", "int", None),
        ("x", "double", None),
        ("1e3", "double", 1000.0),
        ("1e300", "int", None),
        ("Infinity", "bigint", None),
        ("", "int", None),
        (None, "int", None),
    ],
)
def test_numbers_from_text(spark, text, kind, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(number_from_text(F.col("t"), kind)).first()[0] == expected


def test_dictionary_lookup(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r[0] for r in df.select(lookup(F.col("k"), {1: "uno", 3: "tres"})).collect()] == ["uno", None, None]


values = st.one_of(st.none(), st.integers(-5, 5), st.integers(-(10**6), 10**6))


@settings(max_examples=12, **QUIET)
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), values), min_size=1, max_size=40))
def test_exact_median(spark, rows):
    for kind, cast in (("int", int), ("double", float)):
        data = [(k, None if v is None else cast(v)) for k, v in rows]
        df = spark.createDataFrame(data, f"k string, v {kind}")
        got = {r.k: (r.v_median, r.v_count) for r in group_stats(df, ["k"], spec_stats({"v": ["median", "count"]})).collect()}
        expected = {}
        for key in {k for k, _ in data}:
            present = [v for k, v in data if k == key and v is not None]
            expected[key] = (float(statistics.median(present)) if present else None, len(present))
        assert got == expected


def test_exact_median_of_many_distinct_values(spark):
    """One group holds nine tenths of the rows, all values differ, and partitions are unlike each other."""
    n = 300_000
    df = spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 10 == 0, "frio").otherwise("caliente").alias("k"),
        (F.pow(F.col("id") / 7.0, 1.5) - 1000).alias("v"),
    )
    got = {r.k: r.m for r in group_stats(df, ["k"], [Stat("m", "v", "median")]).collect()}
    built_in = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert got == built_in


@pytest.fixture
def no_broadcast(spark):
    """Joins shuffle both sides, and AQE splits skewed partitions early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_median_of_many_groups_with_one_hot(spark, no_broadcast):
    df = spark.range(0, 200_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("k"),
        F.sin(F.col("id").cast("double")).alias("v"),
        (F.col("id") % 101).cast("int").alias("w"),
    )
    stats = spec_stats({"v": ["median", "count"], "w": ["median", "max"]})
    got = {r.k: tuple(r)[1:] for r in group_stats(df, ["k"], stats).collect()}
    built_in = df.groupBy("k").agg(F.median("v"), F.count("v"), F.median("w"), F.max("w"))
    assert got == {r.k: tuple(r)[1:] for r in built_in.collect()}


def test_table_lookup_without_broadcast(spark, no_broadcast, plan):
    import datetime as dt

    from aforo.operators.classify import classify, classify_by_table
    from aforo.periods import PERIODS, Period, period_table

    hour = F.expr("make_dt_interval(0, cast(id % 20000 as int), 0, 0)")
    fecha = F.when(F.col("id") % 3 == 0, F.lit("2020-03-20").cast("timestamp_ntz")).otherwise(
        F.lit("2018-12-01").cast("timestamp_ntz") + hour
    )
    df = clean(spark.range(0, 100_000, 1, 8).select("id", fecha.alias("fecha")))
    by_table = classify_by_table(df, period_table(spark), broadcast=False)
    assert "BroadcastExchange" not in plan(by_table)
    expected = classify(df, keep_unclassified=True)
    columns = ("id", "periodo_num", "periodo")
    assert by_table.select(*columns).exceptAll(expected.select(*columns)).count() == 0
    assert by_table.count() == 100_000

    ancient = [*PERIODS, Period(9, "antes", dt.date(1800, 1, 1), dt.date(1800, 1, 2))]
    with_ancient = classify_by_table(df, period_table(spark, ancient), broadcast=True)
    assert with_ancient.select(*columns).exceptAll(expected.select(*columns)).count() == 0


def test_median_of_one_group_of_a_million_values(spark):
    """The counts of the cells are made by several tasks, and one cell of the bracket is ordered."""
    df = spark.range(0, 1_000_001, 1, 8).select(F.lit("g").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_001)) / 3).alias("v"))
    assert group_stats(df, ["k"], [Stat("m", "v", "median")]).first().m == 500_000 / 3


@pytest.mark.parametrize("n", [2000, 2001])
def test_median_of_skewed_values_in_bounded_lists(spark, monkeypatch, n):
    """Nearly all values next to 1, some at a billion: narrowed by ranks until few are left, whatever the values."""
    monkeypatch.setattr(median, "MOST_VALUES", 20)
    monkeypatch.setattr(median, "CELLS", 4)
    monkeypatch.setattr(median, "BRACKET", 0.45)
    rounds = []
    narrowed = median._narrowed
    monkeypatch.setattr(median, "_narrowed", lambda c: rounds.append(c) or narrowed(c))
    values = [1 + i * 1e-9 for i in range(n - 150)] + [1e9 + i for i in range(100)] + [-1e9] * 50
    random.Random(5).shuffle(values)
    rows = [("hot", v, float(i)) for i, v in enumerate(values)] + [(f"k{i % 7}", float(i % 5), 0.5) for i in range(100)] + [(None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: (r.v_median, r.w_median) for r in group_stats(df, ["k"], spec_stats({"v": ["median"], "w": ["median"]})).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        present = [r[1] for r in mine if r[1] is not None]
        assert got[key] == (statistics.median(present) if present else None, statistics.median(r[2] for r in mine))
    assert len(rounds) > 2


def test_median_passes_over_nan(spark):
    df = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", 3.0), ("b", float("nan"))], "k string, v double")
    got = {r.k: r.v_median for r in group_stats(df, ["k"], spec_stats({"v": ["median"]})).collect()}
    assert got == {"a": 2.0, "b": None}


def test_median_of_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", inf), ("a", 1.0), ("b", -inf), ("b", 2.0), ("c", inf)], "k string, v double")
    got = {r.k: r.v_median for r in group_stats(df, ["k"], spec_stats({"v": ["median"]})).collect()}
    assert got == {"a": inf, "b": -inf, "c": inf}


def test_approximate_median_is_one_aggregate(spark, plan):
    df = spark.range(1001).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    result = group_stats(df, ["k"], spec_stats({"v": ["median_approx"]}), sort=False)
    assert result.first().v_median_approx == 500.0
    assert "Join" not in plan(result)


def test_statistics_fold_before_the_shuffle(spark, plan):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    text = plan(group_stats(df, ["k"], spec_stats({"v": ["mean", "std", "max", "min", "count"]}), sort=False), "simple")
    assert text.count("Exchange") == 1
    assert text.index("partial_avg") > text.index("Exchange hashpartitioning(k")
