import datetime as dt
from unittest import mock

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aforo.operators import classify as lookup
from aforo.operators.classify import classify, classify_by_table
from aforo.operators.clean import clean
from aforo.operators.profile import classification_profile
from aforo.periods import PERIODS, Period, period_table, pick

CASES = [
    ("2018-12-31 23:45:00", None, None),
    ("2019-01-01 00:00:00", 1, 1),
    ("2020-01-30 23:45:00", 1, 1),
    ("2020-01-31 00:00:00", 1, 1),
    ("2020-01-31 00:15:00", None, 1),
    ("2020-01-31 23:59:59.999999", None, 1),
    ("2020-02-01 00:00:00", 2, 2),
    ("2020-03-15 12:00:00", None, 2),
    ("2020-03-16 00:00:00", 3, 3),
    ("2020-05-02 00:00:00", 3, 3),
    ("2020-05-02 00:00:01", None, 3),
    ("2020-05-03 00:00:00", 4, 4),
    ("2020-12-31 00:00:00", 4, 4),
    ("2020-12-31 12:00:00", None, 4),
    ("2021-01-01 00:00:00", None, None),
    (None, None, None),
]
NAMES = {p.num: p.nombre for p in PERIODS} | {None: None}


@pytest.fixture
def readings(spark, ts):
    rows = [(i, t and ts(t)) for i, (t, _, _) in enumerate(CASES)]
    return clean(spark.createDataFrame(rows, "i int, fecha timestamp_ntz"))


def labels(df):
    return {r.i: (r.periodo_num, r.periodo) for r in df.collect()}


@pytest.mark.parametrize("end, column", [("instant", 1), ("day", 2)])
def test_bounds(readings, end, column):
    expected = {i: (c[column], NAMES[c[column]]) for i, c in enumerate(CASES)}
    assert labels(classify(readings, period_end=end, keep_unclassified=True)) == expected
    kept = {i: v for i, v in expected.items() if v[0] is not None}
    assert labels(classify(readings, period_end=end)) == kept
    assert labels(classify(readings, period_end=end, only=[2, 4])) == {i: v for i, v in kept.items() if v[0] in (2, 4)}


@pytest.mark.parametrize("end", ["instant", "day"])
def test_table_lookup_equals_expression(spark, readings, end):
    by_table = classify_by_table(readings, period_table(spark), end)
    assert labels(by_table) == labels(classify(readings, period_end=end, keep_unclassified=True))


def test_dropped_rows_are_counted(readings):
    row = classification_profile(classify(readings, keep_unclassified=True)).first()
    assert (row.filas, row.clasificadas, row.sin_periodo) == (16, 8, 8)


def test_label_by_date_replaces_label_by_folder(readings):
    df = readings.withColumn("periodo_num", F.lit(9)).withColumn("periodo", F.lit("carpeta"))
    out = classify(df)
    assert out.columns.count("periodo") == 1
    assert set(r.periodo_num for r in out.collect()) == {1, 2, 3, 4}


days = st.dates(dt.date(2020, 1, 1), dt.date(2020, 3, 1))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    bounds=st.lists(st.tuples(days, st.integers(0, 40)), min_size=1, max_size=5),
    moments=st.lists(st.tuples(days, st.sampled_from([0, 1, 86_399])), min_size=1, max_size=30),
    end=st.sampled_from(["instant", "day"]),
)
def test_first_match_wins_however_periods_overlap(spark, bounds, moments, end):
    periods = [Period(i, f"p{i}", a, a + dt.timedelta(days=n)) for i, (a, n) in enumerate(bounds)]
    stamps = [dt.datetime.combine(d, dt.time()) + dt.timedelta(seconds=s) for d, s in moments]

    def brute(t):
        for p in periods:
            start, last = (dt.datetime.combine(d, dt.time()) for d in (p.inicio, p.fin))
            if start <= t and (t <= last if end == "instant" else t < last + dt.timedelta(days=1)):
                return p.num, p.nombre
        return None, None

    df = clean(spark.createDataFrame(list(enumerate(stamps)), "i int, fecha timestamp_ntz"))
    expected = {i: brute(t) for i, t in enumerate(stamps)}
    assert labels(classify(df, periods, end, keep_unclassified=True)) == expected
    for most in (100_000, 1):
        # Each period unfolded by itself, and by binary blocks.
        with mock.patch.object(lookup, "BROADCAST_ENTRIES", most):
            by_table = classify_by_table(df, period_table(spark, periods), end)
            assert by_table.count() == len(stamps)
            assert labels(by_table) == expected


def test_dates_reach_the_scan(spark, plan):
    from aforo.sources.views import EVENT_PERIODS, events_readings

    df = clean(events_readings(spark, "/root/testdata/sf0.001"))
    pushed = plan(classify(df, EVENT_PERIODS).groupBy("periodo").count())
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz>" in pushed
    one = plan(classify(df, EVENT_PERIODS, only=[2]).groupBy("periodo").count())
    assert "GreaterThanOrEqual(ts,2024-01-11T00:00)" in one and "2024-01-01T00:00)" not in one.split("PushedFilters")[1].split("\n")[0]


def test_many_periods_in_a_month(spark, plan):
    """A hundred thousand periods of a day each: no more rows than the days have segments, and no lists."""
    n = 100_000
    table = spark.range(n).select(
        (F.lit(n) - F.col("id")).alias("num"),
        F.format_string("p%d", "id").alias("nombre"),
        F.expr("date_add(date'2020-05-01', int(id % 30))").alias("inicio"),
    )
    table = table.withColumn("fin", F.date_add("inicio", 1))
    stamps = [(i, dt.datetime(2020, 5, 1) + dt.timedelta(hours=7 * i)) for i in range(120)]
    df = clean(spark.createDataFrame(stamps, "i int, fecha timestamp_ntz"))
    found = classify_by_table(df, table)
    lowest = {d: n - max(i for i in range(n - 60, n) if i % 30 == d) for d in range(30)}

    def brute(t):
        days = [d for d in range(30) if 0 <= (t - dt.datetime(2020, 5, 1 + d)).total_seconds() <= 86_400]
        return min((lowest[d] for d in days), default=None)

    assert {i: r[0] for i, r in labels(found).items()} == {i: brute(t) for i, t in stamps}
    text = plan(found)
    assert "collect_list" not in text and "BroadcastHashJoin" in text
    assert lookup._resolved(table, "instant", 2 * n).count() == 61


def test_table_lookup_is_an_equality_join(spark, plan):
    from aforo.sources.views import EVENT_PERIODS, events_readings

    df = clean(events_readings(spark, "/root/testdata/sf0.001"))
    text = plan(classify_by_table(df, period_table(spark, EVENT_PERIODS)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_bad_arguments(spark, readings):
    with pytest.raises(ValueError):
        classify(readings, period_end="week")
    with pytest.raises(ValueError):
        classify(readings, periods=())
    with pytest.raises(ValueError):
        Period(1, "x", dt.date(2020, 1, 2), dt.date(2020, 1, 1))
    with pytest.raises(TypeError):
        classify_by_table(readings, period_table(spark).withColumn("fin", F.col("fin").cast("timestamp_ntz")))
    assert [p.num for p in pick(PERIODS, [4, 1])] == [4, 1]
