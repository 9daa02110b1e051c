"""Window assignment edges, point-in-time reads, event aggregates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cutline.functions import scalars as C
from cutline.operators import events as E
from cutline.operators.calendar import assign_window, dense_grid, strict_after_calendar, trading_calendar, window_start
from cutline.sources import tables as S

D = dt.date
T = dt.datetime


@pytest.fixture
def cal(spark):
    days = spark.createDataFrame([(D(2024, 1, d),) for d in (2, 3, 4, 5, 8)], "date_et date")
    return trading_calendar(days)


def at(spark, *times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts timestamp_ntz")


def test_calendar_skips_weekend(cal):
    rows = {r["date"]: r for r in cal.collect()}
    assert rows[D(2024, 1, 5)]["target"] == D(2024, 1, 8)
    assert rows[D(2024, 1, 5)]["cutoff"] == T(2024, 1, 8, 9, 30)
    assert D(2024, 1, 8) not in rows


def test_event_at_cutoff_goes_to_next_window(spark, cal):
    x = at(spark, T(2024, 1, 3, 9, 30), T(2024, 1, 3, 9, 29, 59), T(2024, 1, 2, 9, 30), T(2024, 1, 2, 9, 29), T(2024, 1, 6, 12), T(2024, 1, 8, 9, 30))
    got = {r["id"]: r["target"] for r in assign_window(x, cal, "ts").collect()}
    assert got == {0: D(2024, 1, 4), 1: D(2024, 1, 3), 2: D(2024, 1, 3), 4: D(2024, 1, 8)}


def test_strict_after_drops_first_window(spark, cal):
    x = at(spark, T(2024, 1, 2, 12), T(2024, 1, 3, 12))
    got = {r["id"]: r["target"] for r in assign_window(x, strict_after_calendar(cal), "ts").collect()}
    assert got == {1: D(2024, 1, 4)}


def test_window_start_counts_trading_days(cal):
    got = {r["date"]: r["since"] for r in window_start(cal, days=2).collect()}
    assert got[D(2024, 1, 5)] == T(2024, 1, 4)
    assert got[D(2024, 1, 2)] == T(2024, 1, 2)


def test_dense_grid_is_complete(spark, cal):
    keys = spark.createDataFrame([("A",), ("B",)], "symbol string")
    assert dense_grid(keys, "symbol", cal).count() == 2 * 4


def test_extended_hours_excludes_bar_known_at_open(spark):
    rows = [("A", T(2024, 1, 3, 8), 10.0, "pre", T(2024, 1, 3, 9)), ("A", T(2024, 1, 3, 9), 11.0, "pre", T(2024, 1, 3, 9, 30)),
            ("A", T(2024, 1, 3, 16), 12.0, "post", T(2024, 1, 3, 17)), ("A", T(2024, 1, 3, 17), None, "post", T(2024, 1, 3, 18))]
    p = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, close double, session string, known_at timestamp_ntz")
    r = E.extended_hours(p).first()
    assert (r["pre_last"], r["pre_last_leak"], r["post_last"]) == (10.0, 11.0, 12.0)


def test_last_non_null_is_per_column(spark):
    x = spark.createDataFrame([("A", 1, 5.0, None), ("A", 2, None, 7.0), ("A", 3, None, None)], "k string, t int, a double, b double")
    r = E.last_non_null(x, ["k"], "t", ["a", "b"]).first()
    assert (r["a"], r["b"]) == (5.0, 7.0)


def test_grade_edges(spark):
    x = spark.createDataFrame([(-2.5,), (-0.6,), (0.6,), (2.5,), (-2.51,), (0.0,), (None,)], "r double")
    assert [r[0] for r in x.select(C.grade("r")).collect()] == [1, 2, 3, 4, 0, 2, None]


def test_zero_prior_target_takes_the_limit(spark):
    x = spark.createDataFrame([(5.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in x.select(C.clipped_change("a", "b", 0.5)).collect()] == [0.5, None, 0.5, None]


def test_abnormal_count_needs_full_history(spark):
    days = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=i),) for i in range(26)], "date_et date")
    grid = dense_grid(spark.createDataFrame([("A",)], "symbol string"), "symbol", trading_calendar(days)).withColumn("n", F.lit(0.0))
    rows = E.abnormal_counts(grid, ["n"], missing={"miss": "n"}).orderBy("widx").collect()
    assert [r["n_abn"] is None for r in rows] == [True] * 20 + [False] * 5
    assert [r["miss"] for r in rows] == [0.0] * 20 + [1.0] * 5


def test_appending_later_rows_does_not_change_earlier_cut(spark):
    x = at(spark, T(2024, 1, 3, 9), T(2024, 1, 3, 9, 30), T(2024, 1, 4))
    got = [r["id"] for r in S.asof(x, None, "2024-01-03 09:30:00", clock="ts").collect()]
    assert got == [0]


def test_tag_filter_matches_whole_tags(spark):
    x = spark.createDataFrame([("A,BB",), ("AB",), (None,)], "symbols string")
    assert [r[0] for r in S.symbol_filter(x, ["A"]).collect()] == ["A,BB"]
