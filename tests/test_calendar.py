"""Exchange calendar, idle days and cumulative volumes over quiet minutes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import calendar as C, performance as P, sessions as S, trades as T
from tests.helpers import make_bars


def utc(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


@pytest.fixture(scope="module")
def cal(spark):
    exceptions = spark.createDataFrame([("2024-03-29", None, None), ("2024-11-29", 570, 780), ("2024-12-02", 600, 960)],
                                       "session string, open_minute int, close_minute int")
    days = C.day_range(spark, "2024-03-01", "2024-12-31")
    return C.exchange_calendar(days, exceptions.withColumn("session", F.to_date("session")))


def test_both_sides_of_clock_changes_half_days_and_holidays(cal):
    got = {str(r.session): (r.pre_ts, r.open_ts, r.close_ts) for r in cal.collect()}
    assert got["2024-03-08"] == (utc("2024-03-08 14:00"), utc("2024-03-08 14:30"), utc("2024-03-08 21:00"))
    assert got["2024-03-11"] == (utc("2024-03-11 13:00"), utc("2024-03-11 13:30"), utc("2024-03-11 20:00"))
    assert got["2024-11-01"][1] == utc("2024-11-01 13:30") and got["2024-11-04"][1] == utc("2024-11-04 14:30")
    assert got["2024-11-29"][2] == utc("2024-11-29 18:00")
    assert got["2024-12-02"][:2] == (utc("2024-12-02 14:30"), utc("2024-12-02 15:00"))
    assert not {"2024-03-09", "2024-03-10", "2024-03-29"} & set(got)


def test_phases_and_sessions_of_instants(spark, cal):
    rows = [utc(t) for t in ("2024-03-11 12:59", "2024-03-11 13:00", "2024-03-11 13:30", "2024-03-11 20:00", "2024-03-12 03:59",
                             "2024-03-12 04:00", "2024-11-29 18:00", "2024-03-10 15:00")]
    df = C.with_session(spark.createDataFrame([(t,) for t in rows], "bar_ts timestamp"), "bar_ts")
    got = {r.bar_ts: (str(r.session), r.phase) for r in C.with_phase(df, cal).collect()}
    want = ["", "premarket", "regular", "after", "after", "", "after", ""]
    assert [got[t][1] or "" for t in rows] == want
    assert got[rows[4]][0] == "2024-03-11" and got[rows[5]][0] == "2024-03-12"


def test_forced_close_comes_with_the_half_day(spark, cal):
    day = dt.date(2024, 11, 29)
    bars = make_bars(spark, [10.0] * 12, day=day, start=17 * 60 + 30, step=5)
    entries = C.with_forced_close(bars.filter(F.minute("bar_ts") == 35).select(
        "ticker", "session", F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price")), cal, 300)
    legs = T.exits(entries, bars, "spec", T.SPEC).collect()
    assert {r.exit_ts for r in legs} == {utc("2024-11-29 18:00")}
    opened = C.with_open_minutes(entries, cal).first().open_minutes
    assert opened == 185.0


def test_idle_days_count(spark):
    rows = [("2024-03-04", 1.0), ("2024-03-29", 2.0)]
    trades = spark.createDataFrame(rows, "d string, pct double").select(
        F.lit("A").alias("ticker"), F.to_date("d").alias("session"), F.col("d").cast("timestamp").alias("entry_ts"),
        F.col("d").cast("timestamp").alias("exit_ts"), "pct")
    days = C.exchange_calendar(C.day_range(spark, "2024-01-01", "2024-12-31"))
    p = P.performance(trades, days=days).first()
    assert p.n_days == 20 and p.n_trades == 2 and p.trades_per_day == pytest.approx(0.1)
    assert p.annual_return_pct == pytest.approx(0.3 / 20 * 252)
    curve = P.equity_curve(trades, ["ticker"], days=days).orderBy("session").collect()
    assert len(curve) == 20 and curve[5].equity_pct == pytest.approx(0.1) and curve[-1].equity_pct == pytest.approx(0.3)
    assert P.performance(trades).first().n_days == 2


def test_quiet_sessions_count_in_the_expected_volume(spark):
    days = [dt.date(2024, 3, d) for d in (4, 5, 6)]
    a = make_bars(spark, [1, 1, 1], day=days[0], start=600, volumes=[10, 10, 10])
    b = make_bars(spark, [1, 1], day=days[1], start=600, step=10, volumes=[50, 50])          # quiet at 10:05
    c = make_bars(spark, [1, 1], day=days[2], start=605, volumes=[7, 7])
    got = {(r.session.day, r.minute): (r.cum_volume, r.expected_cum_volume) for r in
           S.cum_volume_ratio(a.unionByName(b).unionByName(c), 300).collect()}
    assert got[6, 605] == (7, 35.0)                      # (20 + 50) / 2
    assert got[6, 610] == (14, 65.0) and got[5, 600] == (50, 10.0) and got[4, 600] == (10, None)
    assert len(got) == 7
