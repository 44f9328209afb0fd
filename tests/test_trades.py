"""Replay and reports against plain loops."""

import datetime as dt
import math
import random
from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import performance as P, trades as T
from tests.helpers import DAY, at, make_bars

LIVE = replace(T.LIVE, limit_minutes=15)


def loop_live(closes, entry, step=5, rules=LIVE):
    """(leg, exit index) of one entry, walked bar by bar."""
    price, level, out = closes[entry], -rules.trail, {}
    for k in range(entry + 1, len(closes)):
        pct = (closes[k] - price) / price * 100
        late = (k - entry) * step > rules.limit_minutes
        level = max(level, pct - rules.trail)
        if late or pct <= level:
            out.setdefault(2, k)
        if late or pct <= rules.stop or pct >= rules.target:
            out.setdefault(3, k)
    return out


def loop_spec(closes, entry, cutoff, rules=T.SPEC):
    price, mark, out = closes[entry], closes[entry], {}
    for k in range(entry + 1, len(closes)):
        pct = (closes[k] - price) / price * 100
        mark = max(mark, closes[k])
        forced, stopped, gained = k >= cutoff, pct <= rules.stop, pct >= rules.target
        if 2 not in out and (forced or stopped or gained):
            out[2] = k
            if forced or stopped:
                out[3] = k
        elif 2 in out and 3 not in out and (forced or closes[k] <= mark * (1 - rules.trail / 100)):
            out[3] = k
        if len(out) == 2:
            break
    return out


def walk(seed, n=60, sd=1.2):
    r = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(round(out[-1] * (1 + r.gauss(0, sd) / 100), 4))
    return out


def all_entries(bars):
    return bars.select("ticker", "session", F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price"))


@pytest.mark.parametrize("preset", ["live", "spec"])
def test_exits_match_loops(spark, preset):
    series = {f"T{s}": walk(s) for s in range(6)}
    bars = None
    for name, closes in series.items():
        b = make_bars(spark, closes, ticker=name, start=570)
        bars = b if bars is None else bars.unionByName(b)
    rules = LIVE if preset == "live" else T.SPEC
    got = T.exits(all_entries(bars), bars, preset, rules).collect()
    cutoff = (690 - 570) // 5
    seen = set()
    for r in got:
        closes = series[r.ticker]
        k = int((r.entry_ts - at(570)).total_seconds() // 300)
        want = loop_live(closes, k) if preset == "live" else loop_spec(closes, k, cutoff)
        idx = None if r.exit_ts is None else int((r.exit_ts - at(570)).total_seconds() // 300)
        assert idx == want.get(r.leg), (r, want)
        seen.add((r.ticker, k, r.leg))
    expected = {(t, k, leg) for t in series for k in range(60 if preset == "live" else cutoff) for leg in (2, 3)}
    # An entry on a session's last bar has no path and so no row.
    assert expected - seen <= {(t, 59, leg) for t in series for leg in (2, 3)}


def test_exit_after_a_long_pause(spark):
    """The bar that ends the holding time may come hours later."""
    bars = make_bars(spark, [100, 100.5, 101]).withColumn(
        "bar_ts", F.when(F.col("close") == 101, F.lit(at(1000))).otherwise(F.col("bar_ts")))
    got = T.exits(all_entries(bars).filter(F.col("entry_price") == 100), bars, "live", LIVE).collect()
    assert [(r.leg, r.exit_ts) for r in sorted(got, key=lambda r: r.leg)] == [(2, at(1000)), (3, at(1000))]


def test_trail_never_falls(spark):
    bars = make_bars(spark, walk(3, 200, 2.0), start=0)
    paths = T.entry_paths(T.with_deadline(all_entries(bars), replace(LIVE, limit_minutes=120)), bars, 7200)
    levels = T.trail_level(paths).orderBy("entry_ts", "bar_ts").toPandas()
    for _, g in levels.groupby("entry_ts"):
        assert g.trail_level.is_monotonic_increasing and g.trail_level.min() >= -2.5


TRADE = "ticker string, session date, entry_ts timestamp, exit_ts timestamp, entry_price double, pct double"


def random_trades(seed, tickers, n):
    r = random.Random(seed)
    rows = []
    for t in range(tickers):
        for m in sorted(r.sample(range(570, 690), n)):
            rows.append((f"T{t:02d}", DAY, at(m), at(m + r.randint(1, 40)), 10.0, r.uniform(-4, 3)))
    return rows


def test_non_overlapping_matches_loop(spark):
    rows = random_trades(1, 5, 40)
    rows[30] = (*rows[30][:3], None, *rows[30][4:])
    want = []
    for t in sorted({r[0] for r in rows}):
        busy = None
        for r in sorted((x for x in rows if x[0] == t), key=lambda x: x[2]):
            if busy is None or r[2] > busy:
                want.append((t, r[2]))
                busy = r[3] or dt.datetime(9999, 12, 31)
    got = T.non_overlapping(spark.createDataFrame(rows, TRADE))
    assert sorted((r.ticker, r.entry_ts) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("max_open, stop", [(5, -5.0), (2, -0.8), (1, -100.0)])
def test_risk_limits_match_loop(spark, max_open, stop):
    rows = random_trades(2, 30, 6)
    rows += [(f"Z{k:02d}", DAY, at(600), at(620), 10.0, -1.0) for k in range(40)]     # one crowded instant
    held, done, want = [], 0.0, []
    for r in sorted(rows, key=lambda x: (x[2], x[0])):
        for h in [h for h in held if h[3] <= r[2]]:
            done += h[5] * 0.1
            held.remove(h)
        if len(held) < max_open and done > stop:
            held.append(r)
            want.append((r[0], r[2]))
    got = T.risk_limits(spark.createDataFrame(rows, TRADE), max_open, stop).collect()
    assert sorted((r.ticker, r.entry_ts) for r in got) == sorted(want)


def test_fill_at_next_open(spark):
    bars = make_bars(spark, [10, 11, 12], opens=[9, 10.5, 11.5]).withColumn("signal", F.lit(1))
    got = T.fills(bars).orderBy("bar_ts").collect()
    assert [r.entry_price for r in got] == [pytest.approx(10.5 * 1.0005), pytest.approx(11.5 * 1.0005)]
    assert T.fills(bars, side=-1).orderBy("bar_ts").first().entry_price == pytest.approx(10.5 * 0.9995)


def test_performance_matches_pandas(spark):
    rows = []
    for d in range(12):
        for r in random_trades(d, 2, 3):
            day = DAY + dt.timedelta(days=d)
            shift = dt.timedelta(days=d)
            rows.append((r[0], day, r[2] + shift, r[3] + shift, r[4], r[5]))
    pdf = pd.DataFrame(rows, columns=["ticker", "session", "entry_ts", "exit_ts", "entry_price", "pct"])
    got = P.performance(spark.createDataFrame(rows, TRADE)).first()
    day = pdf.groupby("session").pct.sum() * 0.1
    curve = day.cumsum()
    peak = curve.cummax().clip(lower=0)
    assert got.n_trades == len(pdf) and got.n_days == 12
    assert got.win_rate == pytest.approx((pdf.pct > 0).mean())
    assert got.sharpe == pytest.approx(day.mean() / day.std() * math.sqrt(252))
    assert got.sortino == pytest.approx(day.mean() / math.sqrt((day.clip(upper=0) ** 2).mean()) * math.sqrt(252))
    assert got.max_drawdown_pct == pytest.approx((curve - peak).min())
    assert got.profit_factor == pytest.approx(pdf.pct[pdf.pct > 0].sum() / -pdf.pct[pdf.pct < 0].sum())


def test_pnl_has_legs_and_total(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, -0.5), (3, 4.0), (7, 1.0)], "leg int, pct double")
    got = {r.leg: r.sum_pct for r in P.pnl_by_leg(df).collect()}
    assert got == {1: 1.0, 2: 1.5, 3: 5.0, 0: 7.5}


def test_fill_at_the_open_is_tested_on_its_own_bar(spark):
    bars = make_bars(spark, [10, 9, 11], opens=[10, 10, 9])
    signal = bars.withColumn("signal", (F.col("bar_ts") == F.lit(at(600))).cast("int"))
    legs = T.exits(T.fills(signal), bars, "spec", T.SPEC).orderBy("leg").collect()
    assert [round(r.exit_price, 2) for r in legs] == [9.0, 9.0] and all(r.pct < -10 for r in legs)


def test_open_positions_keep_their_slot(spark):
    rows = [("A", DAY, at(600), None, 10.0, None), ("B", DAY, at(605), at(620), 10.0, 1.0)]
    trades = spark.createDataFrame(rows, "ticker string, session date, entry_ts timestamp, exit_ts timestamp, entry_price double, pct double")
    assert [r.ticker for r in T.risk_limits(trades, 1).collect()] == ["A"]
    assert [r.ticker for r in T.account_rules(trades, 1).collect()] == ["A"]


def test_an_entry_the_account_refuses_does_not_block_its_ticker(spark):
    rows = [("A", DAY, at(600), at(604), 10.0, 1.0), ("B", DAY, at(600), at(630), 10.0, 1.0), ("B", DAY, at(605), at(620), 10.0, 1.0)]
    trades = spark.createDataFrame(rows, "ticker string, session date, entry_ts timestamp, exit_ts timestamp, entry_price double, pct double")
    got = T.account_rules(trades, 1).orderBy("entry_ts").collect()
    assert [(r.ticker, r.entry_ts.minute) for r in got] == [("A", 0), ("B", 5)]


def test_entries_without_a_later_bar_keep_a_row(spark):
    bars = make_bars(spark, [10, 10.1])
    entries = bars.select("ticker", "session", F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price"))
    for preset in ("live", "spec"):
        legs = T.exits(entries, bars, preset)
        assert legs.count() == 4 and legs.filter("exit_ts IS NOT NULL").count() == 0


def test_account_rules_keep_entries_closed_on_their_own_bar(spark):
    """They hold no slot, so neither they nor later tickers are lost at a crowded instant."""
    rows = [(f"T{k:02d}", DAY, at(600), at(600), 10.0, -0.01) for k in range(30)]
    rows += [(f"Z{k:02d}", DAY, at(600), at(620), 10.0, 1.0) for k in range(12)]
    rows += [("Y", DAY, at(610), None, 10.0, 1.0), ("ZZ", DAY, at(621), at(621), 10.0, 1.0)]
    got = T.account_rules(spark.createDataFrame(rows, TRADE), 2).collect()
    assert sorted(r.ticker for r in got) == [*(f"T{k:02d}" for k in range(30)), "Z00", "Z01", "ZZ"]
    losers = [(f"T{k:02d}", DAY, at(600), at(600), 10.0, -3.0) for k in range(30)]
    assert len(T.account_rules(spark.createDataFrame(losers, TRADE)).collect()) == 17
