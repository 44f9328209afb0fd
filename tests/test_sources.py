"""Hand-made inputs for the readers and their odd lines."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.schemas import FEATURES
from barloom.sources import files as R, sinks as W

CANDLES = [{"open": 10.0, "high": 11.0, "low": 9.5, "close": 10.5, "volume": 100, "datetime": 1709546400000},
           {"open": 10.5, "high": 10.6, "low": 10.1, "close": 10.2, "volume": 50, "datetime": 1709546700000}]


@pytest.mark.parametrize("whole", [False, True])
def test_candles(spark, tmp_path, whole):
    text = json.dumps({"symbol": "ABC", "candles": CANDLES, "empty": False}, indent=2 if whole else None)
    (tmp_path / "c.json").write_text(text)
    got = R.read_candles(spark, str(tmp_path), "5min", whole_file=whole).orderBy("pos").collect()
    assert [(r.ticker, r.pos, r.close, r.volume, str(r.bar_ts)) for r in got] == [
        ("ABC", 0, 10.5, 100, "2024-03-04 10:00:00"), ("ABC", 1, 10.2, 50, "2024-03-04 10:05:00")]


def test_fundamentals_and_quotes(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/f.json").write_text(json.dumps(
        {"ABC": {"fundamental": {"marketCapFloat": 2.5, "high52": 20.0, "low52": 4.0}},
         "XY": {"fundamental": {"high52": 9.0, "low52": 1.0}}}, indent=1))
    got = {r.ticker: r for r in R.read_fundamentals(spark, str(tmp_path / "f"), whole_file=True).collect()}
    assert got["ABC"].float_shares == 2500000.0 and got["XY"].float_shares is None
    (tmp_path / "q").mkdir()
    (tmp_path / "q/q.json").write_text(json.dumps(
        {"ABC": {"lastPrice": 10.0, "totalVolume": 7, "52WkHigh": 20.0, "52WkLow": 4.0,
                 "quoteTimeInLong": 1709546400000}}))
    q = R.read_quotes(spark, str(tmp_path / "q")).first()
    assert (q.last_price, q.total_volume, q.wk52_high, q.wk52_low) == (10.0, 7, 20.0, 4.0)


def test_event_log_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "Ticker Epoch\nABC 1709546400000\nF 1709546400000\nBRK.B 1709546400000\nAB1 1709546401000\n"
        "NOTIME\n12345 ABC\n\n")
    good, bad = R.read_event_log(spark, str(tmp_path))
    assert sorted(r.ticker for r in good.collect()) == ["AB1", "ABC", "BRK.B", "F"]
    assert sorted(r.value for r in bad.collect()) == ["12345 ABC", "NOTIME"]


HISTORY = ["ABC 0.5Time Bought: 41.5 Time Sold: 15.1 Percent: -2.345 SOLD 2",
           "ABC -0.5Time Bought: 41.5 Time Sold: 15.1 Percent: 15 SOLD 3",
           "F 1e-05Time Bought: 4.0 Time Sold: 1.0 Percent: 1.5e-05 SOLD 1",
           "no trade here"]


def test_history_modes(spark):
    lines = spark.createDataFrame([(h,) for h in HISTORY], "value string")
    got = R.parse_trade_history(lines).orderBy("leg").collect()
    assert [(r.leg, r.pct) for r in got] == [(1, 1.5e-05), (2, -2.345), (3, 15.0)]
    assert got[0].profit == 1e-05 and got[1].held_minutes == 15.1
    old = {r.leg: r.pct for r in R.parse_trade_history(lines, "legacy_regex").collect()}
    assert old[2] == -2.34 and old[3] == 1.0      # the last digit is lost
    with pytest.raises(ValueError):
        R.parse_trade_history(lines, "other")


def test_history_lines_are_trades_or_in_quarantine(spark):
    odd = ["", "  ", "no trade here", "ABC x.yTime Bought: 1.0 Time Sold: 1.0 Percent: 2.0 SOLD 1", "a\tb\tc\td\te\tf", None]
    lines = spark.createDataFrame([(h,) for h in [*HISTORY[:3], *odd]], "value string")
    rows, bad = R.split_trade_history(lines)
    assert rows.count() == 3
    assert sorted(r.value for r in bad.collect()) == sorted([odd[2], odd[3], odd[4]])
    old_rows, old_bad = R.split_trade_history(lines, "legacy_regex")
    assert old_rows.count() + old_bad.count() == 6


def test_history_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(HISTORY[0],)], "value string")
    rows = R.parse_trade_history(lines)
    W.append_trades(rows, str(tmp_path / "h"), "text")
    W.append_trades(rows, str(tmp_path / "h"), "text")
    back = R.read_trade_history(spark, str(tmp_path / "h"))
    assert back.count() == 2 and back.distinct().collect() == rows.collect()


@pytest.mark.parametrize("header", [True, False])
def test_training_csv(spark, tmp_path, header):
    values = [str(i / 8) for i in range(len(FEATURES))]
    values[3], values[4] = "NaN", ""
    lines = [",".join(["", *FEATURES, "y_list"])] if header else []
    lines += [",".join(["0", *values, "0.7"])]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    r = R.read_training_csv(spark, str(tmp_path), header=header).first()
    assert r[FEATURES[0]] == 0.0 and r[FEATURES[3]] is None and r[FEATURES[4]] is None and r.y == 0.7


def test_training_table_modes(spark, tmp_path):
    df = spark.createDataFrame([("A", "2024-01-01", 1.0), ("B", "2024-01-02", 2.0)], "ticker string, session string, y double")
    path = str(tmp_path / "t")
    W.write_training(df, path)
    W.write_training(df, path)
    assert spark.read.parquet(path).count() == 2
    W.write_training(df, path, "append")
    assert spark.read.parquet(path).count() == 4
    W.write_training(df.drop("session"), path, by=None)
    assert spark.read.parquet(path).count() == 2


def test_order_log_replaces_its_own_sessions_only(spark, tmp_path):
    path = str(tmp_path / "o")
    taken = spark.createDataFrame([("A", "2024-01-01", 9.0), ("B", "2024-01-01", 400.0), ("A", "2024-01-02", 10.0)],
                                  "ticker string, session string, entry_price double").withColumns(
        {"session": F.to_date("session"), "entry_ts": F.to_timestamp("session")})
    orders = W.order_log(taken, 1000.0, 0.01)
    W.write_order_log(orders, path)
    W.write_order_log(orders.filter("session = '2024-01-02'"), path)          # replayed
    W.write_order_log(orders.filter("session > '2025-01-01'"), path)          # an empty batch
    got = {(r.ticker, str(r.session)): (round(r.limit_price, 6), r.quantity) for r in spark.read.parquet(path).collect()}
    assert got == {("A", "2024-01-01"): (9.09, 112), ("B", "2024-01-01"): (404.0, 4), ("A", "2024-01-02"): (10.1, 102)}


def test_rolling_log(spark):
    log = spark.range(10).select(F.concat(F.lit("T"), "id").alias("ticker"),
                                 F.timestamp_seconds(F.col("id") * 86400).alias("add_ts"))
    kept = W.roll_event_log(log, keep_n=3).collect()
    assert sorted(r.ticker for r in kept) == ["T7", "T8", "T9"]
    assert W.roll_event_log(log, days=4).count() == 4
