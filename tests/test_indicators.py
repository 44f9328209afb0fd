"""Indicators against independent pandas recursions over the test bars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from tests.helpers import make_bars

KEY = ["ticker", "session"]


def ours(df, *cols):
    return df.orderBy("ticker", "session", "bar_ts").select(*cols).toPandas()


def same(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("n", [5, 9, 20])
def test_ema(bars, bars_pd, n):
    got = ours(I.ema(I.with_bar_no(bars), "close", n, "e"), "e").e
    want = bars_pd.groupby(KEY).close.transform(lambda s: s.ewm(span=n, adjust=False).mean())
    same(got, want)


def test_ema_over_a_full_day_of_minutes(spark):
    closes = [100 + np.sin(k / 9) * 3 + k % 7 for k in range(1440)]
    got = ours(I.ema(I.with_bar_no(make_bars(spark, closes, start=0, step=1)), "close", 5, "e"), "e").e
    same(got, pd.Series(closes).ewm(span=5, adjust=False).mean())


@pytest.mark.parametrize("n", [1, 2, 5, 20, 199])
def test_ema_of_any_length_and_size(spark, n):
    k = np.arange(20_000)
    x = 1e12 * (1 + (k * 7919 % 13) / 5)
    long = spark.range(len(k)).select(
        F.lit("T").alias("ticker"), F.lit("2024-01-01").cast("date").alias("session"), F.timestamp_seconds("id").alias("bar_ts"),
        (1e12 * (1 + F.pmod(F.col("id") * 7919, F.lit(13)) / 5)).alias("close"))
    got = ours(I.ema(I.with_bar_no(long), "close", n, "e"), "e").e
    same(got / 1e12, pd.Series(x).ewm(span=n, adjust=False).mean() / 1e12)


def test_rsi(bars, bars_pd):
    def wilder(s):
        d = s.diff()
        g = d.clip(lower=0)[1:].ewm(alpha=1 / 14, adjust=False).mean()
        l = (-d).clip(lower=0)[1:].ewm(alpha=1 / 14, adjust=False).mean()
        return (100 - 100 / (1 + g / l)).reindex(s.index)
    got = ours(I.rsi(I.with_bar_no(bars)), "rsi").rsi
    want = bars_pd.groupby(KEY, group_keys=False).close.apply(wilder).sort_index()
    same(got, want)


def test_macd(bars, bars_pd):
    def line(s):
        return s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    m = bars_pd.groupby(KEY).close.transform(line)
    h = m - m.groupby([bars_pd.ticker, bars_pd.session]).transform(lambda s: s.ewm(span=9, adjust=False).mean())
    got = ours(I.macd(I.with_bar_no(bars)), "macd", "macd_hist")
    same(got.macd, m)
    same(got.macd_hist, h)


def test_streak(spark):
    closes = [11, 12, 9, 8, 10, 11, 12]
    opens = [10, 11, 10, 9, 10, 10, 11]
    got = ours(I.streak(make_bars(spark, closes, opens=opens)), "streak").streak
    assert list(got) == [1, 2, -1, -2, 0, 1, 2]


def test_vwap_and_reclaim(spark):
    bars = I.vwap_dynamics(I.vwap(make_bars(spark, [10, 8, 12], volumes=[100, 100, 200])))
    got = ours(bars, "vwap", "vwap_reclaim", "bars_since_cross")
    same(got.vwap, [10.0, (10 + 8) / 2, (10 * 100 + 8 * 100 + 12 * 200) / 400])
    assert list(got.vwap_reclaim.fillna(0)) == [0, 0, 1]


def test_sequences_are_full_and_masks_repeat(spark, small):
    from barloom.catalog.frame import frame
    from barloom.plans.frame import FRAME, dropout, sequences
    assert len(FRAME) == len(set(FRAME)) == 42
    rows = frame(spark, small).filter(F.col("session") <= "2024-01-04")
    seq = sequences(rows).cache()
    assert seq.filter((F.size("seq") != 30) | F.exists("seq", lambda x: F.size(x) != 42)).count() == 0
    last = seq.join(rows, ["ticker", "session", "bar_ts"])
    assert last.filter(~F.element_at("seq", -1)[FRAME.index("rsi")].eqNullSafe(F.col("rsi"))).count() == 0
    flat = rows.withColumns({c: F.lit(1.0) for c in FRAME})
    shares = dropout(flat).agg(*[F.avg(1 - F.col(c)).alias(c) for c in FRAME]).first()
    assert all(0.05 < s < 0.16 for s in shares) and dropout(flat).exceptAll(dropout(flat.repartition(5))).count() == 0


def test_proxy_score_range_and_weights(spark, small):
    from barloom.catalog.indicators import scored
    s = scored(spark, small)
    low, high = s.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1 + 1e-9
    only_rsi = I.proxy_score(s, {"momentum": 0, "volume": 0, "vwap": 0, "rsi": 1.0, "structure": 0})
    assert {r[0] for r in only_rsi.select("score").distinct().collect()} == {0.0, 1.0}


def test_missing_bars_keep_the_means(spark):
    """Nulls at the start, inside and over block borders against a plain loop."""
    rng = np.random.default_rng(3)
    closes = [None if rng.random() < 0.3 or k < 2 else float(20 + rng.normal()) for k in range(400)]
    bars = make_bars(spark, [1.0] * 400, start=0, step=3).withColumn("_k", F.floor(F.unix_seconds("bar_ts") % 86400 / 180).cast("int"))
    known = spark.createDataFrame(list(enumerate(closes)), "_k int, c double")
    df = I.with_bar_no(bars.join(known, "_k").withColumn("close", F.col("c")))
    got = I.with_emas(df, {"e9": (F.col("close"), 0.2, 0), "now": (F.col("close"), 0.999, 0)}).orderBy("bar_ts").collect()
    want, now = None, None
    for r, c in zip(got, closes):
        if c is not None:
            want, now = (c, c) if want is None else (want + 0.2 * (c - want), now + 0.999 * (c - now))
        assert r.e9 == (want if want is None else pytest.approx(want)) and r.now == (now if now is None else pytest.approx(now))


def test_flat_prices_with_a_gap(spark):
    bars = make_bars(spark, [10.0] * 5)
    gap = bars.withColumn("close", F.when(F.minute("bar_ts") != 10, F.col("close")))
    r = I.rsi(I.emas(I.with_bar_no(gap))).orderBy("bar_ts").collect()
    assert [x.ema5 for x in r] == pytest.approx([10.0] * 5) and r[-1].rsi == 50.0
