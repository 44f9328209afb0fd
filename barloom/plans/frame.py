"""The 42-feature frame of a sequence model: every bar with its indicators, volume profile, market
context and microstructure, and the last bars of it packed as arrays.

Bars are shuffled by (ticker, session) once for all per-bar indicators; tables of one row per ticker and
session, and the context of a bar time, come by equality. The expected volume of a time of day
needs the ticker's other sessions and so a shuffle of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import uniform_hash
from ..operators import KEYS
from ..operators.indicators import indicators, rsi, session_return, with_bar_no
from ..operators.sessions import (cum_volume_ratio, daily, gap_pct, inverted_level, microstructure, relative_volume,
                                  with_context)

PRICE = ["open_vwap", "high_vwap", "low_vwap", "gap_pct", "ema5_dist", "ema9_dist", "ema20_dist", "atr_range",
         "body_ratio", "upper_wick", "lower_wick", "streak"]
VOLUME = ["log_volume", "rvol", "vol_ema5_ratio", "vol_ema10_ratio", "vol_ema20_ratio", "cum_volume_ratio", "spread",
          "vpt", "obv_slope", "mfi"]
VWAP = ["vwap_dist", "vwap_slope", "vwap_touches", "bars_since_cross", "vwap_reclaim"]
MOMENTUM = ["rsi", "macd", "macd_hist", "macd_accel", "roc5", "roc10", "stoch_k", "williams_r"]
CONTEXT = ["index_return", "index_rsi", "sector_return", "fear_level"]
MICRO = ["log_float", "short_ratio", "days_since_earnings"]
#: The close over VWAP is not listed beside ``vwap_dist``, which is the same number less one.
FRAME = PRICE + VOLUME + VWAP + MOMENTUM + CONTEXT + MICRO


def index_context(index: DataFrame) -> DataFrame:
    """Session return and RSI of an index's own bars, by ``session, bar_ts``."""
    return rsi(session_return(with_bar_no(index))).select(
        "session", "bar_ts", F.col("session_return").alias("index_return"), F.col("rsi").alias("index_rsi"))


def fear_level(index: DataFrame) -> DataFrame:
    """Per session the inverted level of a volatility index at its previous session's close."""
    days = inverted_level(daily(index))
    before = F.lag("inverted_level").over(Window.partitionBy("ticker").orderBy("session"))
    return days.select("session", before.alias("fear_level"))


def sector_returns(returns: DataFrame, sectors: DataFrame) -> DataFrame:
    """Bars ``ticker, session, bar_ts`` with the mean session return of their sector at that time: the sector's
    tickers are averaged first, one row per sector and time, and joined back."""
    known = returns.join(sectors, "ticker")
    mean = known.groupBy("session", "bar_ts", "sector").agg(F.avg("session_return").alias("sector_return"))
    return known.join(mean, ["session", "bar_ts", "sector"]).select(*KEYS, "bar_ts", "sector_return")


def model_frame(bars: DataFrame, seconds: int, fundamentals: DataFrame, facts: DataFrame, sectors: DataFrame,
                index: DataFrame, fear: DataFrame) -> DataFrame:
    """``ticker, session, bar_ts`` and the columns of ``FRAME`` for the bars of tickers with a float. ``bars`` is on a
    grid of ``seconds`` and is read several times; ``index`` and ``fear`` are the bars of two market
    indexes. Anything not known, such as a gap on a ticker's first day, is null."""
    per_bar = indicators(bars)
    day = relative_volume(gap_pct(bars)).select(*KEYS, "gap_pct", "rvol")
    slow = microstructure(day, fundamentals, facts).join(fear_level(fear), "session", "left")
    timed = cum_volume_ratio(bars, seconds).select(*KEYS, "bar_ts", "cum_volume_ratio")
    sector = sector_returns(session_return(bars).select(*KEYS, "bar_ts", "session_return"), sectors)
    rows = (per_bar.join(slow, KEYS).join(timed, [*KEYS, "bar_ts"], "left").join(sector, [*KEYS, "bar_ts"], "left"))
    return with_context(rows, index_context(index)).select(
        *KEYS, "bar_ts", "t", *[F.col(c).cast("double").alias(c) for c in FRAME])


def packed(frame: DataFrame, columns: list[str] = FRAME) -> DataFrame:
    """The features of each bar as one array ``x``; unknown ones are null in it."""
    return frame.select(*KEYS, "bar_ts", F.array(*columns).alias("x"))


def sequences(frame: DataFrame, n: int = 30, columns: list[str] = FRAME) -> DataFrame:
    """``seq``, the last ``n`` bars of each bar as an array of feature arrays, oldest first; only full ones."""
    last = Window.partitionBy(*KEYS).orderBy("bar_ts").rowsBetween(-(n - 1), 0)
    return (packed(frame, columns).withColumn("seq", F.collect_list("x").over(last))
            .filter(F.size("seq") == n).drop("x"))


def dropout(frame: DataFrame, rate: float = 0.1, seed: str = "drop", columns: list[str] = FRAME) -> DataFrame:
    """The frame with each feature of each bar set to 0 at ``rate``, for training. The mask is a hash
    of the bar's key and the feature's number: a task that runs again drops the same ones."""
    key = [F.col("ticker"), F.unix_seconds("bar_ts")]
    x = F.transform(F.array(*columns), lambda v, k: F.when(uniform_hash(seed, *key, k) < rate, F.lit(0.0)).otherwise(v))
    rest = [c for c in frame.columns if c not in columns]
    return frame.select(*rest, x.alias("_x")).select(*rest, *[F.col("_x")[k].alias(c) for k, c in enumerate(columns)])
