"""Candidate scan, entry rule, alerts, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import KEYS


def gap_scan(candidates: DataFrame, gap: tuple[float, float] = (25.0, 50.0),
             min_pm_volume: int = 100_000, price: tuple[float, float] = (1.0, 30.0),
             min_rvol: float = 3.0) -> DataFrame:
    """Premarket candidates; float shares stay a column, not a filter."""
    return candidates.filter(
        F.col("gap_pct").between(*gap) & (F.col("pm_volume") > min_pm_volume)
        & F.col("price").between(*price) & (F.col("rvol") > min_rvol))


def entry_signal(df: DataFrame, gap: tuple[float, float] = (25.0, 50.0), min_rvol: float = 3.0,
                 min_score: float = 0.65, rsi: tuple[float, float] = (50.0, 80.0),
                 warmup_bars: int = 30) -> DataFrame:
    """0/1 signal of the entry rule; the limit on open positions is applied to the
    resulting trades by ``risk_limits``."""
    rule = (F.col("gap_pct").between(*gap) & (F.col("rvol") > min_rvol)
            & (F.col("score") >= min_score) & (F.col("close") > F.col("vwap"))
            & (F.col("close") > F.col("ema9")) & F.col("rsi").between(*rsi)
            & (F.col("volume_spike") == 1) & (F.col("i") >= warmup_bars))
    return df.withColumn("signal", F.coalesce(rule.cast("int"), F.lit(0)))


def alerts(df: DataFrame, threshold: float = 0.65) -> DataFrame:
    return df.filter(F.col("score") > threshold)


def rank_watchlist(df: DataFrame, by: tuple[str, ...] = ("session",), score: str = "score") -> DataFrame:
    """Rank of every candidate within its scan time; ties share a rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc())
    return df.withColumn("rank", F.rank().over(w))


def top_candidates(df: DataFrame, k: int = 3, by: tuple[str, ...] = ("session",),
                   score: str = "score") -> DataFrame:
    """Best ``k`` per scan time. Spark keeps only ``k`` rows per group and task before the
    shuffle, so one crowded scan time is no hot spot."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), "ticker")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
