"""Features and watchlist on top of the streaming bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import bucket_start, pct_change, ratio
from ..operators import KEYS
from ..operators.indicators import indicators, proxy_score
from ..operators.scan import gap_scan, rank_watchlist
from ..plans.training import live_features
from .bars import read_upserts, run_foreach


def features_batch(fine_table: str, path: str, fundamentals: DataFrame, coarse_seconds: int,
                   premarket_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """Features of the coarse bars touched by a batch of fine bars.

    The sessions in the batch are read back from the fine-bar table and run through the
    batch operators, so live and training features cannot drift apart and no lookback
    has to be kept in Python state. The batch's own days prune the table's session
    folders at run time, so a batch costs these days and not the history, nor the days
    between an old bar and the newest. ``premarket_path`` holds the premarket range that
    ``stream_premarket`` has written; it no longer changes once a session is open.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = (batch.withColumn("bar_ts", bucket_start("bar_ts", coarse_seconds))
                   .select(*KEYS, "bar_ts").distinct())
        sessions = touched.select(*KEYS).distinct()
        day = (spark.read.schema(batch.schema).parquet(fine_table)
               .join(touched.select("session").distinct(), "session", "left_semi")
               .join(sessions, KEYS, "left_semi"))
        known = None
        if premarket_path:
            known = read_upserts(spark, premarket_path, KEYS).join(sessions, KEYS, "left_semi")
        rows = live_features(day, fundamentals, coarse_seconds, known)
        (rows.join(touched, [*KEYS, "bar_ts"], "left_semi")
         .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))
    return write


def stream_features(fine: DataFrame, fine_table: str, path: str, checkpoint: str,
                    fundamentals: DataFrame, coarse_seconds: int, premarket_path: str | None = None,
                    **trigger) -> StreamingQuery:
    """``fine`` is the stream over ``fine_table``; read the result with ``read_upserts``."""
    fn = features_batch(fine_table, path, fundamentals, coarse_seconds, premarket_path)
    return run_foreach(fine, fn, checkpoint, "append", **trigger)


def stream_candidates(ticks: DataFrame, open_minute: int, watermark: str = "1 hour") -> DataFrame:
    """Premarket volume and last premarket price per ticker and day, for the scan."""
    pre: Column = F.hour("ts") * 60 + F.minute("ts") < open_minute
    return (ticks.withWatermark("ts", watermark)
            .groupBy("ticker", F.window("ts", "1 day").alias("w"))
            .agg(F.sum(F.when(pre, F.col("vol"))).alias("pm_volume"),
                 F.max_by("price", F.when(pre, F.col("ts"))).alias("price"))
            .select("ticker", F.to_date("w.start").alias("session"), "pm_volume", "price"))


def scan_batch(path: str, prior: DataFrame, gap: tuple[float, float], min_pm_volume: int, price: tuple[float, float],
               min_rvol: float) -> Callable[[DataFrame, int], None]:
    """First stage of the watchlist: each batch overwrites its own folder with the changed candidates,
    their gap and relative volume. A ticker that no longer qualifies stays with ``member`` false."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.join(prior, KEYS, "left").withColumns({
            "gap_pct": pct_change("price", "prev_close"), "rvol": ratio("pm_volume", "mean_pm_volume")})
        fits = gap_scan(rows, gap, min_pm_volume, price, min_rvol).select(*KEYS, F.lit(True).alias("member"))
        (rows.join(fits, KEYS, "left").withColumn("member", F.coalesce("member", F.lit(False)))
         .select(*KEYS, "pm_volume", "price", "gap_pct", "rvol", "member")
         .write.mode("overwrite").parquet(f"{path}/scan/batch={batch_id}"))
    return write


def prior_facts(bars: DataFrame, n: int = 20) -> DataFrame:
    """Per (ticker, session) what the scan compares with: the previous close and the mean premarket
    volume of the previous ``n`` sessions. Store it; every trigger of the scan reads it."""
    days = Window.partitionBy("ticker").orderBy("session")
    return (bars.groupBy(*KEYS).agg(
        F.max_by("close", "bar_ts").alias("last_close"),
        F.coalesce(F.sum(F.when(F.col("is_premarket"), F.col("volume"))), F.lit(0)).alias("pm_volume"))
        .select(*KEYS, F.lag("last_close").over(days).alias("prev_close"),
                F.avg("pm_volume").over(days.rowsBetween(-n, -1)).alias("mean_pm_volume")))


def stream_scan(ticks: DataFrame, path: str, checkpoint: str, prior: DataFrame, open_minute: int,
                gap: tuple[float, float] = (25.0, 50.0), min_pm_volume: int = 100_000,
                price: tuple[float, float] = (1.0, 30.0), min_rvol: float = 3.0, **trigger) -> StreamingQuery:
    """Premarket scan; pass ``processingTime="60 seconds"`` for the live cadence."""
    fn = scan_batch(path, prior, gap, min_pm_volume, price, min_rvol)
    return run_foreach(stream_candidates(ticks, open_minute), fn, checkpoint, "update", **trigger)


def members(spark: SparkSession, path: str) -> DataFrame:
    """The candidates that qualify by the newest scan of each."""
    return read_upserts(spark, f"{path}/scan", KEYS).filter("member").drop("member")


def score_batch(bar_table: str, path: str, fundamentals: DataFrame, min_rvol: float) -> Callable[[DataFrame, int], None]:
    """Second stage: score, float and suggested price of the members that a batch of bars touches.

    Only members are read back from the bar table, from the batch's own session folders, and run
    through the batch indicators, so that live and replayed scores agree. The suggested entry is the
    higher of VWAP and EMA9, at most the close.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        watched = members(spark, path).select(*KEYS, "rvol")
        touched = batch.select(*KEYS).distinct().join(watched, KEYS)
        bars = (spark.read.schema(batch.schema).parquet(bar_table)
                .join(touched.select("session").distinct(), "session", "left_semi").join(touched, KEYS))
        scored = proxy_score(indicators(bars), min_rvol=min_rvol).filter(~F.col("is_premarket"))
        entry = F.least(F.col("close"), F.greatest("vwap", "ema9"))
        newest = scored.groupBy(*KEYS).agg(
            F.max("bar_ts").alias("bar_ts"), F.max_by("score", "bar_ts").alias("score"), F.max_by(entry, "bar_ts").alias("entry_price"))
        (newest.join(fundamentals.select("ticker", "float_shares"), "ticker", "left")
         .select(*KEYS, "bar_ts", "score", "float_shares", "entry_price")
         .write.mode("overwrite").parquet(f"{path}/score/batch={batch_id}"))
    return write


def stream_scores(bars: DataFrame, bar_table: str, path: str, checkpoint: str, fundamentals: DataFrame,
                  min_rvol: float = 3.0, **trigger) -> StreamingQuery:
    """``bars`` is the stream over ``bar_table``, which has a folder per session; ``path`` is the
    scan's. Start it after the scan has written once, with ``processingTime="60 seconds"`` live."""
    return run_foreach(bars, score_batch(bar_table, path, fundamentals, min_rvol), checkpoint, "append", **trigger)


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """The members with their newest score, float and suggested price, ranked by score in each session."""
    scores = read_upserts(spark, f"{path}/score", KEYS)
    return rank_watchlist(members(spark, path).join(scores, KEYS))
