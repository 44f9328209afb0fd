"""Bars from ticks and quotes, and bar-to-bar operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import bucket_start, ratio, sequence_key
from . import KEYS, session_window


def ohlcv(ticks: DataFrame, seconds: int, premarket: Column | None = None,
          origin: int = 0) -> DataFrame:
    """OHLCV bars from ``ticks(ticker, session, ts, price, vol, event_id)``.

    One hash aggregate with map-side combine: a ticker holding most of the ticks still
    leaves each task as one row per bar. ``premarket`` is a condition on ``bar_ts``.
    """
    key = sequence_key("ts", "event_id")
    bars = (ticks
            .withColumn("bar_ts", bucket_start("ts", seconds, origin))
            .groupBy(*KEYS, "bar_ts")
            .agg(F.min_by("price", key).alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", key).alias("close"),
                 F.sum("vol").alias("volume")))
    return bars.withColumn("is_premarket", F.lit(False) if premarket is None else premarket)


def rollup_bars(fine: DataFrame, seconds: int, origin: int = 0, carry: list[str] | None = None
                ) -> DataFrame:
    """Coarser bars from finer ones, so the ticks are scanned and shuffled once.

    ``carry`` columns take the value they have on the newest fine bar of each coarse bar.
    A coarse bar that straddles the open would mix premarket and regular trade; on a grid
    that does not meet the open it becomes two bars of one start, told apart by the flag.
    """
    return (fine
            .withColumn("coarse_ts", bucket_start("bar_ts", seconds, origin))
            .groupBy(*KEYS, "coarse_ts", "is_premarket")
            .agg(F.min_by("open", "bar_ts").alias("open"),
                 F.max("high").alias("high"),
                 F.min("low").alias("low"),
                 F.max_by("close", "bar_ts").alias("close"),
                 F.sum("volume").alias("volume"),
                 *[F.max_by(c, "bar_ts").alias(c) for c in carry or []])
            .withColumnRenamed("coarse_ts", "bar_ts"))


def quote_bars(quotes: DataFrame, seconds: int) -> DataFrame:
    """Price bars from quotes carrying a cumulative counter, which is kept as its value
    at the start (``total_open``) and the end (``total_close``) of each bar. Failed polls
    (no price) add nothing; a bar of failed polls only is left to ``locf``."""
    key = sequence_key("ts", "seq")
    return (quotes.filter(F.col("last_price").isNotNull())
            .withColumn("bar_ts", bucket_start("ts", seconds))
            .groupBy(*KEYS, "bar_ts")
            .agg(F.min_by("last_price", key).alias("open"),
                 F.max("last_price").alias("high"),
                 F.min("last_price").alias("low"),
                 F.max_by("last_price", key).alias("close"),
                 F.min_by("total_volume", key).alias("total_open"),
                 F.max_by("total_volume", key).alias("total_close")))


def volume_delta(bars: DataFrame) -> DataFrame:
    """Bar volume as the growth of the cumulative total since the previous bar; the first
    bar counts from the total seen at its start."""
    prev = F.lag("total_close").over(session_window())
    return bars.withColumn("volume", F.col("total_close") - F.coalesce(prev, "total_open"))


def locf(bars: DataFrame, seconds: int) -> DataFrame:
    """Fill empty bars between the first and last of a session with the last close.

    Each bar is repeated up to its successor, so no calendar table and no join is needed.
    """
    step = F.expr(f"INTERVAL {int(seconds)} SECOND")
    nxt = F.lead("bar_ts").over(session_window())
    # A successor closer than one step, as on bars off the grid, leaves nothing to fill.
    until = F.when(nxt - step >= F.col("bar_ts"), nxt - step).otherwise(F.col("bar_ts"))
    slots = F.sequence(F.col("bar_ts"), until, step)
    filled = (bars.withColumn("_slots", slots)
              .select("*", F.posexplode("_slots").alias("_pos", "_slot")))
    is_filled = F.col("_pos") > 0
    price = {c: F.when(is_filled, F.col("close")).otherwise(F.col(c)).alias(c)
             for c in ("open", "high", "low")}
    rest = [c for c in bars.columns
            if c not in KEYS + ["bar_ts", "open", "high", "low", "close", "volume"]]
    return filled.select(
        *KEYS, F.col("_slot").alias("bar_ts"), *price.values(), "close",
        F.when(is_filled, F.lit(0)).otherwise(F.col("volume")).cast("long").alias("volume"),
        *rest, is_filled.alias("is_filled"))


def tail_bars(bars: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` bars of each session, with their age (1 = newest)."""
    w = Window.partitionBy(*KEYS).orderBy(F.col("bar_ts").desc())
    return bars.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def merge_bars(*vendors: tuple[str, DataFrame], priority: list[str],
               key: tuple[str, ...] | None = None) -> DataFrame:
    """Union of several vendors' bars, one row per ``key`` by vendor priority. The key is
    ticker, session, bar start and, where the bars have it, ``freq``.

    Written as an aggregate with a numeric rank, so duplicates collapse before the
    shuffle; a key that many vendors share is never sorted as a group. A bar repeated by
    one vendor gives the one with the smallest values, taken as a row.
    """
    rank = {name: i for i, name in enumerate(priority)}
    merged = reduce(DataFrame.unionByName,
                    [df.withColumn("_rank", F.lit(rank[name])) for name, df in vendors])
    key = list(key or [*KEYS, "bar_ts", *[c for c in ("freq",) if c in merged.columns]])
    values = [c for c in merged.columns if c not in key + ["_rank"]]
    best = (merged.groupBy(*key).agg(F.min(F.struct("_rank", *values)).alias("_best"))
            .select(*key, "_best.*"))
    names = F.array(*[F.lit(n) for n in priority])
    return best.withColumn("vendor", F.element_at(names, F.col("_rank") + 1)).drop("_rank")


def bar_counts(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Regular-hours bars per session at both grids and their quotient."""
    both = (coarse.filter(~F.col("is_premarket")).select(*KEYS, F.lit(1).alias("c"), F.lit(0).alias("f"))
            .unionByName(fine.filter(~F.col("is_premarket"))
                         .select(*KEYS, F.lit(0).alias("c"), F.lit(1).alias("f"))))
    return (both.groupBy(*KEYS)
            .agg(F.sum("c").alias("n_coarse"), F.sum("f").alias("n_fine"))
            .withColumn("fine_per_coarse", ratio("n_fine", "n_coarse")))
