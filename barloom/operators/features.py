"""The 47 model features of an anchor bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import pressure, ratio
from ..schemas import COARSE_LOOKBACK, FEATURES, FINE_LOOKBACK, LABEL, SCORED
from . import KEYS, session_window


def with_pressure(bars: DataFrame, zero_on_failure: bool = False) -> DataFrame:
    """Adds ``u``, ``w``, ``sq``. With ``zero_on_failure`` an undefined weighted value
    counts as 0, as the live variant does."""
    u, w, sq = pressure("open", "high", "low", "close", "volume", "float_shares")
    if zero_on_failure:
        w = F.coalesce(w, F.lit(0.0))
        sq = w * w
    return bars.withColumns({"u": u, "w": w, "sq": sq})


def lookback(bars: DataFrame, n: int = COARSE_LOOKBACK, include_anchor: bool = False,
             prefix: str = "f5") -> DataFrame:
    """Pressure of the ``n`` bars before each bar (or ending at it); suffix ``n`` is the
    oldest. Only two columns are shifted, the square follows from the weighted one."""
    t = session_window()
    shift = 1 if include_anchor else 0
    cols: dict[str, Column] = {}
    for k in range(n, 0, -1):
        cols[f"{prefix}_{k}_w"] = F.lag("w", k - shift).over(t) if k > shift else F.col("w")
        cols[f"{prefix}_{k}_u"] = F.lag("u", k - shift).over(t) if k > shift else F.col("u")
    out = bars.withColumns(cols)
    return out.withColumns({f"{prefix}_{k}_sq": F.col(f"{prefix}_{k}_w") * F.col(f"{prefix}_{k}_w")
                            for k in range(n, 0, -1)})


def lookback_fine(fine: DataFrame, n: int = FINE_LOOKBACK) -> DataFrame:
    """Pressure of the ``n`` fine bars ending at each fine bar, as ``f1_*`` columns."""
    return lookback(fine, n, include_anchor=True, prefix="f1")


def fine_columns(n: int = FINE_LOOKBACK) -> list[str]:
    return [f"f1_{k}_{s}" for k in range(n, 0, -1) for s in ("w", "u", "sq")]


def align_fine(coarse: DataFrame, fine: DataFrame, coarse_seconds: int, fine_seconds: int,
               mode: str = "asof") -> DataFrame:
    """Coarse bars with their ``f1_*`` columns from independently built fine bars.

    ``asof``: the last five fine bars at or before the coarse bar's end, found as the
    newest fine bar inside it. ``bucket``: only the five grid slots inside the coarse bar.
    ``ratio``: by position over regular bars, with r = fine bars / coarse bars.
    """
    from ..functions.columns import bucket_start
    slots = fine_columns()
    if mode == "asof":
        last = (lookback_fine(fine)
                .withColumn("_b", bucket_start("bar_ts", coarse_seconds))
                .groupBy(*KEYS, "_b")
                .agg(*[F.max_by(c, "bar_ts").alias(c) for c in slots])
                .withColumnRenamed("_b", "bar_ts"))
        return coarse.join(last, [*KEYS, "bar_ts"], "left")
    if mode == "bucket":
        start = bucket_start("bar_ts", coarse_seconds)
        slot = ((F.unix_seconds("bar_ts") - F.unix_seconds("_b")) / fine_seconds).cast("int")
        n = coarse_seconds // fine_seconds
        picked = (fine.withColumn("_b", start).withColumn("_slot", F.lit(n) - slot)
                  .groupBy(*KEYS, "_b")
                  .agg(*[F.max(F.when(F.col("_slot") == k, F.col(s))).alias(f"f1_{k}_{s}")
                         for k in range(FINE_LOOKBACK, 0, -1) for s in ("w", "u", "sq")])
                  .withColumnRenamed("_b", "bar_ts"))
        return coarse.join(picked, [*KEYS, "bar_ts"], "left")
    if mode == "ratio":
        from .sessions import with_position
        c = with_position(coarse).filter(F.col("i").isNotNull())
        f = with_position(fine).filter(F.col("i").isNotNull())
        counts = f.groupBy(*KEYS).agg(F.max("n").alias("_n_fine"))
        r = ratio("_n_fine", "n")
        end = (F.bround(F.col("i") * r, 0) + F.bround(r, 0)).cast("int") - 1
        last = (lookback_fine(f).select(*KEYS, F.col("i").alias("_pos"), *slots))
        return (c.join(counts, KEYS, "left").withColumn("_pos", end)
                .join(last, [*KEYS, "_pos"], "left").drop("_pos", "_n_fine"))
    raise ValueError(f"unknown mode {mode!r}")


def running_range(bars: DataFrame, include_anchor: bool = False) -> DataFrame:
    """Day high and low so far, premarket included: one running frame, not a rescan."""
    w = session_window().rowsBetween(Window.unboundedPreceding, 0 if include_anchor else -1)
    return bars.withColumns({"day_high": F.max("high").over(w), "day_low": F.min("low").over(w)})


def with_premarket(bars: DataFrame) -> DataFrame:
    """Premarket range and the session's first regular bar on every bar. Uses the same
    (ticker, session) partitioning as all other windows, so it adds no shuffle."""
    w = Window.partitionBy(*KEYS)
    pre = F.col("is_premarket")
    regular_ts = F.when(~pre, F.col("bar_ts"))
    return bars.withColumns({
        "pm_high": F.max(F.when(pre, F.col("high"))).over(w),
        "pm_low": F.min(F.when(pre, F.col("low"))).over(w),
        "first_high": F.min_by("high", regular_ts).over(w),
        "first_open": F.min_by("open", regular_ts).over(w)})


def premarket_ratios(df: DataFrame, mode: str = "batch", open_ref: str = "high",
                     price: str = "last_price") -> DataFrame:
    """``batch``: 1-open/pm_high and 1-pm_low/open, both NULL without a premarket high.
    ``live``: 1-last/pm_high and 1-last/pm_low, 0 without a premarket."""
    if mode == "batch":
        ref = F.col("first_high" if open_ref == "high" else "first_open")
        has = F.col("pm_high") > 0
        return df.withColumns({"pm_high_ratio": F.when(has, 1 - ratio(ref, "pm_high")),
                               "pm_low_ratio": F.when(has, 1 - ratio("pm_low", ref))})
    if mode == "live":
        return df.withColumns({
            "pm_high_ratio": F.coalesce(1 - ratio(price, "pm_high"), F.lit(0.0)),
            "pm_low_ratio": F.coalesce(1 - ratio(price, "pm_low"), F.lit(0.0))})
    raise ValueError(f"unknown mode {mode!r}")


def daily_ratios(df: DataFrame, price: str = "open") -> DataFrame:
    return df.withColumns({"day_high_ratio": 1 - ratio(price, "day_high"),
                           "day_low_ratio": 1 - ratio("day_low", price)})


def range52_ratios(df: DataFrame, price: str = "close") -> DataFrame:
    return df.withColumns({"high52_ratio": 1 - ratio(price, "high52"),
                           "low52_ratio": 1 - ratio("low52", price)})


def with_flags(df: DataFrame, good_news: int = 1, earnings: int = 0) -> DataFrame:
    return df.withColumns({"good_news": F.lit(good_news), "earnings": F.lit(earnings)})


def assemble_features(df: DataFrame, keys: tuple[str, ...] = ("ticker", "session", "bar_ts", "i"),
                      label: bool = True) -> DataFrame:
    """The feature row in training-table order."""
    return df.select(*keys, *FEATURES, *([LABEL] if label else []))


def scored_columns(df: DataFrame, keys: tuple[str, ...] = (), label: bool = False) -> DataFrame:
    return df.select(*keys, *SCORED, *([LABEL] if label else []))
