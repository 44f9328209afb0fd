"""Training labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import hard_label, pct_change
from . import KEYS, session_window


def barrier_label(bars: DataFrame, up: float = 5.0, down: float = -5.0, horizon: int = 3
                  ) -> DataFrame:
    """First close of the next ``horizon`` bars at or beyond a barrier decides: 1 above,
    0 below, otherwise the last gain scaled to the barrier span. NULL when a bar that is
    still needed does not exist."""
    t = session_window()
    gains = [f"_g{k}" for k in range(1, horizon + 1)]
    df = bars.withColumns({g: pct_change(F.lead("close", k + 1).over(t), "close")
                           for k, g in enumerate(gains)})
    label: Column = F.when(F.lit(False), F.lit(0.0))
    for g in gains:
        label = (label.when(F.col(g).isNull(), F.lit(None).cast("double"))
                 .when(F.col(g) >= up, F.lit(1.0))
                 .when(F.col(g) <= down, F.lit(0.0)))
    soft = (abs(down) + F.col(gains[-1])) / (up + abs(down))
    return df.withColumn("y", label.otherwise(soft)).drop(*gains)


def keep_complete(df: DataFrame, columns: list[str], strict_event: bool = False) -> DataFrame:
    """Rows whose listed columns all exist; with ``strict_event`` a session with one
    incomplete row is dropped as a whole."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    if not strict_event:
        return df.filter(ok)
    whole = F.min(ok.cast("int")).over(Window.partitionBy(*KEYS))
    return df.withColumn("_whole", whole).filter(F.col("_whole") == 1).drop("_whole")


def binarize(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Hard label from the soft one; a second run changes nothing."""
    return df.withColumn("y", hard_label(F.col("y").cast("double"), threshold))


def event_labels(bars: DataFrame, warmup_minutes: int = 30, entry_minutes: int = 30) -> DataFrame:
    """Per session: did the close rise after the warm-up, and how far below the open was
    the lowest low of the first minutes. Time runs from the first regular bar."""
    regular = bars.filter(~F.col("is_premarket"))
    start = F.min("bar_ts").over(Window.partitionBy(*KEYS))
    minutes = (F.unix_seconds("bar_ts") - F.unix_seconds("_start")) / 60
    timed = regular.withColumn("_start", start).withColumn("_m", minutes)
    day = timed.groupBy(*KEYS).agg(
        F.min_by("open", "bar_ts").alias("day_open"),
        F.max_by("close", F.when(F.col("_m") < warmup_minutes, F.col("bar_ts"))).alias("warm_close"),
        F.max_by("close", "bar_ts").alias("day_close"),
        F.min(F.when(F.col("_m") < entry_minutes, F.col("low"))).alias("best_entry"))
    return day.withColumns({
        "continued": (F.col("day_close") > F.col("warm_close")).cast("int"),
        "entry_offset_pct": pct_change("best_entry", "day_open")})
