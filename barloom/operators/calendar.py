"""Exchange calendar: which instants a session has, in the exchange's own time zone.

A calendar has one row per trading day, ``session, pre_ts, open_ts, close_ts``: instants worked out
from local minutes, so clock changes and half days need no further thought downstream. An instant
belongs to the session of its local date; everything is joined by equality on ``session``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import minutes_between

NEW_YORK = "America/New_York"
PRE, OPEN, CLOSE = 540, 570, 960               # local minutes: scan, open and close


def local_date(ts: str, zone: str = NEW_YORK) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def instant(session: str, minute: str | Column, zone: str = NEW_YORK) -> Column:
    """The instant of a local minute of a day."""
    minute = F.col(minute) if isinstance(minute, str) else minute
    wall = F.timestamp_seconds(F.unix_date(session).cast("long") * 86400 + minute * 60)
    return F.to_utc_timestamp(wall, zone)


def exchange_calendar(days: DataFrame, exceptions: DataFrame | None = None, zone: str = NEW_YORK,
                      pre: int = PRE, opens: int = OPEN, closes: int = CLOSE) -> DataFrame:
    """Calendar of ``days(session)``. Weekends have no session. ``exceptions(session, open_minute,
    close_minute)`` gives days with other hours; a null close minute is a holiday. Needs the session
    time zone UTC, as all of the library."""
    rows = days.select("session").filter(F.col("session").isNotNull()).distinct()
    if exceptions is None:
        rows = rows.withColumns({"open_minute": F.lit(opens), "close_minute": F.lit(closes)})
    else:
        other = exceptions.select("session", F.coalesce("open_minute", F.lit(opens)).alias("open_minute"),
                                  F.coalesce("close_minute", F.lit(-1)).alias("close_minute"))
        rows = rows.join(other, "session", "left").select(
            "session", F.coalesce("open_minute", F.lit(opens)).alias("open_minute"),
            F.coalesce("close_minute", F.lit(closes)).alias("close_minute"))
    return (rows.filter(F.weekday("session") < 5).filter("close_minute > 0")
            .select("session", instant("session", F.col("open_minute") - (opens - pre), zone).alias("pre_ts"),
                    instant("session", "open_minute", zone).alias("open_ts"),
                    instant("session", "close_minute", zone).alias("close_ts")))


def day_range(spark, first: str, last: str) -> DataFrame:
    """All days from ``first`` to ``last``, as ``session``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("session"))


def with_session(rows: DataFrame, ts: str, zone: str = NEW_YORK) -> DataFrame:
    """``session`` of each instant: its date at the exchange, which late in the day is not the UTC date."""
    return rows.withColumn("session", local_date(ts, zone))


def with_phase(rows: DataFrame, calendar: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """``phase`` of each row: premarket, regular or after; null before the premarket and on days
    without a session. ``is_premarket`` follows from it."""
    at = F.col(ts)
    phase = (F.when(at < F.col("pre_ts"), None).when(at < F.col("open_ts"), "premarket")
             .when(at < F.col("close_ts"), "regular").when(F.col("close_ts").isNotNull(), "after"))
    keep = [c for c in rows.columns if c not in ("phase", "is_premarket")]
    return (rows.select(*keep).join(calendar, "session", "left").withColumn("phase", phase)
            .select(*keep, "phase", (F.col("phase") == "premarket").alias("is_premarket")))


def trading_window(bars: DataFrame, calendar: DataFrame, minutes: int = 120) -> DataFrame:
    """Bars that start in the first ``minutes`` of their session, and before its close."""
    end = F.least("close_ts", F.col("open_ts") + F.expr(f"INTERVAL {int(minutes)} MINUTE"))
    known = calendar.select("session", "open_ts", end.alias("_end"))
    return (bars.join(known, "session").filter((F.col("bar_ts") >= F.col("open_ts")) & (F.col("bar_ts") < F.col("_end")))
            .select(*bars.columns))


def with_forced_close(entries: DataFrame, calendar: DataFrame, minutes: int = 120) -> DataFrame:
    """Entries of sessions with ``close_ts``, the instant at which positions are closed by force: the end
    of the trading window, or the close where that is earlier. ``exits`` takes it from there."""
    end = F.least("close_ts", F.col("open_ts") + F.expr(f"INTERVAL {int(minutes)} MINUTE"))
    return entries.join(calendar.select("session", end.alias("close_ts")), "session")


def with_open_minutes(rows: DataFrame, calendar: DataFrame, ts: str = "entry_ts") -> DataFrame:
    """``open_minutes``: minutes from the session's open to each row."""
    keep = [c for c in rows.columns if c != "open_minutes"]
    return (rows.select(*keep).join(calendar.select("session", "open_ts"), "session")
            .select(*keep, minutes_between(ts, "open_ts").alias("open_minutes")))
