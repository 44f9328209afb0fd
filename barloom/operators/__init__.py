"""Batch operators, grouped by the table they work on."""

from pyspark.sql import Window

KEYS = ["ticker", "session"]


def session_window() -> "Window":
    """(ticker, session) ordered by bar time.

    Always used over bars, never over ticks: a group is then at most the number of
    bars in one day, however many rows the busiest ticker has.
    """
    return Window.partitionBy(*KEYS).orderBy("bar_ts")
