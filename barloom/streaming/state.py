"""Stateful processors. Their input is bars, not ticks: whatever the tick rate of the
busiest ticker, one (ticker, session) key sees a bounded number of rows a day.

Bars of a key must reach a processor in time order from batch to batch. A stream over the
table that ``stream_ohlcv`` appends to does so: its commits are atomic and follow the
watermark, and a trigger reads whole commits. Do not put ``maxFilesPerTrigger`` on that
second stream, which would split a commit.

With ``watermark`` a state goes a day after its session's last bar in event time, so the states
are the keys of a day or two; rows later than the watermark are then dropped. Without it they
stay, which is for replays whose sessions come in no order of time.

The step functions use nothing of this package, so workers need not have it installed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import KEYS
from ..operators.trades import LIVE, ExitRules


def _timed(bars: DataFrame, watermark: str | None):
    """(the stream, the kind of timeout, a function that sets it for a state whose last bar
    was at a second)."""
    if watermark is None:
        return bars, GroupStateTimeout.NoTimeout, lambda state, last: None

    def expire(state, last: int) -> None:
        state.setTimeoutTimestamp(max((last + 86_400) * 1000, state.getCurrentWatermarkMs() + 1))
    return bars.withWatermark("bar_ts", watermark), GroupStateTimeout.EventTimeTimeout, expire


def stream_volume_delta(bars: DataFrame, watermark: str | None = None) -> DataFrame:
    """Bar volume from a cumulative counter, the last total kept as state across bars."""
    schema = ("ticker string, session date, bar_ts timestamp, open double, high double, "
              "low double, close double, volume long")

    bars, timeout, expire = _timed(bars, watermark)

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, = state.get if state.exists else (None,)
        out, last = [], 0
        for b in pd.concat(list(chunks)).sort_values("bar_ts").itertuples():
            base = b.total_open if total is None else total
            out.append((*key, b.bar_ts, b.open, b.high, b.low, b.close, int(b.total_close - base)))
            total, last = int(b.total_close), int(b.bar_ts.timestamp())
        state.update((total,))
        expire(state, last)
        yield pd.DataFrame(out, columns=["ticker", "session", "bar_ts", "open", "high", "low", "close", "volume"])

    return bars.groupBy(*KEYS).applyInPandasWithState(step, schema, "total long", "append", timeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_fill(bars: DataFrame, seconds: int, close_minute: int = 1440, watermark: str = "0 seconds") -> DataFrame:
    """Bars with volumes from a cumulative counter, on a grid without holes up to the session's close.

    A missing bar is carried (last close, volume 0) once the watermark has passed the end of its
    slot, by a timer of the key; no later bar has to come. A bar in a slot that was carried already
    came too late and is dropped, with its volume left to the next bar. A timer always waits
    until the watermark passes the close, where the state goes.
    """
    session = bars.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = ("ticker string, session date, bar_ts timestamp, open double, high double, "
              "low double, close double, volume long, is_filled boolean")
    names = ["ticker", "session", "bar_ts", "open", "high", "low", "close", "volume", "is_filled"]

    class Fill(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at long, total long, close double")

        def rows(self, key, slots, close) -> list[tuple]:
            return [(*key, pd.Timestamp(t, unit="s"), close, close, close, close, 0, True) for t in slots]

        def wait(self, at: int, old: int | None) -> None:
            """The timer of the first missing slot's end instead of the old one."""
            if old is not None:
                self.handle.deleteTimer((old + 2 * seconds) * 1000)
            self.handle.registerTimer((at + 2 * seconds) * 1000)

        def handleInputRows(self, key, rows, timerValues):
            at, total, close = self.last.get() if self.last.exists() else (None, None, None)
            old, out = at, []
            for b in pd.concat(list(rows)).sort_values("bar_ts").itertuples():
                ts = int(b.bar_ts.timestamp())
                if at is not None and ts <= at:
                    continue
                if at is not None:
                    out += self.rows(key, range(at + seconds, ts, seconds), close)
                volume = int(b.total_close - (b.total_open if total is None else total))
                out.append((*key, b.bar_ts, b.open, b.high, b.low, b.close, volume, False))
                at, total, close = ts, int(b.total_close), float(b.close)
            if at != old:
                self.last.update((at, total, close))
                self.wait(at, old)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if not self.last.exists():
                return
            at, total, close = self.last.get()
            end = int(pd.Timestamp(key[1]).timestamp()) + close_minute * 60
            passed = timerValues.getCurrentWatermarkInMs() // 1000
            slots = range(at + seconds, min(end, passed - seconds + 1), seconds)
            if slots:
                at = slots[-1]
            if at + seconds >= end:
                self.last.clear()
            else:
                self.last.update((at, total, close))
                self.handle.registerTimer((at + 2 * seconds) * 1000)
            yield pd.DataFrame(self.rows(key, slots, close), columns=names)

        def close(self) -> None:
            pass

    return (bars.withWatermark("bar_ts", watermark).groupBy(*KEYS)
            .transformWithStateInPandas(Fill(), schema, "Append", "eventTime"))


def session_timers(bars: DataFrame, min_gain: float = 10.0, session_seconds: int = 10800,
                   cutoff_seconds: int = 900, watermark: str = "1 hour") -> DataFrame:
    """Bars of live sessions with ``can_enter``; needs ``prev_close`` on regular bars.

    A session ends ``session_seconds`` after its first bar, is abandoned after the first
    bar that opens at ``min_gain`` percent or less, and takes no entry in the last
    ``cutoff_seconds``. The state goes when the watermark passes the session's end.
    """
    schema = "ticker string, session date, bar_ts timestamp, open double, close double, can_enter boolean"

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began, abandoned = state.get if state.exists else (None, False)
        out = []
        for b in pd.concat(list(chunks)).sort_values("bar_ts").itertuples():
            at = int(b.bar_ts.timestamp())
            began = at if began is None else began
            if abandoned or at - began > session_seconds:
                continue
            out.append((*key, b.bar_ts, b.open, b.close, at - began < session_seconds - cutoff_seconds))
            if pd.notna(b.prev_close) and (b.open - b.prev_close) / b.prev_close * 100 <= min_gain:
                abandoned = True
        state.update((began, abandoned))
        # A day later no bar of the session can still be on time.
        state.setTimeoutTimestamp(max((began + 86400) * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["ticker", "session", "bar_ts", "open", "close", "can_enter"])

    return bars.withWatermark("bar_ts", watermark).groupBy(*KEYS).applyInPandasWithState(
        step, schema, "began long, abandoned boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_positions(bars: DataFrame, rules: ExitRules = LIVE, watermark: str | None = None) -> DataFrame:
    """Enter on a signal while flat, trail, leave in two legs, re-arm when both are out.

    Takes ``bars(ticker, session, bar_ts, close, signal)``, emits closed legs; the batch
    counterpart is ``exits`` with ``non_overlapping``. Rules with a closing minute are the split
    rules (``spec``): no entry from that minute on, a stop closes both halves, a profit or stop
    the first, and the second then trails the highest close.
    """
    schema = ("ticker string, session date, entry_ts timestamp, entry_price double, leg int, "
              "exit_ts timestamp, exit_price double, pct double")
    trail, stop, target, limit = rules.trail, rules.stop, rules.target, rules.limit_minutes
    closing = rules.close_minute
    bars, timeout, expire = _timed(bars, watermark)

    def step(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # ``level`` is the trailing percentage, or the highest close under the split rules
        entry, price, level, out2, out3 = state.get if state.exists else (None, None, None, False, False)
        rows, at = [], 0
        for b in pd.concat(list(chunks)).sort_values("bar_ts").itertuples():
            at = int(b.bar_ts.timestamp())
            over = closing is not None and at % 86400 // 60 >= closing
            if entry is None:
                if b.signal == 1 and not over:
                    entry, price, out2, out3 = at, float(b.close), False, False
                    level = -trail if closing is None else price
                continue
            pct = (b.close - price) / price * 100
            if closing is None:
                level = max(level, pct - trail)
                late = limit is not None and (at - entry) / 60 > limit
                done = {2: late or pct <= level, 3: late or pct <= stop or pct >= target}
            else:
                level = max(level, float(b.close))
                first = over or pct <= stop or pct >= target
                done = {2: first, 3: (b.close <= level * (1 - trail / 100.0) or over) if out2 else over or pct <= stop}
            for leg, was in ((2, out2), (3, out3)):
                if done[leg] and not was:
                    rows.append((*key, pd.Timestamp(entry, unit="s"), price, leg, b.bar_ts,
                                 b.close, pct))
            out2, out3 = out2 or done[2], out3 or done[3]
            if out2 and out3:
                entry = None
        state.update((entry, price, level, bool(out2), bool(out3)))
        expire(state, at)
        if rows:
            yield pd.DataFrame(rows, columns=["ticker", "session", "entry_ts", "entry_price", "leg",
                                              "exit_ts", "exit_price", "pct"])

    return bars.groupBy(*KEYS).applyInPandasWithState(
        step, schema, "entry long, price double, level double, out2 boolean, out3 boolean",
        "append", timeout)
