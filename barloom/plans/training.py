"""Training set, live features and the P&L report as single lazy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import KEYS, features as feat
from ..operators.bars import rollup_bars
from ..operators.dataset import balance
from ..operators.labels import barrier_label, binarize, keep_complete
from ..operators.performance import pnl_by_leg
from ..operators.sessions import event_window, is_anchor, premarket_range, with_fundamentals, with_position
from ..schemas import FEATURES, FINE_LOOKBACK


def coarse_with_fine(fine: DataFrame, fundamentals: DataFrame, coarse_seconds: int) -> DataFrame:
    """Coarse bars carrying the pressure of their last five fine bars.

    Fine windows, roll-up and coarse windows all work on (ticker, session), so after the
    bars exist one exchange serves the whole feature build.
    """
    known, _ = with_fundamentals(fine, fundamentals)
    looked = feat.lookback_fine(feat.with_pressure(known))
    keep = ["float_shares", "high52", "low52", *feat.fine_columns()]
    return rollup_bars(looked, coarse_seconds, carry=keep)


def feature_frame(fine: DataFrame, fundamentals: DataFrame, coarse_seconds: int) -> DataFrame:
    """All 47 features plus label, position and gate columns on every coarse bar."""
    df = feat.with_pressure(coarse_with_fine(fine, fundamentals, coarse_seconds))
    df = feat.running_range(feat.lookback(with_position(df)))
    df = feat.premarket_ratios(feat.with_premarket(df), "batch")
    df = feat.range52_ratios(feat.daily_ratios(df, "open"), "close")
    return barrier_label(feat.with_flags(df))


def labelled_anchors(fine: DataFrame, fundamentals: DataFrame, coarse_seconds: int,
                     strict_event: bool = False) -> DataFrame:
    """Feature rows of all anchors with a soft label."""
    rows = feature_frame(fine, fundamentals, coarse_seconds).filter(is_anchor())
    needed = ["y", *[f"f1_{k}_u" for k in range(FINE_LOOKBACK, 0, -1)]]
    return feat.assemble_features(keep_complete(rows, needed, strict_event))


def build_training_set(fine: DataFrame, log: DataFrame, fundamentals: DataFrame, coarse_seconds: int,
                       session_seconds: int = 9000, threshold: float = 0.7,
                       strict_event: bool = False) -> DataFrame:
    """Events from a log to hard-labelled rows. A held-out set is the same call with
    another log. Each event is its own session, so overlapping events stay apart."""
    inside = (event_window(fine, log, session_seconds)
              .withColumn("session", F.col("start_ts")).drop("start_ts", "end_ts"))
    rows = binarize(labelled_anchors(inside, fundamentals, coarse_seconds, strict_event), threshold)
    return rows.withColumns({"event_ts": F.col("session"), "session": F.to_date("session")})


def balanced_training_set(rows: DataFrame, shift: float = 3.0) -> DataFrame:
    return balance(rows, shift)


def live_features(fine: DataFrame, fundamentals: DataFrame, coarse_seconds: int,
                  premarket: DataFrame | None = None) -> DataFrame:
    """The live variant: regular hours only, newest bar included, failures count as 0.

    ``premarket(ticker, session, pm_high, pm_low)`` is the range as it stood at the open; without it
    the premarket bars of ``fine`` give it. The premarket ratios compare with the bar's close and are 0
    for a session that was first seen after the open.
    """
    premarket = premarket_range(fine) if premarket is None else premarket
    regular = fine.filter(~F.col("is_premarket"))
    df = feat.with_pressure(coarse_with_fine(regular, fundamentals, coarse_seconds), zero_on_failure=True)
    df = feat.running_range(feat.lookback(with_position(df), include_anchor=True), include_anchor=True)
    df = feat.range52_ratios(feat.daily_ratios(df, "close"), "close")
    df = df.join(premarket.select(*KEYS, "pm_high", "pm_low"), KEYS, "left")
    df = feat.premarket_ratios(df, "live", price="close").withColumn("y", F.lit(0.0))
    rows = feat.with_flags(df).filter(F.col("i") + 1 >= 8)
    return feat.assemble_features(rows)


def feature_columns() -> list[str]:
    return list(FEATURES)


def pnl_report(trades: DataFrame) -> DataFrame:
    return pnl_by_leg(trades)
