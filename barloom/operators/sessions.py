"""Session structure: premarket split, previous close, gaps, volumes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import bucket_start, pct_change, ratio
from . import KEYS, session_window

def _days() -> "Window":
    """A ticker's sessions in order. Only used on tables with one row per (ticker,
    session): a group is one ticker's trading days."""
    return Window.partitionBy("ticker").orderBy("session")


# ---------------------------------------------------------------- premarket / regular

def tag_session(bars: DataFrame, open_minute: int) -> DataFrame:
    """Split by clock: a bar is premarket when it starts before minute ``open_minute``."""
    minute = F.hour("bar_ts") * 60 + F.minute("bar_ts")
    return bars.withColumn("is_premarket", minute < open_minute)


def premarket_limit(extended: DataFrame, regular: DataFrame) -> DataFrame:
    """Position in the extended history of the first bar whose volume equals that of the
    first regular bar; the last position when none does."""
    first = regular.groupBy(*KEYS).agg(F.min_by("volume", "bar_ts").alias("_first_volume"))
    pos = F.row_number().over(session_window()) - 1
    return (extended.withColumn("pos", pos)
            .join(first, KEYS)
            .groupBy(*KEYS)
            .agg(F.coalesce(F.min(F.when(F.col("volume") == F.col("_first_volume"), F.col("pos"))),
                            F.max("pos")).alias("premarket_limit")))


def tag_session_by_volume(extended: DataFrame, regular: DataFrame) -> DataFrame:
    """The split by equal volume instead of by clock."""
    pos = F.row_number().over(session_window()) - 1
    return (extended.withColumn("pos", pos)
            .join(premarket_limit(extended, regular), KEYS)
            .withColumn("is_premarket", F.col("pos") < F.col("premarket_limit")))


def premarket_range(bars: DataFrame) -> DataFrame:
    """Premarket high and low per session, NULL for a session without premarket bars."""
    pre = F.col("is_premarket")
    return bars.groupBy(*KEYS).agg(
        F.max(F.when(pre, F.col("high"))).alias("pm_high"),
        F.min(F.when(pre, F.col("low"))).alias("pm_low"))


def premarket_volume(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(F.col("is_premarket"), F.col("volume"))), F.lit(0))
        .alias("pm_volume"))


def trading_window(bars: DataFrame, start_minute: int = 570, end_minute: int = 690,
                   zone: str | None = None) -> DataFrame:
    """Bars starting in [start, end) minutes of the local day; ``zone`` is the exchange's."""
    ts = F.from_utc_timestamp("bar_ts", zone) if zone else F.col("bar_ts")
    minute = F.hour(ts) * 60 + F.minute(ts)
    return bars.filter((minute >= start_minute) & (minute < end_minute))


# ---------------------------------------------------------------- daily level

def daily(bars: DataFrame) -> DataFrame:
    """One row per (ticker, session)."""
    regular = ~F.col("is_premarket")
    return bars.groupBy(*KEYS).agg(
        F.min_by("open", F.when(regular, F.col("bar_ts"))).alias("day_open"),
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        F.max_by("close", "bar_ts").alias("day_close"),
        F.sum("volume").alias("day_volume"))


def prev_close(bars: DataFrame) -> DataFrame:
    """Close of the last bar of the ticker's previous session."""
    last = bars.groupBy(*KEYS).agg(F.max_by("close", "bar_ts").alias("last_close"))
    return last.withColumn("prev_close", F.lag("last_close").over(_days()))


def with_prev_close(bars: DataFrame) -> DataFrame:
    """Bars with the previous session's close. Inner on existing bars, NULL on the first day."""
    return bars.join(prev_close(bars).select(*KEYS, "prev_close"), KEYS, "left")


def gap_pct(bars: DataFrame) -> DataFrame:
    """Regular-hours open against the previous close, in percent."""
    day = daily(bars)
    prev = F.lag("day_close").over(_days())
    return (day.withColumn("prev_close", prev)
            .withColumn("gap_pct", pct_change("day_open", F.col("prev_close"))))


def relative_volume(day: DataFrame, n: int = 20, volume: str = "day_volume") -> DataFrame:
    """Day volume over the mean of the ticker's previous ``n`` sessions."""
    mean = F.avg(volume).over(_days().rowsBetween(-n, -1))
    return day.withColumn("rvol", ratio(volume, mean))


def cum_volume_ratio(bars: DataFrame, seconds: int, n: int = 20) -> DataFrame:
    """Cumulative session volume against its mean at the same time of day over the ticker's
    previous ``n`` sessions, on bars of a grid of ``seconds``.

    A session that was quiet at that time counts with what it had traded by then: its bars, at most
    one per slot, become a map, and every slot of the day carries the running sum.
    """
    slot = F.floor((F.hour("bar_ts") * 3600 + F.minute("bar_ts") * 60 + F.second("bar_ts")) / seconds) * seconds
    held = F.map_from_entries(F.collect_list(F.struct(slot.alias("slot"), F.struct("bar_ts", "volume").alias("bar"))))
    grid = (bars.groupBy(*KEYS).agg(held.alias("_bars"))
            .select(*KEYS, "_bars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(86400 - seconds).cast("long"), F.lit(seconds).cast("long"))).alias("slot"))
            .withColumn("_bar", F.try_element_at("_bars", F.col("slot"))))
    so_far = Window.partitionBy(*KEYS).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    same_time = Window.partitionBy("ticker", "slot").orderBy("session").rowsBetween(-n, -1)
    return (grid.select(*KEYS, "slot", F.col("_bar.bar_ts").alias("bar_ts"), F.col("_bar.volume").alias("volume"))
            .withColumn("cum_volume", F.coalesce(F.sum("volume").over(so_far), F.lit(0)))
            .withColumn("expected_cum_volume", F.avg("cum_volume").over(same_time))
            .filter(F.col("bar_ts").isNotNull())
            .withColumns({"minute": (F.col("slot") / 60).cast("int"),
                          "cum_volume_ratio": ratio("cum_volume", "expected_cum_volume")}).drop("slot"))


# ---------------------------------------------------------------- gates

def with_position(bars: DataFrame) -> DataFrame:
    """``i`` counts regular bars from 0 (NULL on premarket bars), ``n`` is their number."""
    regular = F.when(~F.col("is_premarket"), 1)
    w = session_window().rowsBetween(Window.unboundedPreceding, 0)
    return (bars
            .withColumn("i", F.when(~F.col("is_premarket"), F.count(regular).over(w) - 1).cast("int"))
            .withColumn("n", F.count(regular).over(Window.partitionBy(*KEYS)).cast("int")))


def is_anchor(lookback: int = 8, extra: int = 10) -> Column:
    """8 <= i < round(n/2)+10 with banker's rounding, over ``with_position`` columns."""
    return (F.col("i") >= lookback) & (F.col("i") < F.bround(F.col("n") / 2.0, 0) + extra)


def anchors(bars: DataFrame, lookback: int = 8, extra: int = 10) -> DataFrame:
    return with_position(bars).filter(is_anchor(lookback, extra))


def entry_gate(bars: DataFrame, min_bars: int = 8, session_seconds: int = 10800,
               cutoff_seconds: int = 900) -> DataFrame:
    """Regular bars with ``min_bars`` bars gathered, before the entry cut-off. Time runs
    from the first regular bar of the session."""
    first = F.min(F.when(~F.col("is_premarket"), F.col("bar_ts"))).over(Window.partitionBy(*KEYS))
    elapsed = F.unix_seconds("bar_ts") - F.unix_seconds("open_ts")
    return (with_position(bars)
            .withColumn("open_ts", first)
            .filter((F.col("i") + 1 >= min_bars) & (elapsed < session_seconds - cutoff_seconds)))


def until_abandoned(bars: DataFrame, min_gain: float = 10.0) -> DataFrame:
    """Regular bars of a session up to and including the first one that opens at a gain
    on the previous close of ``min_gain`` percent or less. Needs ``prev_close``."""
    weak = (pct_change("open", "prev_close") <= min_gain).cast("int")
    seen = F.max(weak).over(session_window().rowsBetween(Window.unboundedPreceding, -1))
    return (bars.filter(~F.col("is_premarket"))
            .withColumn("_abandoned", F.coalesce(seen, F.lit(0)))
            .filter(F.col("_abandoned") == 0).drop("_abandoned"))


# ---------------------------------------------------------------- range join

def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], ts: str,
               start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Equi-join on ``keys`` plus a time bucket, then ``start <= ts < end`` exactly.

    A range is repeated for each bucket it touches, so a point only meets ranges of its
    own bucket: hash or sort-merge join with spread keys instead of one big group per
    ticker, and nothing needs to fit a broadcast.
    """
    b = int(bucket_seconds)
    lo = F.floor(F.unix_seconds(start) / b)
    hi = F.floor(F.unix_micros(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")) / (b * 1000000))
    spread = (ranges.filter(F.col(start) < F.col(end))
              .withColumn("_bucket", F.explode(F.sequence(lo, hi))))
    located = points.withColumn("_bucket", F.floor(F.unix_seconds(ts) / b))
    return (located.join(spread, [*keys, "_bucket"])
            .filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))
            .drop("_bucket"))


def event_window(bars: DataFrame, log: DataFrame, seconds: int = 9000) -> DataFrame:
    """Bars in [start, start + length) of each logged event, tagged with the event; an
    event logged twice counts once."""
    events = (log.select("ticker", "start_ts").distinct()
              .withColumn("end_ts", F.col("start_ts") + F.expr(f"INTERVAL {int(seconds)} SECOND")))
    return range_join(bars, events, ["ticker"], "bar_ts", "start_ts", "end_ts", seconds)


def restrict_to(bars: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Only bars of the day's candidates."""
    return bars.join(watchlist.select(*KEYS).distinct(), KEYS, "left_semi")


# ---------------------------------------------------------------- side tables

def with_fundamentals(bars: DataFrame, fundamentals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars with fundamentals, bars whose ticker has no float).

    No hint: Spark broadcasts the side table when its size allows it and otherwise
    splits a skewed ticker at run time.
    """
    known = fundamentals.filter(F.col("float_shares").isNotNull())
    return (bars.join(known, "ticker"), bars.join(known, "ticker", "left_anti"))


def with_facts_asof(bars: DataFrame, facts: DataFrame) -> DataFrame:
    """Newest facts dated on or before each session, and days since the earnings date.

    The as-of search runs on (ticker, session), a few hundred rows a year per ticker, and
    its result joins the bars by equality; bars are never grouped by ticker alone.
    """
    cols = [c for c in facts.columns if c not in ("ticker", "as_of")]
    days = bars.select(*KEYS).distinct()
    timeline = (days.select("ticker", F.col("session").alias("_d"), F.lit(1).alias("_kind"),
                            F.lit(None).cast(facts.select(F.struct(*cols)).schema[0].dataType)
                            .alias("_fact"))
                .unionByName(facts.select("ticker", F.col("as_of").alias("_d"),
                                          F.lit(0).alias("_kind"), F.struct(*cols).alias("_fact"))))
    w = (Window.partitionBy("ticker").orderBy("_d", "_kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    known = (timeline.withColumn("_fact", F.last("_fact", ignorenulls=True).over(w))
             .filter(F.col("_kind") == 1)
             .select("ticker", F.col("_d").alias("session"), "_fact"))
    out = (bars.join(known, KEYS, "left")
           .select(*bars.columns, *[F.col("_fact")[c].alias(c) for c in cols]))
    if "earnings_date" in cols:
        out = out.withColumn("days_since_earnings", F.datediff("session", "earnings_date"))
    return out


def with_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Bars with the newest context row of the same session at or before the bar.

    ``context(session, bar_ts, ...)`` is one index's own bars, on any grid. The as-of search
    runs over the distinct bar times of a session, at most one day of them, and plain
    equality on (session, bar_ts) brings its result to the bars of all tickers.
    """
    cols = [c for c in context.columns if c not in ("session", "bar_ts")]
    row = F.struct(*cols)
    times = (bars.select("session", "bar_ts").distinct()
             .withColumn("_row", F.lit(None).cast(context.select(row).schema[0].dataType)))
    facts = context.select("session", "bar_ts", row.alias("_row"))
    w = (Window.partitionBy("session").orderBy("bar_ts", F.col("_row").isNull())
         .rowsBetween(Window.unboundedPreceding, 0))
    known = (times.unionByName(facts).withColumn("_known", F.last("_row", ignorenulls=True).over(w))
             .filter(F.col("_row").isNull()).select("session", "bar_ts", "_known"))
    return (bars.join(known, ["session", "bar_ts"], "left")
            .select(*bars.columns, *[F.col("_known")[c].alias(c) for c in cols]))


def day_return(day: DataFrame, price: str = "day_close") -> DataFrame:
    """Percent change of a daily price on the ticker's previous session."""
    return day.withColumn("day_return", pct_change(price, F.lag(price).over(_days())))


def with_sector_context(day: DataFrame, sectors: DataFrame, value: str, out: str) -> DataFrame:
    """Daily rows with the mean of ``value`` over the ticker's sector that day. A group is one
    sector's tickers of one day; the rows are read and shuffled once."""
    known = day.join(sectors, "ticker")
    return known.withColumn(out, F.avg(value).over(Window.partitionBy("session", "sector")))


def inverted_level(day: DataFrame, col: str = "day_close", n: int = 20) -> DataFrame:
    """A volatility index turned round and scaled by its own last ``n`` sessions: 1 at the
    lowest level, 0 at the highest."""
    w = _days().rowsBetween(-(n - 1), 0)
    top, low = F.max(col).over(w), F.min(col).over(w)
    return day.withColumn("inverted_level", ratio(top - F.col(col), top - low))


def microstructure(bars: DataFrame, fundamentals: DataFrame, facts: DataFrame) -> DataFrame:
    """Log-scaled float, short-interest ratio and days since the last earnings."""
    known, _ = with_fundamentals(bars, fundamentals)
    return with_facts_asof(known, facts).withColumn("log_float", F.log1p("float_shares"))
