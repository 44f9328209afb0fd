"""Trade replay as table work: fills, exits, position rules, trade rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import minutes_between, pct_change
from . import KEYS, session_window
from .sessions import range_join

ENTRY = [*KEYS, "entry_ts"]


@dataclass(frozen=True)
class ExitRules:
    """Percent limits for the two halves of a position."""

    stop: float
    target: float
    trail: float
    limit_minutes: float | None = None     # time limit from the entry
    close_minute: int | None = None        # forced close, minute of the day


LIVE = ExitRules(stop=-2.0, target=3.0, trail=2.5, limit_minutes=15)
SPEC = ExitRules(stop=-3.0, target=3.0, trail=2.5, close_minute=690)


def fills(bars: DataFrame, signal: str = "signal", bps: float = 5.0, side: int = 1) -> DataFrame:
    """A signal fills at the next bar's open plus (buy) or minus (sell) slippage, without
    commission; the last bar of a session cannot fill. The position lives from that open on,
    so the fill bar's own close is the first to be tested (``at_open``)."""
    t = session_window()
    filled = bars.withColumns({"entry_ts": F.lead("bar_ts").over(t),
                               "entry_price": F.lead("open").over(t) * (1 + side * bps / 10000.0)})
    return (filled.filter((F.col(signal) == 1) & F.col("entry_ts").isNotNull())
            .withColumns({"commission": F.lit(0.0), "at_open": F.lit(True)}))


def sell_fills(legs: DataFrame, bars: DataFrame, bps: float = 5.0) -> DataFrame:
    """Legs whose exit fills at the next bar's open minus slippage; on the last bar of the
    session at that bar's close minus slippage. ``pct`` is of the filled price."""
    t = session_window()
    nxt = bars.select(*KEYS, F.col("bar_ts").alias("exit_ts"), F.lead("bar_ts").over(t).alias("_ts"),
                      F.lead("open").over(t).alias("_open"))
    price = F.coalesce("_open", "exit_price") * (1 - bps / 10000.0)
    return (legs.join(nxt, [*KEYS, "exit_ts"], "left")
            .withColumns({"exit_price": F.when(F.col("exit_ts").isNotNull(), price),
                          "exit_ts": F.coalesce("_ts", "exit_ts")})
            .withColumn("pct", pct_change("exit_price", "entry_price")).drop("_ts", "_open"))


def with_deadline(entries: DataFrame, rules: ExitRules) -> DataFrame:
    """Last instant at which a position may still be open without a forced exit. Entries with
    ``close_ts`` (``calendar.with_forced_close``) bring the instant of the forced close along."""
    if rules.limit_minutes is not None:
        span = F.expr(f"INTERVAL {int(rules.limit_minutes * 60)} SECOND")
        return entries.withColumn("deadline", F.col("entry_ts") + span)
    close = F.date_trunc("day", "entry_ts") + F.expr(f"INTERVAL {int(rules.close_minute or 0)} MINUTE")
    if "close_ts" in entries.columns:
        close = F.col("close_ts")
    return (entries.filter(F.col("entry_ts") < close)
            .withColumn("deadline", close - F.expr("INTERVAL 1 MICROSECOND")))


def first_bar_after(bars: DataFrame, entries: DataFrame, ts: str = "deadline") -> DataFrame:
    """The first bar of the session strictly after each entry's ``ts``.

    Backward pass over bars and deadlines in one sorted sequence, so a pause in the bars
    of any length costs nothing and is answered exactly.
    """
    marks = entries.select(*KEYS, F.col(ts).alias("_t"), F.lit(1).alias("_kind"),
                           "entry_ts", "entry_price", F.lit(None).cast("double").alias("_close"))
    points = bars.select(*KEYS, F.col("bar_ts").alias("_t"), F.lit(0).alias("_kind"),
                         F.lit(None).cast("timestamp").alias("entry_ts"),
                         F.lit(None).cast("double").alias("entry_price"), F.col("close").alias("_close"))
    w = (Window.partitionBy(*KEYS).orderBy(F.col("_t").desc(), F.col("_kind").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    is_bar = F.col("_kind") == 0
    found = marks.unionByName(points).withColumns({
        "bar_ts": F.last(F.when(is_bar, F.col("_t")), ignorenulls=True).over(w),
        "close": F.last("_close", ignorenulls=True).over(w)})
    return (found.filter((F.col("_kind") == 1) & F.col("bar_ts").isNotNull())
            .select(*ENTRY, "entry_price", "bar_ts", "close"))


def entry_paths(entries: DataFrame, bars: DataFrame, bucket_seconds: int) -> DataFrame:
    """Bars a position lives through: those in (entry, deadline], from the entry's bar on if
    ``at_open``, and the first one after the deadline, flagged ``forced``. Entries meet only bars of the same time bucket, so the output
    is bounded by the holding time, not by the session."""
    tick = F.expr("INTERVAL 1 MICROSECOND")
    start = F.col("entry_ts") + tick
    if "at_open" in entries.columns:         # bought at the bar's open: its close counts
        start = F.when(F.col("at_open"), F.col("entry_ts")).otherwise(start)
    ranges = entries.select(*ENTRY, "entry_price", "deadline", start.alias("_from"),
                            (F.col("deadline") + tick).alias("_to"))
    held = (range_join(bars.select(*KEYS, "bar_ts", "close"), ranges, KEYS, "bar_ts",
                       "_from", "_to", bucket_seconds)
            .select(*ENTRY, "entry_price", "bar_ts", "close", F.lit(False).alias("forced")))
    late = first_bar_after(bars, entries).withColumn("forced", F.lit(True))
    paths = held.unionByName(late)
    return paths.withColumns({"pct": pct_change("close", "entry_price"),
                              "minutes": minutes_between("bar_ts", "entry_ts")})


def _path_window() -> "Window":
    return Window.partitionBy(*ENTRY).orderBy("bar_ts").rowsBetween(Window.unboundedPreceding, 0)


def trail_level(paths: DataFrame, trail: float = 2.5) -> DataFrame:
    """Trailing stop in percent: never below -trail, never falls."""
    best = F.max("pct").over(_path_window()) - trail
    return paths.withColumn("trail_level", F.greatest(best, F.lit(-trail)))


def _first_exits(paths: DataFrame, conditions: dict[int, Column]) -> DataFrame:
    """One row per entry and leg with the first bar meeting the leg's condition. Fixed-width
    buffers and the entry's key alone: hash aggregation on the path window's partitioning."""
    cols = [F.min("entry_price").alias("entry_price")]
    for leg, cond in conditions.items():
        at = F.when(cond, F.col("bar_ts"))
        cols += [F.min(at).alias(f"ts{leg}"), F.min_by("close", at).alias(f"close{leg}"),
                 F.min_by("pct", at).alias(f"pct{leg}")]
    found = paths.groupBy(*ENTRY).agg(*cols)
    legs = F.array(*[F.struct(F.lit(n).alias("leg"), F.col(f"ts{n}").alias("exit_ts"),
                              F.col(f"close{n}").alias("exit_price"), F.col(f"pct{n}").alias("pct"))
                     for n in conditions])
    return found.select(*ENTRY, "entry_price", F.inline(legs))


def leg_exits(paths: DataFrame, rules: ExitRules = LIVE) -> DataFrame:
    """Both legs' first exit under the ``live`` rules: leg 2 on the trailing stop, leg 3 on
    stop or target, either one when the time limit has passed."""
    df = trail_level(paths, rules.trail)
    limits = (F.col("pct") <= rules.stop) | (F.col("pct") >= rules.target)
    return _first_exits(df, {2: F.col("forced") | (F.col("pct") <= F.col("trail_level")),
                             3: F.col("forced") | limits})


def leg_exits_spec(paths: DataFrame, rules: ExitRules = SPEC) -> DataFrame:
    """Split exit: half at target or stop; a stop closes everything; after a profit the
    rest trails the high-water mark; the forced bar closes what is left."""
    w = _path_window()
    stopped = F.col("pct") <= rules.stop
    gained = F.col("pct") >= rules.target
    first_hit = F.min(F.when(stopped | gained, F.col("bar_ts"))).over(w)
    df = paths.withColumns({
        "_mark": F.greatest(F.max("close").over(w), F.col("entry_price")),
        "_hit": first_hit,
        "_lost": F.min_by(stopped, F.when(stopped | gained, F.col("bar_ts"))).over(w)})
    trailed = F.col("close") <= F.col("_mark") * (1 - rules.trail / 100.0)
    after = F.col("bar_ts") > F.col("_hit")
    return _first_exits(df, {
        2: F.col("forced") | stopped | gained,
        3: (F.col("forced") | (F.col("_lost") & (F.col("bar_ts") == F.col("_hit")))
            | (~F.col("_lost") & after & trailed))})


def exits(entries: DataFrame, bars: DataFrame, preset: str = "live",
          rules: ExitRules | None = None) -> DataFrame:
    """Exit of each leg of each entry; NULL exit when the session ends first, also for an
    entry without any later bar.

    Under the ``live`` rules an entry meets the bars of its holding time only. Under ``spec``
    it is held until the close, so entries and bars of a session are walked once
    together instead (``spec_walk``).
    """
    rules = rules or {"live": LIVE, "spec": SPEC}[preset]
    dated = with_deadline(entries, rules)
    if preset == "spec":
        return spec_walk(dated, bars, rules)
    bucket = int((rules.limit_minutes or 120) * 60)
    legs = leg_exits(entry_paths(dated, bars, bucket), rules)
    every = dated.select(*ENTRY, "entry_price", F.explode(F.array(F.lit(2), F.lit(3))).alias("leg"))
    return every.join(legs.drop("entry_price"), [*ENTRY, "leg"], "left").select(
        *ENTRY, "entry_price", "leg", "exit_ts", "exit_price", "pct")


def spec_walk(dated: DataFrame, bars: DataFrame, rules: ExitRules = SPEC) -> DataFrame:
    """Both legs' exits under the split rules, bars of a session in time order, each open
    position updated by each bar: memory is the open positions, no path is written out.

    The work is one small Arrow group per (ticker, session), at most a day of bars.
    """
    at_open = F.col("at_open") if "at_open" in dated.columns else F.lit(False)
    marks = dated.select(*KEYS, F.col("entry_ts").alias("ts"), F.col("entry_price").alias("price"),
                         F.when(at_open, 0).otherwise(2).alias("kind"), F.unix_micros("deadline").alias("until"))
    points = bars.select(*KEYS, F.col("bar_ts").alias("ts"), F.col("close").alias("price"), F.lit(1).alias("kind"),
                         F.lit(None).cast("long").alias("until"))
    rows = marks.unionByName(points).withColumn("micros", F.unix_micros("ts"))
    stop, target, trail = rules.stop, rules.target, rules.trail

    def walk(key, pdf):
        import pandas as pd

        held, out = [], []
        for r in pdf.sort_values(["micros", "kind"], kind="stable").itertuples():
            if r.kind != 1:
                # entry, price, deadline, high mark, first half out, exits of the two halves
                held.append([r.ts, r.price, int(r.until), r.price, False, None, None])
                continue
            left = []
            for h in held:
                pct = (r.price - h[1]) / h[1] * 100
                h[3] = max(h[3], r.price)
                forced, here = r.micros > h[2], (r.ts, r.price, pct)
                if not h[4]:
                    if forced or pct <= stop or pct >= target:
                        h[4], h[5] = True, here
                        if forced or pct <= stop:
                            h[6] = here
                elif forced or r.price <= h[3] * (1 - trail / 100.0):
                    h[6] = here
                if h[6] is None:
                    left.append(h)
                else:
                    out.append(h)
            held = left
        rows = [(*key, h[0], h[1], leg, *(h[4 + leg - 1] or (pd.NaT, None, None)))
                for h in out + held for leg in (2, 3)]
        return pd.DataFrame(rows, columns=["ticker", "session", "entry_ts", "entry_price", "leg",
                                           "exit_ts", "exit_price", "pct"])

    return rows.groupBy(*KEYS).applyInPandas(
        walk, "ticker string, session date, entry_ts timestamp, entry_price double, leg int, "
              "exit_ts timestamp, exit_price double, pct double")


def positions(legs: DataFrame) -> DataFrame:
    """One row per entry: closed when both legs are, result the mean of the two halves.
    A position that is still open at the end of its session has a NULL exit."""
    both = F.count("exit_ts") == 2
    return legs.groupBy(*ENTRY).agg(
        F.min("entry_price").alias("entry_price"),
        F.when(both, F.max("exit_ts")).alias("exit_ts"),
        F.when(both, F.avg("pct")).alias("pct"))


def non_overlapping(trades: DataFrame) -> DataFrame:
    """At most one open position per ticker: in entry order a trade is kept when the one
    kept before it closed on an earlier bar; one without an exit blocks the rest of the
    day. The folded array is one ticker's entries of one day, never more than the day
    has bars."""
    row = F.struct("entry_ts", "exit_ts", "entry_price", "pct")
    kind = trades.select(row.alias("r")).schema["r"].dataType.simpleString()
    folded = trades.groupBy(*KEYS).agg(F.array_sort(F.collect_list(row)).alias("all"))
    kept = F.expr(f"""
        aggregate(all,
          named_struct('busy', cast(null as timestamp), 'out', cast(array() as array<{kind}>)),
          (acc, e) -> if(acc.busy is null or e.entry_ts > acc.busy,
                         named_struct('busy', coalesce(e.exit_ts, timestamp'9999-12-31'),
                                      'out', array_append(acc.out, e)), acc),
          acc -> acc.out)""")
    return folded.select(*KEYS, F.inline(kept))


def risk_limits(trades: DataFrame, max_open: int = 5, day_stop_pct: float = -5.0,
                size_pct: float = 10.0) -> DataFrame:
    """At most ``max_open`` positions at once over all tickers, none after the realized
    day result falls to ``day_stop_pct`` of equity (each trade risks ``size_pct`` of it).

    A position without an exit keeps its slot for the rest of the day. At one instant at most ``max_open`` entries can be accepted, in ticker order, so
    later ones of that instant are dropped first. That is exact, happens before the
    shuffle (window group limit), and bounds a day's array by instants times
    ``max_open``, whatever the number of tickers.
    """
    turn = Window.partitionBy("session", "entry_ts").orderBy("ticker")
    able = trades.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= max_open)
    row = F.struct("entry_ts", "ticker", "exit_ts", "entry_price", "pct")
    kind = able.select(row.alias("r")).schema["r"].dataType.simpleString()
    day = able.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("all"))
    kept = F.expr(f"""
        aggregate(all,
          named_struct('open', cast(array() as array<{kind}>), 'done', 0.0D,
                       'out', cast(array() as array<{kind}>)),
          (acc, e) -> transform(array(named_struct(
              'open', filter(acc.open, x -> x.exit_ts is null or x.exit_ts > e.entry_ts),
              'done', acc.done + aggregate(filter(acc.open, x -> x.exit_ts <= e.entry_ts), 0.0D,
                                           (s, x) -> s + x.pct * {size_pct / 100.0}D),
              'out', acc.out)),
            s -> if(size(s.open) < {max_open} and s.done > {day_stop_pct}D,
                    named_struct('open', array_append(s.open, e), 'done', s.done,
                                 'out', array_append(s.out, e)), s))[0],
          acc -> acc.out)""")
    return day.select("session", F.inline(kept))


def account_rules(trades: DataFrame, max_open: int = 5, day_stop_pct: float = -5.0, size_pct: float = 10.0
                  ) -> DataFrame:
    """One open position per ticker, at most ``max_open`` over all, none after the day stop: one
    fold per session, so an entry that the account refuses does not block its ticker.

    A ticker may enter again on a bar after its exit, not on the exit's own bar. Of the
    entries of one instant that exit later, only the first in ticker order matter:
    ``max_open`` acceptable ones, and at most ``max_open`` others whose ticker is open or
    closed at that very instant. Twice that many are kept before the fold. An entry that
    exits on its own bar holds no slot, so all of these stay in it.
    """
    holds = F.col("exit_ts").isNull() | (F.col("exit_ts") > F.col("entry_ts"))
    turn = Window.partitionBy("session", "entry_ts", holds).orderBy("ticker")
    able = (trades.withColumn("_turn", F.row_number().over(turn))
            .filter(~holds | (F.col("_turn") <= 2 * max_open)).drop("_turn"))
    row = F.struct("entry_ts", "ticker", "exit_ts", "entry_price", "pct")
    kind = able.select(row.alias("r")).schema["r"].dataType.simpleString()
    day = able.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("all"))
    kept = F.expr(f"""
        aggregate(all,
          named_struct('open', cast(array() as array<{kind}>), 'done', 0.0D,
                       'out', cast(array() as array<{kind}>)),
          (acc, e) -> transform(array(named_struct(
              'open', filter(acc.open, x -> x.exit_ts is null or x.exit_ts >= e.entry_ts),
              'done', acc.done + aggregate(filter(acc.open, x -> x.exit_ts < e.entry_ts), 0.0D,
                                           (s, x) -> s + x.pct * {size_pct / 100.0}D),
              'out', acc.out)),
            s -> if(size(filter(s.open, x -> x.exit_ts is null or x.exit_ts > e.entry_ts)) < {max_open}
                    and not exists(s.open, x -> x.ticker = e.ticker)
                    and s.done + aggregate(filter(s.open, x -> x.exit_ts = e.entry_ts), 0.0D,
                                           (t, x) -> t + x.pct * {size_pct / 100.0}D) > {day_stop_pct}D,
                    named_struct('open', array_append(s.open, e), 'done', s.done,
                                 'out', array_append(s.out, e)), s))[0],
          acc -> acc.out)""")
    return day.select("session", F.inline(kept))


def trade_rows(legs: DataFrame, open_minute: int = 570) -> DataFrame:
    """Closed legs as trade-history rows: profit, minutes from the open to the entry,
    minutes held, percent, leg."""
    opened = (F.hour("entry_ts") * 60 + F.minute("entry_ts") + F.second("entry_ts") / 60.0) - open_minute
    return (legs.filter(F.col("exit_ts").isNotNull())
            .withColumns({"profit": F.col("exit_price") - F.col("entry_price"),
                          "open_minutes": opened,
                          "held_minutes": minutes_between("exit_ts", "entry_ts")})
            .select(*ENTRY, "exit_ts", "leg", "pct", "profit", "open_minutes", "held_minutes"))
