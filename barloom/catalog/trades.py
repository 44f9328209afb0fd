"""Trade replay and performance reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from ..operators import KEYS, performance as P, sessions as S, trades as TR
from ..operators.calendar import (day_range, exchange_calendar, trading_window, with_forced_close, with_open_minutes, with_phase,
                                  with_session)
from ..runtime import materialize
from ..sources import adapters as A
from .indicators import signals
from .kit import T_WINDOW, VIEWS, final, sql
from .rows import BAR, BAR_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Limits on the half-hour test bars: three bars to hold, a close at 20:00.
LIVE = replace(TR.LIVE, limit_minutes=90)
SPEC = replace(TR.SPEC, close_minute=1200)
MAX_OPEN, DAY_STOP = 2, -0.5

PATH = "PARTITION BY ticker, session, entry_ts ORDER BY bar_ts"
CLOSE_AT = "CAST(e.session AS TIMESTAMP) + INTERVAL 1200 MINUTE"

VIEWS.update({
    "entries": """SELECT ticker, session, bar_ts AS entry_ts, close AS entry_price FROM bars
        WHERE NOT is_premarket AND close > open""",
    "paths": f"""SELECT *, greatest(-2.5, max(pct) OVER ({PATH}) - 2.5) AS trail_level,
        lag(forced) OVER ({PATH}) AS was_forced FROM (
        SELECT e.*, b.bar_ts, b.close, (b.close - entry_price) / entry_price * 100 AS pct,
        (epoch(b.bar_ts) - epoch(entry_ts)) / 60 AS minutes, (epoch(b.bar_ts) - epoch(entry_ts)) / 60 > 90 AS forced
        FROM entries e LEFT JOIN bars b ON e.ticker = b.ticker AND e.session = b.session AND b.bar_ts > e.entry_ts)""",
    "legs": """SELECT ticker, session, entry_ts, entry_price, 2 AS leg,
        min(bar_ts) FILTER (forced OR pct <= trail_level) AS exit_ts,
        arg_min(close, bar_ts) FILTER (forced OR pct <= trail_level) AS exit_price,
        arg_min(pct, bar_ts) FILTER (forced OR pct <= trail_level) AS pct FROM paths GROUP BY 1, 2, 3, 4
        UNION ALL SELECT ticker, session, entry_ts, entry_price, 3 AS leg,
        min(bar_ts) FILTER (forced OR pct <= -2 OR pct >= 3) AS exit_ts,
        arg_min(close, bar_ts) FILTER (forced OR pct <= -2 OR pct >= 3) AS exit_price,
        arg_min(pct, bar_ts) FILTER (forced OR pct <= -2 OR pct >= 3) AS pct FROM paths GROUP BY 1, 2, 3, 4""",
    "posl": """SELECT ticker, session, entry_ts, entry_price,
        CASE WHEN count(exit_ts) = 2 THEN max(exit_ts) END AS exit_ts,
        CASE WHEN count(exit_ts) = 2 THEN avg(pct) END AS pct FROM legs GROUP BY 1, 2, 3, 4""",
    "chain": """SELECT ticker, session, min(entry_ts) AS entry_ts FROM posl GROUP BY 1, 2
        UNION ALL SELECT p.ticker, p.session, min(p.entry_ts) FROM chain c
        JOIN posl q ON c.ticker = q.ticker AND c.session = q.session AND c.entry_ts = q.entry_ts
        JOIN posl p ON c.ticker = p.ticker AND c.session = p.session AND p.entry_ts > q.exit_ts GROUP BY 1, 2""",
    "kept": "SELECT posl.* FROM posl JOIN chain USING (ticker, session, entry_ts)",
    "closed": "SELECT * FROM kept WHERE exit_ts IS NOT NULL",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY entry_ts, ticker) AS rn FROM closed",
    "walk": f"""SELECT session, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x TIMESTAMP, p DOUBLE)[]) AS held,
        CAST(0 AS DOUBLE) AS done, false AS ok FROM ordered GROUP BY session
        UNION ALL SELECT session, rn, CASE WHEN ok THEN list_append(still, {{'x': exit_ts, 'p': pct}}) ELSE still END,
        done2, ok FROM (SELECT *, len(still) < {MAX_OPEN} AND done2 > {DAY_STOP} AS ok FROM (
          SELECT o.session, o.rn, o.exit_ts, o.pct, list_filter(w.held, lambda z: z.x > o.entry_ts) AS still,
          w.done + coalesce(list_sum(list_transform(list_filter(w.held, lambda z: z.x <= o.entry_ts), lambda z: z.p * 0.1)), 0) AS done2
          FROM walk w JOIN ordered o ON o.session = w.session AND o.rn = w.rn + 1))""",
    "spaths": f"""SELECT *, greatest(entry_price, max(close) OVER ({PATH})) AS mark,
        min(CASE WHEN pct <= -3 OR pct >= 3 THEN bar_ts END) OVER (PARTITION BY ticker, session, entry_ts) AS hit,
        arg_min(pct, bar_ts) FILTER (pct <= -3 OR pct >= 3) OVER (PARTITION BY ticker, session, entry_ts) <= -3 AS lost
        FROM (SELECT e.*, b.bar_ts, b.close, (b.close - entry_price) / entry_price * 100 AS pct,
          b.bar_ts >= {CLOSE_AT} AS forced FROM entries e LEFT JOIN bars b ON e.ticker = b.ticker AND e.session = b.session
          AND b.bar_ts > e.entry_ts WHERE e.entry_ts < {CLOSE_AT})""",
    "slegs": """SELECT ticker, session, entry_ts, entry_price, 2 AS leg,
        min(bar_ts) FILTER (forced OR bar_ts = hit) AS exit_ts, arg_min(pct, bar_ts) FILTER (forced OR bar_ts = hit) AS pct
        FROM spaths GROUP BY 1, 2, 3, 4 UNION ALL SELECT ticker, session, entry_ts, entry_price, 3 AS leg,
        min(bar_ts) FILTER (forced OR (lost AND bar_ts = hit) OR (NOT lost AND bar_ts > hit AND close <= mark * 0.975)) AS exit_ts,
        arg_min(pct, bar_ts) FILTER (forced OR (lost AND bar_ts = hit) OR (NOT lost AND bar_ts > hit AND close <= mark * 0.975)) AS pct
        FROM spaths GROUP BY 1, 2, 3, 4""",
    "sposl": """SELECT ticker, session, entry_ts, CASE WHEN count(exit_ts) = 2 THEN max(exit_ts) END AS exit_ts
        FROM slegs GROUP BY 1, 2, 3""",
    "schain": """SELECT ticker, session, min(entry_ts) AS entry_ts FROM sposl GROUP BY 1, 2
        UNION ALL SELECT p.ticker, p.session, min(p.entry_ts) FROM schain c
        JOIN sposl q ON c.ticker = q.ticker AND c.session = q.session AND c.entry_ts = q.entry_ts
        JOIN sposl p ON c.ticker = p.ticker AND c.session = p.session AND p.entry_ts > q.exit_ts GROUP BY 1, 2""",
    "skept": "SELECT sposl.* FROM sposl JOIN schain USING (ticker, session, entry_ts)",
    "daypnl": """SELECT session, coalesce(sum(pct), 0) * 0.1 AS day_pct, count(pct) AS n_trades FROM (SELECT DISTINCT session FROM bars)
        LEFT JOIN closed USING (session) WHERE session BETWEEN (SELECT min(session) FROM closed) AND (SELECT max(session) FROM closed)
        GROUP BY 1""",
    "equity0": "SELECT *, sum(day_pct) OVER (ORDER BY session) AS equity_pct FROM daypnl",
    "equity": "SELECT *, greatest(max(equity_pct) OVER (ORDER BY session), 0) AS peak_pct FROM equity0",
})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


def entries(bars: DataFrame) -> DataFrame:
    return (bars.filter(~F.col("is_premarket") & (F.col("close") > F.col("open")))
            .select(*KEYS, F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price")))


def legs(spark, d, preset: str = "live") -> DataFrame:
    bars = A.stored_bars(spark, d)
    return TR.exits(entries(bars), bars, preset, LIVE if preset == "live" else SPEC)


def kept(spark, d) -> DataFrame:
    return TR.non_overlapping(TR.positions(legs(spark, d)))


def closed(spark, d) -> DataFrame:
    return kept(spark, d).filter(F.col("exit_ts").isNotNull())


PATH_COLS = ["ticker", "d:session", "t:entry_ts", "t:bar_ts", "r:pct", "r:minutes", "b:forced"]
HELD = "FROM paths WHERE bar_ts IS NOT NULL AND NOT coalesce(was_forced, false)"


@query("jn_11_entry_paths", sql(PATH_COLS, HELD))
def _(spark, d):
    bars = A.stored_bars(spark, d)
    paths = TR.entry_paths(TR.with_deadline(entries(bars), LIVE), bars, 5400)
    return final(paths, *KEYS, "entry_ts", "bar_ts", "pct", "minutes", "forced")


@query("wn_08_trail_level", sql(["ticker", "d:session", "t:entry_ts", "t:bar_ts", "r:trail_level"], HELD))
def _(spark, d):
    bars = A.stored_bars(spark, d)
    paths = TR.entry_paths(TR.with_deadline(entries(bars), LIVE), bars, 5400)
    return final(TR.trail_level(paths), *KEYS, "entry_ts", "bar_ts", "trail_level")


LEG_COLS = ["ticker", "d:session", "t:entry_ts", "r:entry_price", "leg", "t:exit_ts", "r:pct"]


@query("wn_09_leg_exits", sql(LEG_COLS + ["r:exit_price"], "FROM legs"))
def _(spark, d):
    out = legs(spark, d)
    return final(out, *KEYS, "entry_ts", "entry_price", "leg", "exit_ts", "pct", "exit_price")


@query("trd_01_exits_live", sql(["leg", "i:n=count(*)", "i:n_closed=count(exit_ts)", "r:sum_pct=sum(pct)"],
                                "FROM legs GROUP BY leg"))
def _(spark, d):
    return final(legs(spark, d).groupBy("leg").agg(
        F.count(F.lit(1)).alias("n"), F.count("exit_ts").alias("n_closed"), F.sum("pct").alias("sum_pct")))


@query("trd_02_exits_spec", sql(LEG_COLS, "FROM slegs"))
def _(spark, d):
    return final(legs(spark, d, "spec"), *KEYS, "entry_ts", "entry_price", "leg", "exit_ts", "pct")


@query("trd_03_non_overlapping", sql(["ticker", "d:session", "t:entry_ts", "t:exit_ts", "r:pct"], "FROM kept"))
def _(spark, d):
    return final(kept(spark, d), *KEYS, "entry_ts", "exit_ts", "pct")


@query("trd_04_risk_limits", sql(["ticker", "d:session", "t:entry_ts", "t:exit_ts", "r:pct"],
                                 "FROM ordered JOIN walk USING (session, rn) WHERE ok"))
def _(spark, d):
    return final(TR.risk_limits(closed(spark, d), MAX_OPEN, DAY_STOP), *KEYS, "entry_ts", "exit_ts", "pct")


FILLED = f"""(SELECT *, lead(bar_ts) OVER ({T_WINDOW}) AS entry_ts, lead(open) OVER ({T_WINDOW}) * 1.0005 AS entry_price
    FROM signals) WHERE signal = 1 AND entry_ts IS NOT NULL"""


@query("jn_10_fills", sql(["ticker", "d:session", "t:bar_ts", "t:entry_ts", "p:entry_price"], f"FROM {FILLED}"))
def _(spark, d):
    return final(TR.fills(signals(spark, d)), *BAR, "entry_ts", "entry_price", places=8)


@query("trd_05_fills_daily", sql(
    ["ticker", "d:session", "i:n_fills=count(*)", "p:cost=sum(entry_price)", "r:commission=0.0::DOUBLE*count(*)"],
    f"FROM {FILLED} GROUP BY ticker, session"))
def _(spark, d):
    f = TR.fills(signals(spark, d))
    return final(f.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_fills"), F.sum("entry_price").alias("cost"),
                                      F.sum("commission").alias("commission")), places=8)


VIEWS.update({
    "bought": f"SELECT ticker, session, entry_ts, entry_price FROM {FILLED}",
    "bpaths": VIEWS["spaths"].replace("FROM entries e", "FROM bought e").replace("b.bar_ts > e.entry_ts", "b.bar_ts >= e.entry_ts"),
    "blegs": VIEWS["slegs"].replace("spaths", "bpaths"),
    "sold": f"""SELECT l.ticker, l.session, l.entry_ts, entry_price, leg, CASE WHEN l.exit_ts IS NOT NULL THEN coalesce(nts, l.exit_ts) END AS exit_ts,
        (coalesce(nopen, n.close) * 0.9995 - entry_price) / entry_price * 100 AS pct FROM blegs l
        LEFT JOIN (SELECT *, lead(bar_ts) OVER ({T_WINDOW}) AS nts, lead(open) OVER ({T_WINDOW}) AS nopen FROM bars) n
        ON l.ticker = n.ticker AND l.session = n.session AND l.exit_ts = n.bar_ts""",
    "bpos": VIEWS["posl"].replace("FROM legs", "FROM sold"),
    "bordered": "SELECT *, row_number() OVER (PARTITION BY session ORDER BY entry_ts, ticker) AS rn FROM bpos",
    "bwalk": f"""SELECT session, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(x TIMESTAMP, p DOUBLE, t VARCHAR)[]) AS held,
        CAST(0 AS DOUBLE) AS done, false AS ok FROM bordered GROUP BY session
        UNION ALL SELECT session, rn, CASE WHEN ok THEN list_append(still, {{'x': exit_ts, 'p': pct, 't': ticker}}) ELSE still END,
        done2, ok FROM (SELECT *, len(list_filter(still, lambda z: z.x IS NULL OR z.x > entry_ts)) < {MAX_OPEN}
            AND len(list_filter(still, lambda z: z.t = ticker)) = 0
            AND done2 + coalesce(list_sum(list_transform(list_filter(still, lambda z: z.x = entry_ts), lambda z: z.p * 0.1)), 0) > {DAY_STOP} AS ok FROM (
          SELECT o.session, o.rn, o.ticker, o.entry_ts, o.exit_ts, o.pct, list_filter(w.held, lambda z: z.x IS NULL OR z.x >= o.entry_ts) AS still,
          w.done + coalesce(list_sum(list_transform(list_filter(w.held, lambda z: z.x < o.entry_ts), lambda z: z.p * 0.1)), 0) AS done2
          FROM bwalk w JOIN bordered o ON o.session = w.session AND o.rn = w.rn + 1))""",
})


def backtest(spark, d) -> DataFrame:
    """Entry rule, fills at the next open, split exits, sells at the next open, and the account's
    rules: one row per position taken."""
    bars = A.stored_bars(spark, d)
    entries = TR.fills(signals(spark, d)).select(*KEYS, "entry_ts", "entry_price", "at_open")
    legs = TR.sell_fills(TR.exits(entries, bars, "spec", SPEC), bars)
    return TR.account_rules(TR.positions(legs), MAX_OPEN, DAY_STOP)


@query("trd_07_backtest", sql(["ticker", "d:session", "t:entry_ts", "p:entry_price", "t:exit_ts", "r:pct"],
                              "FROM bordered JOIN bwalk USING (session, rn) WHERE ok"))
def _(spark, d):
    return final(backtest(spark, d), *KEYS, "entry_ts", "entry_price", "exit_ts", "pct", places=8).withColumn("pct", F.round("pct", 6))


TRADE_COLS = ["ticker", "d:session", "t:entry_ts", "t:exit_ts", "leg", "r:pct", "r:profit=exit_price-entry_price",
              "r:open_minutes=(epoch(entry_ts)-epoch(CAST(session AS TIMESTAMP)))/60-480",
              "r:held_minutes=(epoch(exit_ts)-epoch(entry_ts))/60"]


@query("trd_06_trade_rows", sql(TRADE_COLS, "FROM legs WHERE exit_ts IS NOT NULL"))
def _(spark, d):
    return final(TR.trade_rows(legs(spark, d), 480))


CALENDAR_EXCEPTIONS = "(VALUES (DATE '2024-01-15', NULL::INTEGER, NULL::INTEGER), (DATE '2024-01-19', 570, 780)) x(session, opened, closed)"
LOCAL = "timezone('UTC', timezone('America/New_York', CAST(session AS TIMESTAMP) + to_minutes({})))"
VIEWS.update({
    "cal": f"""SELECT session, {LOCAL.format('coalesce(opened, 570) - 30')} AS pre_ts, {LOCAL.format('coalesce(opened, 570)')} AS open_ts,
        {LOCAL.format('coalesce(closed, 960)')} AS close_at FROM (SELECT DISTINCT session FROM ticks) LEFT JOIN {CALENDAR_EXCEPTIONS} USING (session)
        WHERE isodow(session) < 6 AND session <> DATE '2024-01-15'""",
    "centries": """SELECT b.ticker, session, bar_ts AS entry_ts, close AS entry_price, open_ts, least(close_at, open_ts + INTERVAL 300 MINUTE) AS close_ts
        FROM bars b JOIN cal USING (session) WHERE bar_ts >= open_ts AND close > open""",
    "cpaths": VIEWS["spaths"].replace("FROM entries e", "FROM centries e").replace(CLOSE_AT, "e.close_ts"),
    "clegs": VIEWS["slegs"].replace("spaths", "cpaths"),
})


def january(spark, d) -> DataFrame:
    """New York hours of the market days, with a holiday and a half day."""
    exceptions = spark.createDataFrame([("2024-01-15", None, None), ("2024-01-19", 570, 780)],
                                       "session string, open_minute int, close_minute int")
    return exchange_calendar(A.event_log(spark, d), exceptions.withColumn("session", F.to_date("session")))


@query("flt_02_calendar_split", sql(["ticker", "d:session", "t:bar_ts", "phase"],
    """FROM (SELECT b.ticker, b.session, bar_ts, CASE WHEN bar_ts < pre_ts THEN NULL WHEN bar_ts < open_ts THEN 'premarket'
       WHEN bar_ts < close_at THEN 'regular' WHEN close_at IS NOT NULL THEN 'after' END AS phase
       FROM bars b LEFT JOIN cal USING (session))"""))
def _(spark, d):
    return final(with_phase(A.bars(spark, d), january(spark, d)), *BAR, "phase")


#: Local minutes of shipments, spread over the day; a half day before each Christmas, two holidays.
SHIPPED = """(SELECT CAST(l_shipdate AS TIMESTAMP) + to_minutes((l_orderkey * 37 + l_linenumber * 211) % 1440) AS ts FROM lineitem)"""


@query("flt_02_calendar_phases", sql(
    ["d:session", "phase", "i:n=count(*)", "t:first_ts=min(ts)", "t:last_ts=max(ts)"],
    f"""FROM (SELECT s.*, CASE WHEN ts < {LOCAL.format('540')} OR closed THEN NULL WHEN ts < {LOCAL.format('570')} THEN 'premarket'
       WHEN ts < {LOCAL.format("CASE WHEN month(session) = 12 AND day(session) = 24 THEN 780 ELSE 960 END")} THEN 'regular' ELSE 'after' END AS phase
       FROM (SELECT ts, session, isodow(session) > 5 OR strftime(session, '%m-%d') IN ('12-25', '01-01') AS closed
         FROM (SELECT ts, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS session FROM {SHIPPED})) s) GROUP BY session, phase"""))
def _(spark, d):
    """Sessions and phases over years, on both sides of every clock change and on half days."""
    at = F.col("l_orderkey") * 37 + F.col("l_linenumber") * 211
    rows = A.table(spark, d, "lineitem").select(
        F.timestamp_seconds(F.unix_date(F.to_date("l_shipdate")).cast("long") * 86400 + (at % 1440) * 60).alias("ts"))
    days = day_range(spark, "1990-01-01", "2010-12-31")
    day = F.date_format("session", "MM-dd")
    exceptions = (days.filter(day.isin("12-24", "12-25", "01-01")).select(
        "session", F.lit(570).alias("open_minute"), F.when(day == "12-24", 780).alias("close_minute")))
    phases = with_phase(with_session(rows, "ts"), exchange_calendar(days, exceptions), "ts")
    return final(phases.groupBy("session", "phase").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@query("flt_10_calendar_window", sql(BAR_SQL + "r:close",
    "FROM bars JOIN cal USING (session) WHERE bar_ts >= open_ts AND bar_ts < least(close_at, open_ts + INTERVAL 300 MINUTE)"))
def _(spark, d):
    return final(trading_window(A.bars(spark, d), january(spark, d), 300), *BAR, "close")


@query("trd_02_calendar_close", sql(
    LEG_COLS + ["r:open_minutes=(epoch(entry_ts)-epoch(open_ts))/60"], "FROM clegs JOIN (SELECT session, open_ts FROM cal) USING (session)"))
def _(spark, d):
    """Split exits with the forced close at the end of the window or, on a half day, at the close."""
    bars, cal = A.stored_bars(spark, d), materialize(january(spark, d), "calendar")
    regular = with_phase(bars, cal).filter((F.col("phase").isin("regular", "after")) & (F.col("close") > F.col("open")))
    rows = with_forced_close(regular.select(*KEYS, F.col("bar_ts").alias("entry_ts"), F.col("close").alias("entry_price")), cal, 300)
    out = with_open_minutes(TR.exits(rows, bars, "spec", TR.SPEC), cal)
    return final(out, *KEYS, "entry_ts", "entry_price", "leg", "exit_ts", "pct", "open_minutes")


@query("ag_06_pnl_by_leg", sql(["leg=coalesce(leg, 0)", "r:sum_pct=sum(pct)", "i:n_legs=count(*)"],
       "FROM (SELECT CASE WHEN leg IN (1, 2) THEN leg ELSE 3 END AS leg, pct FROM legs WHERE exit_ts IS NOT NULL) GROUP BY ROLLUP (leg)"))
def _(spark, d):
    return final(P.pnl_by_leg(TR.trade_rows(legs(spark, d))))


@query("wn_26_equity_curve", sql(["d:session", "i:n_trades", "r:day_pct", "r:equity_pct", "r:peak_pct",
                                  "r:drawdown_pct=equity_pct-peak_pct"], "FROM equity"))
def _(spark, d):
    trades = materialize(closed(spark, d), "trades")
    return final(P.equity_curve(trades, days=A.event_log(spark, d)))


PERF = ["i:n_trades", "r:win_rate", "r:avg_win", "r:avg_loss", "r:profit_factor=gross_win/gross_loss", "r:avg_minutes",
        "i:n_days", "r:total_return_pct", "r:annual_return_pct=avg_day*252", "r:sharpe=avg_day/sd*sqrt(252)",
        "r:sortino=avg_day/sqrt(down)*sqrt(252)", "r:max_drawdown_pct", "r:win_loss_ratio=-avg_win/avg_loss",
        "r:trades_per_day=n_trades/n_days"]
PER_TRADE = """(SELECT count(*) AS n_trades, avg(CAST(pct > 0 AS DOUBLE)) AS win_rate, avg(pct) FILTER (pct > 0) AS avg_win,
    avg(pct) FILTER (pct < 0) AS avg_loss, sum(pct) FILTER (pct > 0) AS gross_win, -sum(pct) FILTER (pct < 0) AS gross_loss,
    avg((epoch(exit_ts) - epoch(entry_ts)) / 60) AS avg_minutes FROM closed)"""
PER_DAY = """(SELECT count(*) AS n_days, sum(day_pct) AS total_return_pct, avg(day_pct) AS avg_day, stddev_samp(day_pct) AS sd,
    avg(CASE WHEN day_pct < 0 THEN day_pct * day_pct ELSE 0 END) AS down, min(equity_pct - peak_pct) AS max_drawdown_pct FROM equity)"""


@query("ag_11_performance", sql(PERF, f"FROM {PER_TRADE} CROSS JOIN {PER_DAY}"))
def _(spark, d):
    return final(P.performance(materialize(closed(spark, d), "trades"), days=A.event_log(spark, d)))


@query("ag_12_trade_distribution", sql(
    ["r:hour", "r:weekday", "gap_bucket", "i:n_trades=count(*)", "r:avg_pct=avg(pct)"],
    """FROM (SELECT pct, hour(entry_ts) AS hour, dayofweek(session) + 1 AS weekday, CASE WHEN gap_pct >= -10 AND gap_pct < 0
       THEN '-10-0' WHEN gap_pct >= 0 AND gap_pct < 10 THEN '0-10' ELSE 'other' END AS gap_bucket
       FROM closed JOIN gaps USING (ticker, session)) GROUP BY GROUPING SETS ((hour), (weekday), (gap_bucket))"""))
def _(spark, d):
    gaps = S.gap_pct(A.bars(spark, d)).select(*KEYS, "gap_pct")
    dist = P.trade_distribution(closed(spark, d).join(gaps, KEYS), (-10.0, 0.0, 10.0))
    return final(dist.withColumns({c: F.col(c).cast("double") for c in ("hour", "weekday")}))


@query("ag_13_performance_by_fold", sql(
    ["fold=coalesce(fold, 0)", "i:n_trades=count(*)", "r:sum_pct=sum(pct)", "r:win_rate=avg(CAST(pct > 0 AS DOUBLE))",
     "r:profit_factor=sum(pct) FILTER (pct > 0) / nullif(-sum(pct) FILTER (pct < 0), 0)"],
    "FROM (SELECT *, CASE WHEN day(session) < 8 THEN 1 WHEN day(session) < 16 THEN 2 WHEN day(session) < 24 THEN 3 ELSE 4 END AS fold FROM closed) GROUP BY ROLLUP (fold)"))
def _(spark, d):
    day = F.dayofmonth("session")
    fold = F.when(day < 8, 1).when(day < 16, 2).when(day < 24, 3).otherwise(4)
    return final(P.performance_by_fold(closed(spark, d).withColumn("fold", fold)))


@query("scr_08_evaluate", sql(
    ["ticker", "i:n_trades=count(*)", "r:win_rate=avg(CAST(pct > 0 AS DOUBLE))",
     "r:profit_factor=sum(pct) FILTER (pct > 0) / nullif(-sum(pct) FILTER (pct < 0), 0)",
     "b:passes=avg(CAST(pct > 0 AS DOUBLE)) > 0.5 AND sum(pct) FILTER (pct > 0) / nullif(-sum(pct) FILTER (pct < 0), 0) > 1.0"],
    "FROM closed GROUP BY ticker"))
def _(spark, d):
    trades = materialize(closed(spark, d), "trades")
    return final(P.evaluate(trades, 0.5, 1.0, ["ticker"]))
