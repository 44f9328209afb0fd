"""Projections, filters, joins and the feature windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..operators import KEYS, bars as B, features as FE, labels as L, sessions as S, scan
from ..plans import training as TR
from ..schemas import FEATURES, FINE_LOOKBACK, SCORED
from ..sources import adapters as A
from .kit import COARSE, FINE, OPEN_MINUTE, T_WINDOW, final, lags, sql

QUERIES: dict = {}
SQL: dict[str, str] = {}

BAR = ["ticker", "session", "bar_ts"]
BAR_SQL = "ticker d:session t:bar_ts "


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


def pressed(spark, d) -> DataFrame:
    fine, fund = A.market(spark, d)
    known, _ = S.with_fundamentals(B.rollup_bars(fine, COARSE), fund)
    return FE.with_pressure(known)


def frame(spark, d) -> DataFrame:
    return TR.feature_frame(*A.market(spark, d), COARSE)


def anchors(spark, d) -> DataFrame:
    return TR.labelled_anchors(*A.market(spark, d), COARSE)


# ---------------------------------------------------------------- projections

@query("prj_01_pressure", sql(BAR_SQL + "r:u r:w r:sq=w*w", "FROM pbars"))
def _(spark, d):
    return final(pressed(spark, d), *BAR, "u", "w", "sq")


@query("prj_02_premarket_ratios", sql(
    ["ticker", "d:session", "t:bar_ts", "r:pm_high_ratio", "r:pm_low_ratio"],
    "FROM feats WHERE NOT is_premarket"))
def _(spark, d):
    df = FE.premarket_ratios(FE.with_premarket(A.bars(spark, d)), "batch")
    return final(df.filter(~F.col("is_premarket")), *BAR, "pm_high_ratio", "pm_low_ratio")


@query("prj_03_premarket_ratios_live", sql(
    ["ticker", "d:session", "t:bar_ts", "r:pm_high_ratio=coalesce(1 - close / pm_high, 0)",
     "r:pm_low_ratio=coalesce(1 - close / pm_low, 0)"],
    "FROM bars JOIN pre USING (ticker, session) WHERE NOT is_premarket"))
def _(spark, d):
    df = FE.premarket_ratios(FE.with_premarket(A.bars(spark, d)), "live", price="close")
    return final(df.filter(~F.col("is_premarket")), *BAR, "pm_high_ratio", "pm_low_ratio")


@query("prj_04_daily_ratios", sql(BAR_SQL + "r:day_high_ratio=1-open/day_high r:day_low_ratio=1-day_low/open",
                                  "FROM ranges"))
def _(spark, d):
    return final(FE.daily_ratios(FE.running_range(A.bars(spark, d))), *BAR, "day_high_ratio", "day_low_ratio")


@query("prj_05_range52_ratios", sql(BAR_SQL + "r:high52_ratio=1-close/high52 r:low52_ratio=1-low52/close",
                                    "FROM pbars"))
def _(spark, d):
    fine, fund = A.market(spark, d)
    known, _rest = S.with_fundamentals(B.rollup_bars(fine, COARSE), fund)
    return final(FE.range52_ratios(known), *BAR, "high52_ratio", "low52_ratio")


@query("prj_06_flags", sql(BAR_SQL + "good_news=1 earnings=0", "FROM bars"))
def _(spark, d):
    return final(FE.with_flags(A.bars(spark, d)), *BAR, "good_news", "earnings")


FEATURE_SQL = [c if c in ("good_news", "earnings") else f"r:{c}" for c in FEATURES]


@query("prj_07_feature_row", sql(
    ["ticker", "d:session", "t:bar_ts", "i:i", *FEATURE_SQL, "r:y"], "FROM anchored"))
def _(spark, d):
    return final(anchors(spark, d))


@query("prj_08_scored_columns", sql(["ticker", "d:session", "t:bar_ts", *[f"r:{c}" for c in SCORED], "r:y"],
                                    "FROM anchored"))
def _(spark, d):
    return final(FE.scored_columns(anchors(spark, d), tuple(BAR), label=True))


@query("prj_10_hard_label", sql(BAR_SQL + "y", "FROM hard"))
def _(spark, d):
    return final(L.binarize(anchors(spark, d)), *BAR, "y")


@query("prj_11_pct_change", sql(BAR_SQL + "r:gain_pct=(close-open)/open*100", "FROM bars"))
def _(spark, d):
    return final(A.bars(spark, d).withColumn("gain_pct", C.pct_change("close", "open")), *BAR, "gain_pct")


@query("prj_12_even_quantity", sql(
    ["event_id", "i:quantity=round_even(1000.0 / price, 0) + 2 - (CAST(round_even(1000.0 / price, 0) AS BIGINT) % 2)"],
    "FROM ticks"))
def _(spark, d):
    return final(A.ticks(spark, d).withColumn("quantity", C.even_quantity("price", 1000.0)), "event_id", "quantity")


@query("prj_13_minutes", sql(
    ["event_id", "r:minutes=(CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - epoch(CAST(session AS TIMESTAMP)) - 28800) / 60.0"],
    "FROM ticks"))
def _(spark, d):
    opened = F.col("session").cast("timestamp") + F.expr(f"INTERVAL {OPEN_MINUTE} MINUTE")
    return final(A.ticks(spark, d).withColumn("minutes", C.minutes_between("ts", opened)), "event_id", "minutes")


@query("prj_14_equity_quantity", sql(
    ["event_id", "i:quantity=floor(least(25000.0 * 0.10, 2400.0) / price)"], "FROM ticks"))
def _(spark, d):
    q = C.equity_quantity(F.lit(25000.0), "price", cap=2400.0)
    return final(A.ticks(spark, d).withColumn("quantity", q), "event_id", "quantity")


# ---------------------------------------------------------------- filters

@query("flt_01_event_window", sql(
    ["ticker", "t:bar_ts=f.bar_ts", "t:start_ts", "r:close", "i:volume"],
    """FROM (SELECT f.*, start_ts FROM fine f JOIN log_events e
       ON f.ticker = e.ticker AND f.bar_ts >= e.start_ts AND f.bar_ts < e.start_ts + INTERVAL 9000 SECOND) f"""))
def _(spark, d):
    df = S.event_window(A.fine_bars(spark, d), A.event_log(spark, d))
    return final(df, "ticker", "bar_ts", "start_ts", "close", "volume")


@query("flt_02_session_split", sql(BAR_SQL + "b:is_premarket", "FROM bars"))
def _(spark, d):
    plain = A.bars(spark, d).drop("is_premarket")
    return final(S.tag_session(plain, OPEN_MINUTE), *BAR, "is_premarket")


@query("flt_03_anchors", sql(BAR_SQL + "i:i i:n", "FROM pos WHERE i >= 8 AND i < round_even(n / 2.0, 0) + 10"))
def _(spark, d):
    return final(S.anchors(A.bars(spark, d)), *BAR, "i", "n")


@query("flt_04_entry_gate", sql(BAR_SQL + "i:i", """FROM (SELECT *, min(bar_ts) FILTER (NOT is_premarket)
    OVER (PARTITION BY ticker, session) AS open_ts FROM pos)
    WHERE i + 1 >= 8 AND epoch(bar_ts) - epoch(open_ts) < 36000 - 5400"""))
def _(spark, d):
    return final(S.entry_gate(A.bars(spark, d), 8, 36000, 5400), *BAR, "i")


@query("flt_05_until_abandoned", sql(BAR_SQL + "r:open r:prev_close", f"""FROM (SELECT *,
    max(CASE WHEN (open - prev_close) / prev_close * 100 <= -2 THEN 1 ELSE 0 END) OVER
    ({T_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone
    FROM (SELECT bars.*, prev_close FROM bars JOIN gaps USING (ticker, session)) b WHERE NOT is_premarket)
    WHERE coalesce(gone, 0) = 0"""))
def _(spark, d):
    regular = S.with_prev_close(A.stored_bars(spark, d)).filter(~F.col("is_premarket"))
    return final(S.until_abandoned(regular, -2.0), *BAR, "open", "prev_close")


@query("flt_07_gap_scan", sql("ticker d:session r:gap_pct i:pm_volume r:price=day_open r:rvol r:float_shares",
    """FROM (SELECT r.*, pm_volume, float_shares FROM rvols r JOIN (SELECT ticker, session,
       coalesce(sum(volume) FILTER (is_premarket), 0) AS pm_volume FROM bars GROUP BY 1, 2) v USING (ticker, session)
       JOIN fund USING (ticker))
       WHERE gap_pct BETWEEN 0.5 AND 8 AND pm_volume > 100 AND day_open BETWEEN 1 AND 130 AND rvol > 0.8"""))
def _(spark, d):
    return final(candidates(spark, d), "ticker", "session", "gap_pct", "pm_volume", "price", "rvol", "float_shares")


def candidates(spark, d) -> DataFrame:
    fine, fund = A.market(spark, d)
    bars = B.rollup_bars(fine, COARSE)
    day = S.relative_volume(S.gap_pct(bars))
    found = day.join(S.premarket_volume(bars), KEYS).withColumn("price", F.col("day_open"))
    found = scan.gap_scan(found, gap=(0.5, 8.0), min_pm_volume=100, price=(1.0, 130.0), min_rvol=0.8)
    return found.join(fund, "ticker")


@query("flt_10_trading_window", sql(BAR_SQL + "r:close",
       "FROM bars WHERE hour(bar_ts) * 60 + minute(bar_ts) >= 570 AND hour(bar_ts) * 60 + minute(bar_ts) < 690"))
def _(spark, d):
    return final(S.trading_window(A.bars(spark, d)), *BAR, "close")


# ---------------------------------------------------------------- joins

@query("jn_01_fundamentals", sql(BAR_SQL + "r:close r:high52 r:low52 r:float_shares", "FROM pbars"))
def _(spark, d):
    fine, fund = A.market(spark, d)
    known, _rest = S.with_fundamentals(B.rollup_bars(fine, COARSE), fund)
    return final(known, *BAR, "close", "high52", "low52", "float_shares")


@query("jn_01_rejects", sql(BAR_SQL + "r:close", """FROM bars WHERE ticker NOT IN
       (SELECT ticker FROM fund WHERE float_shares >= 5000000)"""))
def _(spark, d):
    fine, fund = A.market(spark, d)
    thin = fund.withColumn("float_shares", F.when(F.col("float_shares") >= 5000000, F.col("float_shares")))
    _known, rest = S.with_fundamentals(B.rollup_bars(fine, COARSE), thin)
    return final(rest, *BAR, "close")


@query("jn_02_volume_match", sql("ticker d:session i:premarket_limit",
    """FROM (SELECT b.ticker, b.session, coalesce(min(p) FILTER (volume = first_volume), max(p)) AS premarket_limit
       FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY bar_ts) - 1 AS p FROM bars) b
       JOIN (SELECT ticker, session, arg_min(volume, bar_ts) AS first_volume FROM bars
             WHERE NOT is_premarket GROUP BY 1, 2) f USING (ticker, session) GROUP BY 1, 2)"""))
def _(spark, d):
    bars = A.stored_bars(spark, d)
    return final(S.premarket_limit(bars, bars.filter(~F.col("is_premarket"))))


SLOTS = [f"f1_{k}_{s}" for k in range(FINE_LOOKBACK, 0, -1) for s in ("w", "u", "sq")]


def aligned(spark, d, mode: str) -> DataFrame:
    fine, fund = A.market(spark, d)
    pressed_fine = FE.with_pressure(S.with_fundamentals(fine, fund)[0])
    return FE.align_fine(B.rollup_bars(fine, COARSE), pressed_fine, COARSE, FINE, mode)


@query("jn_03_align_fine", sql(["ticker", "d:session", "t:bar_ts", *[f"r:{c}" for c in SLOTS]], "FROM feats"))
def _(spark, d):
    return final(aligned(spark, d, "asof"), *BAR, *SLOTS)


@query("jn_03_align_bucket", sql(
    ["ticker=b.ticker", "d:session=b.session", "t:bar_ts=b.bar_ts"]
    + [f"r:f1_{k}_{s}=max(CASE WHEN 5 - (epoch(f.bar_ts) - epoch(b.bar_ts)) // {FINE} = {k} THEN {e} END)"
       for k in range(5, 0, -1) for s, e in (("w", "f.w"), ("u", "f.u"), ("sq", "f.w * f.w"))],
    f"""FROM bars b LEFT JOIN pfine f ON b.ticker = f.ticker AND b.session = f.session
        AND time_bucket(INTERVAL {COARSE} SECOND, f.bar_ts) = b.bar_ts GROUP BY b.ticker, b.session, b.bar_ts"""))
def _(spark, d):
    return final(aligned(spark, d, "bucket"), *BAR, *SLOTS)


@query("jn_03_align_ratio", sql(
    ["ticker=c.ticker", "d:session=c.session", "t:bar_ts=c.bar_ts", "i:i=c.i"]
    + [f"r:f1_{k}_{s}=f.f1_{k}_{e}" for k in range(5, 0, -1) for s, e in (("w", "w"), ("u", "u"), ("sq", f"w * f.f1_{k}_w"))],
    f"""FROM (SELECT p.*, n_fine / CAST(n AS DOUBLE) AS r FROM pos p JOIN (SELECT ticker, session, count(*) AS n_fine
          FROM fine WHERE NOT is_premarket GROUP BY 1, 2) q USING (ticker, session) WHERE i IS NOT NULL) c
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY bar_ts) - 1 AS p,
                   {lags(['w', 'u'], 5, 1, 'f1')} FROM pfine WHERE NOT is_premarket
                   WINDOW t AS ({T_WINDOW})) f
        ON c.ticker = f.ticker AND c.session = f.session
        AND f.p = CAST(round_even(c.i * r, 0) + round_even(r, 0) AS INTEGER) - 1"""))
def _(spark, d):
    return final(aligned(spark, d, "ratio"), *BAR, "i", *SLOTS)


@query("jn_04_event_join", sql(
    ["ticker", "t:start_ts", "i:n_bars=count(*)", "i:volume=sum(volume)"],
    """FROM (SELECT f.*, start_ts FROM fine f JOIN log_events e
       ON f.ticker = e.ticker AND f.bar_ts >= e.start_ts AND f.bar_ts < e.start_ts + INTERVAL 9000 SECOND)
       GROUP BY ticker, start_ts"""))
def _(spark, d):
    df = S.event_window(A.fine_bars(spark, d), A.event_log(spark, d))
    return final(df.groupBy("ticker", "start_ts").agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume")))


@query("jn_05_prev_close", sql(BAR_SQL + "r:close r:prev_close",
                               "FROM (SELECT bars.*, prev_close FROM bars JOIN gaps USING (ticker, session))"))
def _(spark, d):
    return final(S.with_prev_close(A.stored_bars(spark, d)), *BAR, "close", "prev_close")


@query("jn_07_context", sql(
    ["ticker", "d:session", "t:bar_ts", "r:session_return", "r:index_return"],
    f"""FROM (SELECT r.*, x.session_return AS index_return FROM
        (SELECT *, (close - first_value(open) OVER t) / first_value(open) OVER t * 100 AS session_return
         FROM bars WINDOW t AS ({T_WINDOW})) r
        ASOF LEFT JOIN (SELECT session, bar_ts, (close - first_value(open) OVER t) / first_value(open) OVER t * 100
         AS session_return FROM bars WHERE ticker = 'view' WINDOW t AS ({T_WINDOW})) x
        ON r.session = x.session AND r.bar_ts >= x.bar_ts)"""))
def _(spark, d):
    from ..operators.indicators import session_return
    returns = session_return(A.stored_bars(spark, d))
    index = (returns.filter(F.col("ticker") == "view")
             .select("session", "bar_ts", F.col("session_return").alias("index_return")))
    return final(S.with_context(returns, index), *BAR, "session_return", "index_return")


@query("jn_07_sector_context", sql(
    ["ticker", "sector", "d:session", "r:turnover", "r:sector_turnover"],
    """FROM (SELECT s.*, sector, avg(turnover) OVER (PARTITION BY session, sector) AS sector_turnover FROM supplied s
         JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector FROM supplier
         JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) k ON s.ticker = k.ticker)"""))
def _(spark, d):
    out = S.with_sector_context(A.lineitem_daily(spark, d), A.sectors(spark, d), "turnover", "sector_turnover")
    return final(out, "ticker", "sector", "session", "turnover", "sector_turnover")


@query("jn_07_sector_return", sql(
    ["ticker", "sector", "d:session", "r:day_return", "r:sector_return"],
    """FROM (SELECT *, avg(day_return) OVER (PARTITION BY session, sector) AS sector_return FROM (SELECT s.*, sector,
         (price / lag(price) OVER (PARTITION BY s.ticker ORDER BY session) - 1) * 100 AS day_return
       FROM (SELECT *, turnover / day_volume AS price FROM supplied) s JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector
         FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) k ON s.ticker = k.ticker))"""))
def _(spark, d):
    days = A.lineitem_daily(spark, d).withColumn("price", F.col("turnover") / F.col("day_volume"))
    out = S.with_sector_context(S.day_return(days, "price"), A.sectors(spark, d), "day_return", "sector_return")
    return final(out, "ticker", "sector", "session", "day_return", "sector_return")


@query("jn_07_context_fine", sql(
    BAR_SQL + "r:index_return=x.close",
    """FROM bars b ASOF LEFT JOIN (SELECT session, bar_ts, close FROM fine WHERE ticker = 'view') x
        ON b.session = x.session AND b.bar_ts >= x.bar_ts""").replace("SELECT ticker AS ticker, CAST(CAST(session", "SELECT b.ticker AS ticker, CAST(CAST(b.session")
    .replace("strftime(bar_ts", "strftime(b.bar_ts"))
def _(spark, d):
    index = (A.fine_bars(spark, d).filter(F.col("ticker") == "view")
             .select("session", "bar_ts", F.col("close").alias("index_return")))
    return final(S.with_context(A.stored_bars(spark, d), index), *BAR, "index_return")


@query("jn_08_facts_asof", sql(
    ["ticker", "d:session", "t:bar_ts", "r:short_ratio",
     "i:days_since_earnings=CAST(session AS DATE) - earnings_date"],
    """FROM bars ASOF LEFT JOIN (SELECT ticker, CAST(date_trunc('week', session) AS DATE) AS as_of,
         max(vol) / 100.0 AS short_ratio, CAST(date_trunc('week', session) AS DATE) - length(ticker)::INTEGER AS earnings_date
         FROM ticks GROUP BY ticker, 2) f
       ON bars.ticker = f.ticker AND bars.session >= f.as_of"""
    ).replace("SELECT ticker AS ticker, CAST(CAST(session", "SELECT bars.ticker AS ticker, CAST(CAST(session"))
def _(spark, d):
    df = S.with_facts_asof(A.stored_bars(spark, d), A.facts(spark, d))
    return final(df, *BAR, "short_ratio", "days_since_earnings")


@query("jn_07_inverted_level", sql(
    ["ticker", "d:session", "r:day_close", "r:inverted_level=(top - level) / nullif(top - low, 0)"],
    """FROM (SELECT x.ticker, x.session, x.day_close, v.level, v.top, v.low FROM days x JOIN (SELECT session, day_close AS level,
         max(day_close) OVER w AS top, min(day_close) OVER w AS low FROM days WHERE ticker = 'error'
         WINDOW w AS (PARTITION BY ticker ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) v USING (session))"""))
def _(spark, d):
    day = S.daily(A.stored_bars(spark, d))
    index = S.inverted_level(day.filter(F.col("ticker") == "error")).select("session", "inverted_level")
    return final(day.join(index, "session"), "ticker", "session", "day_close", "inverted_level")


@query("jn_08_microstructure", sql(
    ["ticker=b.ticker", "d:session=b.session", "t:bar_ts", "r:log_float=ln(1 + float_shares)", "r:short_ratio",
     "i:days_since_earnings=CAST(b.session AS DATE) - earnings_date"],
    """FROM pbars b ASOF LEFT JOIN (SELECT ticker, CAST(date_trunc('week', session) AS DATE) AS as_of,
         max(vol) / 100.0 AS short_ratio, CAST(date_trunc('week', session) AS DATE) - length(ticker)::INTEGER AS earnings_date
         FROM ticks GROUP BY ticker, 2) f ON b.ticker = f.ticker AND b.session >= f.as_of"""))
def _(spark, d):
    fine, fund = A.market(spark, d)
    df = S.microstructure(B.rollup_bars(fine, COARSE), fund, A.facts(spark, d))
    return final(df, *BAR, "log_float", "short_ratio", "days_since_earnings")


@query("jn_09_restrict_to", sql(BAR_SQL + "r:close", """FROM bars JOIN
       (SELECT ticker, session FROM gaps WHERE gap_pct BETWEEN 0.5 AND 8) g USING (ticker, session)"""))
def _(spark, d):
    bars = A.stored_bars(spark, d)
    listed = S.gap_pct(bars).filter(F.col("gap_pct").between(0.5, 8.0))
    return final(S.restrict_to(bars, listed), *BAR, "close")


# ---------------------------------------------------------------- feature windows

F5 = [f"f5_{k}_{s}" for k in range(8, 0, -1) for s in ("w", "u", "sq")]
F5_SQL = [f"r:f5_{k}_{s}" if s != "sq" else f"r:f5_{k}_sq=f5_{k}_w*f5_{k}_w" for k in range(8, 0, -1) for s in ("w", "u", "sq")]


@query("wn_01_lookback", sql(["ticker", "d:session", "t:bar_ts", *F5_SQL], "FROM looked"))
def _(spark, d):
    return final(FE.lookback(pressed(spark, d)), *BAR, *F5)


@query("wn_01_lookback_live", sql(["ticker", "d:session", "t:bar_ts", *F5_SQL],
    f"FROM (SELECT *, {lags(['w', 'u'], 8, 1, 'f5')} FROM pbars WINDOW t AS ({T_WINDOW}))"))
def _(spark, d):
    return final(FE.lookback(pressed(spark, d), include_anchor=True), *BAR, *F5)


@query("wn_02_lookback_fine", sql(
    ["ticker", "d:session", "t:bar_ts"] + [f"r:f1_{k}_{s}" if s != "sq" else f"r:f1_{k}_sq=f1_{k}_w*f1_{k}_w" for k in range(5, 0, -1)
                                             for s in ("w", "u", "sq")], "FROM fine_looked"))
def _(spark, d):
    fine = FE.with_pressure(S.with_fundamentals(*A.market(spark, d))[0])
    return final(FE.lookback_fine(fine), *BAR, *FE.fine_columns())


@query("wn_03_running_range", sql(BAR_SQL + "r:day_high r:day_low", "FROM ranges"))
def _(spark, d):
    return final(FE.running_range(A.bars(spark, d)), *BAR, "day_high", "day_low")


@query("wn_04_barrier_label", sql(BAR_SQL + "r:y", "FROM labelled"))
def _(spark, d):
    return final(L.barrier_label(A.bars(spark, d)), *BAR, "y")


@query("wn_05_position", sql(BAR_SQL + "r:i i:n", "FROM pos"))
def _(spark, d):
    return final(S.with_position(A.bars(spark, d)).withColumn("i", F.col("i").cast("double")), *BAR, "i", "n")


@query("wn_27_event_labels", sql(
    "ticker d:session r:entry_offset_pct=(best_entry-day_open)/day_open*100 b:continued=day_close>warm_close",
    """FROM (SELECT ticker, session, arg_min(open, bar_ts) AS day_open, arg_max(close, bar_ts) AS day_close,
         arg_max(close, bar_ts) FILTER (m < 180) AS warm_close, min(low) FILTER (m < 180) AS best_entry
       FROM (SELECT *, (epoch(bar_ts) - min(epoch(bar_ts)) OVER (PARTITION BY ticker, session)) / 60 AS m
             FROM bars WHERE NOT is_premarket) GROUP BY 1, 2)"""))
def _(spark, d):
    return final(L.event_labels(A.bars(spark, d), 180, 180), "ticker", "session", "entry_offset_pct", "continued")


@query("tk_02_tail_bars", sql(BAR_SQL + "r:close i:age", """FROM (SELECT *, row_number() OVER
       (PARTITION BY ticker, session ORDER BY bar_ts DESC) AS age FROM bars) WHERE age <= 8"""))
def _(spark, d):
    return final(B.tail_bars(A.bars(spark, d), 8), *BAR, "close", "age")


@query("training_set", sql(
    ["ticker", "d:session", "t:bar_ts", "i:i", *FEATURE_SQL, "y"], "FROM hard"))
def _(spark, d):
    log = A.event_log(spark, d).withColumn("start_ts", F.col("session").cast("timestamp"))
    fine, fund = A.market(spark, d)
    rows = TR.build_training_set(fine, log, fund, COARSE, 86400)
    return final(rows, *BAR, "i", *FEATURES, "y")
