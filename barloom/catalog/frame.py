"""The 42-feature frame, its sequences and its dropout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.bars import rollup_bars
from ..plans.frame import FRAME, dropout, model_frame, sequences
from ..runtime import materialize
from ..sources import adapters as A
from .indicators import RUN, TYPICAL, ema, last
from .kit import COARSE, T_WINDOW, VIEWS, final, sql
from .rows import BAR, BAR_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

INDEX, FEAR = "view", "error"          # the two tickers that stand for market indexes

_FLOW = f"""SELECT ticker, session, bar_ts, sum(v1) OVER {RUN} AS vpt, regr_slope(obv, t) OVER {last(10)} AS obv_slope,
    up / nullif(up + dn, 0) * 100 AS mfi FROM (SELECT *, coalesce(volume * (close - p) / p, 0) AS v1,
    sum(coalesce(sign(close - p), 0) * volume) OVER {RUN} AS obv, sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER {last(14)} AS up,
    sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER {last(14)} AS dn
    FROM (SELECT *, lag(tp) OVER ({T_WINDOW}) AS ptp FROM (SELECT *, lag(close) OVER ({T_WINDOW}) AS p, {TYPICAL} AS tp FROM tb)))"""
_ATR = f"""SELECT ticker, session, bar_ts, (high - low) / nullif({ema('tr', 1 / 14)}, 0) AS atr_range FROM (SELECT *, greatest(high - low,
    coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS tr FROM (SELECT *, lag(close) OVER ({T_WINDOW}) AS p FROM tb))"""
_TIMED = f"""SELECT ticker, session, bar_ts, cum_volume / nullif(expected, 0) AS cum_volume_ratio FROM (SELECT *, avg(cum_volume) OVER
    (PARTITION BY ticker, slot ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS expected FROM (
    SELECT g.ticker, g.session, g.slot, b.bar_ts, coalesce(sum(b.volume) OVER (PARTITION BY g.ticker, g.session ORDER BY g.slot), 0) AS cum_volume
    FROM (SELECT ticker, session, unnest(range(0, 86400, {COARSE})) AS slot FROM (SELECT DISTINCT ticker, session FROM bars)) g
    LEFT JOIN bars b ON g.ticker = b.ticker AND g.session = b.session AND epoch(b.bar_ts) % 86400 = g.slot)) WHERE bar_ts IS NOT NULL"""
_BACK = lambda n: f"lag(close, {n}) OVER ({T_WINDOW})"

VIEWS.update({
    "fflow": _FLOW, "fatr": _ATR, "ftimed": _TIMED,
    "freturn": f"""SELECT ticker, session, bar_ts, (close - first_value(open) OVER {RUN}) / first_value(open) OVER {RUN} * 100 AS session_return FROM bars""",
    "fsector": """SELECT ticker, session, bar_ts, avg(session_return) OVER (PARTITION BY session, bar_ts, length(ticker) % 2) AS sector_return FROM freturn""",
    "findex": f"""SELECT session, bar_ts, session_return AS index_return, rsi AS index_rsi FROM freturn JOIN rsis USING (ticker, session, bar_ts)
        WHERE ticker = '{INDEX}'""",
    "ffear": f"""SELECT session, lag((top - day_close) / nullif(top - low, 0)) OVER (ORDER BY session) AS fear_level FROM (SELECT *,
        max(day_close) OVER w AS top, min(day_close) OVER w AS low FROM days WHERE ticker = '{FEAR}'
        WINDOW w AS (ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    "ffacts": """SELECT d.ticker, d.session, short_ratio, CAST(d.session AS DATE) - earnings_date AS days_since_earnings
        FROM (SELECT DISTINCT ticker, session FROM bars) d ASOF LEFT JOIN (SELECT ticker, CAST(date_trunc('week', session) AS DATE) AS as_of,
          max(vol) / 100.0 AS short_ratio, CAST(date_trunc('week', session) AS DATE) - length(ticker)::INTEGER AS earnings_date
          FROM ticks GROUP BY ticker, 2) f ON d.ticker = f.ticker AND d.session >= f.as_of""",
    "fbars": f"""SELECT *, open / vwap AS open_vwap, high / vwap AS high_vwap, low / vwap AS low_vwap,
        {', '.join(f'(close - ema{n}) / ema{n} * 100 AS ema{n}_dist, volume / nullif(vol_ema{n if n != 9 else 10}, 0) AS vol_ema{n if n != 9 else 10}_ratio' for n in (5, 9, 20))},
        abs(close - open) / nullif(high - low, 0) AS body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick,
        (least(open, close) - low) / nullif(high - low, 0) AS lower_wick, ln(1 + volume) AS log_volume, high - low AS spread,
        (close - {_BACK(5)}) / {_BACK(5)} * 100 AS roc5, (close - {_BACK(10)}) / {_BACK(10)} * 100 AS roc10,
        (close - min(low) OVER {last(14)}) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0) * 100 AS stoch_k,
        (max(high) OVER {last(14)} - close) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0) * -100 AS williams_r FROM vdyn""",
    "frame": f"""SELECT ticker, session, bar_ts, t, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FRAME)} FROM (
        SELECT b.*, gap_pct, rvol, atr_range, cum_volume_ratio, vpt, obv_slope, mfi, sector_return, fear_level, ln(1 + 1000000.0 * length(b.ticker)) AS log_float,
          short_ratio, days_since_earnings, x.index_return, x.index_rsi FROM (SELECT * FROM fbars JOIN (SELECT ticker, session, gap_pct, rvol FROM rvols)
          USING (ticker, session) JOIN fatr USING (ticker, session, bar_ts) JOIN ftimed USING (ticker, session, bar_ts) JOIN fflow USING (ticker, session, bar_ts)
          JOIN fsector USING (ticker, session, bar_ts) JOIN ffacts USING (ticker, session) LEFT JOIN ffear USING (session)) b
          ASOF LEFT JOIN findex x ON b.session = x.session AND b.bar_ts >= x.bar_ts)""",
})


def query(name: str, oracle: str):
    def register(fn):
        QUERIES[name], SQL[name] = fn, oracle
        return fn
    return register


def frame(spark, d) -> DataFrame:
    fine, fund = A.market(spark, d)
    bars = materialize(rollup_bars(fine, COARSE), "bars")
    sectors = fund.select("ticker", (F.length("ticker") % 2).cast("string").alias("sector"))
    one = lambda ticker: bars.filter(F.col("ticker") == ticker)
    return model_frame(bars, COARSE, fund, A.facts(spark, d), sectors, one(INDEX), one(FEAR))


@query("wn_25_frame", sql(BAR_SQL.split() + [f"r:{c}" for c in FRAME], "FROM frame"))
def _(spark, d):
    return final(frame(spark, d), *BAR, *FRAME)


STEPS = (1, 15, 30)


@query("wn_25_sequences", sql(
    ["ticker", "d:session", "t:bar_ts", "i:n=30", *[f"r:{c}_{s}=lag({c}, {30 - s}) OVER ({T_WINDOW})" for c in FRAME for s in STEPS]],
    "FROM frame QUALIFY t >= 29"))
def _(spark, d):
    """All 42 features of three of the 30 steps of every full sequence."""
    rows = sequences(frame(spark, d))
    return final(rows.select(*BAR, F.size("seq").cast("long").alias("n"),
                             *[F.col("seq")[s - 1][k].alias(f"{c}_{s}") for k, c in enumerate(FRAME) for s in STEPS]))


def _mask(k: int) -> str:
    return (f"((CAST('0x' || substr(md5(concat_ws('|', 'drop', ticker, CAST(epoch(bar_ts) AS BIGINT), {k})), 1, 8) AS BIGINT) + 0.5)"
            " / 4294967296.0::DOUBLE) < 0.1")


@query("scr_07_feature_dropout", sql(
    ["ticker", "d:session", "t:bar_ts", *[f"r:{c}=CASE WHEN {_mask(k)} THEN 0 ELSE {c} END" for k, c in enumerate(FRAME)]], "FROM frame"))
def _(spark, d):
    return final(dropout(frame(spark, d)), *BAR, *FRAME)
