"""Indicators, composite score, scan and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import KEYS, indicators as I, scan, sessions as S
from ..sources import adapters as A
from .kit import COARSE, T_WINDOW, VIEWS, final, sql
from .rows import BAR, BAR_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

RUN = f"({T_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def last(n: int) -> str:
    return f"({T_WINDOW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def ema(x: str, alpha: float, seed: int = 0) -> str:
    q = f"CAST({1.0 - alpha!r} AS DOUBLE)"
    return (f"CASE WHEN t >= {seed} THEN pow({q}, t - {seed}) * sum(CASE WHEN t = {seed} THEN 1.0::DOUBLE WHEN t > {seed} "
            f"THEN CAST({alpha!r} AS DOUBLE) END * {x} * pow({q}, {seed} - t)) OVER {RUN} END")


TYPICAL = "(high + low + close) / 3"

VIEWS.update({
    "tb": f"SELECT *, row_number() OVER ({T_WINDOW}) - 1 AS t FROM bars",
    "emas": "SELECT *, " + ", ".join(f"{ema('close', 2 / (n + 1))} AS ema{n}" for n in (5, 9, 20)) + ", "
            + ", ".join(f"{ema('volume', 2 / (n + 1))} AS vol_ema{n}" for n in (5, 10, 20)) + " FROM tb",
    "vw": f"""SELECT *, sum({TYPICAL} * volume) OVER {RUN} / nullif(sum(volume) OVER {RUN}, 0) AS vwap FROM emas""",
    "rs0": f"""SELECT *, close - lag(close) OVER ({T_WINDOW}) AS diff FROM vw""",
    "rs1": f"""SELECT *, {ema('greatest(diff, 0)', 1 / 14, 1)} AS gain, {ema('greatest(-diff, 0)', 1 / 14, 1)} AS loss FROM rs0""",
    "rsis": """SELECT *, CASE WHEN gain IS NULL THEN NULL WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100
        ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM rs1""",
    "mc0": f"SELECT *, {ema('close', 2 / 13)} - {ema('close', 2 / 27)} AS macd FROM rsis",
    "mc1": f"SELECT *, macd - {ema('macd', 2 / 10)} AS macd_hist FROM mc0",
    "macds": f"SELECT *, macd_hist - lag(macd_hist) OVER ({T_WINDOW}) AS macd_accel FROM mc1",
    "sk0": f"""SELECT *, sign(close - open) AS dir, CASE WHEN t = 0 OR sign(close - open) <> lag(sign(close - open))
        OVER ({T_WINDOW}) THEN t END AS began FROM macds""",
    "streaks": f"SELECT *, CAST(dir * (t - max(began) OVER {RUN} + 1) AS INTEGER) AS streak FROM sk0",
    "vshape": f"""SELECT *, CAST(volume > 2.0 * vol_ema20 AS INTEGER) AS volume_spike,
        CAST(vol_ema5 > vol_ema20 AND NOT lag(vol_ema5 > vol_ema20) OVER ({T_WINDOW}) AS INTEGER) AS volume_cross
        FROM streaks""",
    "vd0": f"""SELECT *, CAST(sign(round(close - vwap, 9)) AS INTEGER) AS side,
        CAST(round(low - vwap, 9) <= 0 AND round(high - vwap, 9) >= 0 AS INTEGER) AS touch FROM vshape""",
    "vd1": f"SELECT *, lag(side) OVER ({T_WINDOW}) AS was FROM vd0",
    "vdyn": f"""SELECT *, (close - vwap) / vwap * 100 AS vwap_dist,
        (vwap - lag(vwap) OVER ({T_WINDOW})) / lag(vwap) OVER ({T_WINDOW}) * 100 AS vwap_slope,
        sum(touch) OVER {last(10)} AS vwap_touches,
        t - max(CASE WHEN side <> was THEN t END) OVER {RUN} AS bars_since_cross,
        CAST(was < 0 AND side > 0 AS INTEGER) AS vwap_reclaim FROM vd1""",
    "structure": f"""SELECT *, CAST(high >= max(high) OVER ({T_WINDOW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS INTEGER)
        AS new_high, CAST(close > ema9 AND close > ema20 AS INTEGER) AS above_emas FROM vdyn""",
    "scored": """SELECT s.*, gap_pct, rvol,
        0.2 * (coalesce(CAST(ema5 > ema9 AND ema9 > ema20 AS INTEGER), 0) + coalesce(CAST(macd_accel > 0 AS INTEGER), 0)
               + coalesce(CAST(streak >= 2 AS INTEGER), 0)) / 3.0
        + 0.2 * (coalesce(CAST(rvol > 0.8 AS INTEGER), 0) + coalesce(volume_spike, 0)
                 + coalesce(CAST(vol_ema5 > vol_ema20 AS INTEGER), 0)) / 3.0
        + 0.2 * (coalesce(CAST(close > vwap AS INTEGER), 0) + coalesce(vwap_reclaim, 0)) / 2.0
        + 0.2 * coalesce(CAST(rsi BETWEEN 50 AND 80 AS INTEGER), 0)
        + 0.2 * (coalesce(above_emas, 0) + coalesce(new_high, 0)) / 2.0 AS score
        FROM structure s JOIN rvols USING (ticker, session)""",
    "signals": """SELECT s.*, coalesce(CAST(gap_pct BETWEEN -8 AND 8 AND rvol > 0.8 AND score >= 0.5 AND s.close > vwap
        AND s.close > ema9 AND rsi BETWEEN 40 AND 90 AND s.volume > 0.5 * s.vol_ema20 AND p.i >= 8 AS INTEGER), 0) AS signal, p.i AS i
        FROM scored s JOIN pos p USING (ticker, session, bar_ts)""",
})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


def simple(name: str, build, view: str, cols: list[str], specs: list[str] | None = None) -> None:
    """One query whose columns come straight from a view."""
    SQL[name] = sql(["ticker", "d:session", "t:bar_ts", *(specs or [f"r:{c}" for c in cols])], f"FROM {view}")

    def run(spark, d):
        out = build(I.with_bar_no(A.bars(spark, d)))
        return final(out.withColumns({c: F.col(c).cast("double") for c in cols}), *BAR, *cols)
    QUERIES[name] = run


simple("ag_14_vwap", I.vwap, "vw", ["vwap"])
_EMAS = [f"{v}ema{n}" for v, ns in (("", (5, 9, 20)), ("vol_", (5, 10, 20))) for n in ns]
_DISTS = [f"ema{n}_dist" for n in (5, 9, 20)] + [f"vol_ema{n}_ratio" for n in (5, 10, 20)]
simple("wn_11_ema", I.emas, "emas", _EMAS + _DISTS,
       [f"r:{c}" for c in _EMAS] + [f"r:ema{n}_dist=(close-ema{n})/ema{n}*100" for n in (5, 9, 20)]
       + [f"r:vol_ema{n}_ratio=volume/nullif(vol_ema{n},0)" for n in (5, 10, 20)])
simple("wn_12_rsi", I.rsi, "rsis", ["rsi"])
simple("wn_13_macd", I.macd, "macds", ["macd", "macd_hist", "macd_accel"])
simple("wn_14_roc", lambda b: I.roc(I.roc(b, 5), 10), "bars", ["roc5", "roc10"],
       [f"r:roc{n}=(close - lag(close, {n}) OVER ({T_WINDOW})) / lag(close, {n}) OVER ({T_WINDOW}) * 100" for n in (5, 10)])
simple("wn_15_stochastic", I.stochastic, "bars", ["stoch_k", "williams_r"],
       [f"r:stoch_k=(close - min(low) OVER {last(14)}) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0) * 100",
        f"r:williams_r=(max(high) OVER {last(14)} - close) / nullif(max(high) OVER {last(14)} - min(low) OVER {last(14)}, 0) * -100"])
simple("wn_16_atr_range", I.atr_range,
       f"""(SELECT *, (high - low) / nullif(atr, 0) AS atr_range FROM (SELECT *, {ema('tr', 1 / 14)} AS atr FROM (SELECT *, greatest(high - low,
        coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS tr FROM
        (SELECT *, lag(close) OVER ({T_WINDOW}) AS p FROM tb))))""", ["atr", "atr_range"])
simple("wn_17_candle_shape", lambda b: I.candle_shape(I.vwap(b)), "vw",
       ["body_ratio", "upper_wick", "lower_wick", "open_vwap", "high_vwap", "low_vwap", "close_vwap"],
       ["r:body_ratio=abs(close-open)/nullif(high-low,0)", "r:upper_wick=(high-greatest(open,close))/nullif(high-low,0)",
        "r:lower_wick=(least(open,close)-low)/nullif(high-low,0)", *[f"r:{c}_vwap={c}/vwap" for c in ("open", "high", "low", "close")]])
simple("wn_18_streak", I.streak, "streaks", ["streak"])
simple("wn_19_volume_flow", I.volume_flow,
       f"""(SELECT *, sum(v1) OVER {RUN} AS vpt, regr_slope(obv, t) OVER {last(10)} AS obv_slope,
         up / nullif(up + dn, 0) * 100 AS mfi FROM (SELECT *,
         coalesce(volume * (close - p) / p, 0) AS v1, sum(coalesce(sign(close - p), 0) * volume) OVER {RUN} AS obv,
         sum(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER {last(14)} AS up,
         sum(CASE WHEN tp < ptp THEN tp * volume ELSE 0 END) OVER {last(14)} AS dn
         FROM (SELECT *, lag(tp) OVER ({T_WINDOW}) AS ptp FROM (SELECT *, lag(close) OVER ({T_WINDOW}) AS p,
         {TYPICAL} AS tp FROM tb))))""", ["vpt", "obv", "obv_slope", "mfi"])
simple("wn_20_volume_shape", lambda b: I.volume_shape(I.emas(b)), "vshape",
       ["log_volume", "spread", "volume_spike", "volume_cross"],
       ["r:log_volume=ln(1 + volume)", "r:spread=high-low", "r:volume_spike", "r:volume_cross"])
simple("wn_21_vwap_dynamics", lambda b: I.vwap_dynamics(I.vwap(b)), "vdyn",
       ["vwap_dist", "vwap_slope", "vwap_touches", "bars_since_cross", "vwap_reclaim"])
simple("wn_22_session_return", lambda b: I.rsi(I.session_return(b)), "rsis", ["session_return", "rsi"],
       [f"r:session_return=(close - first_value(open) OVER {RUN}) / first_value(open) OVER {RUN} * 100", "r:rsi"])
simple("wn_23_price_structure", lambda b: I.price_structure(I.emas(b)), "structure", ["new_high", "above_emas"])


def _known_ema(x: str, alpha: float) -> str:
    """Mean over the known bars, which ``k`` numbers; carried over the others below."""
    return ema(x, alpha).replace("CASE WHEN t >= 0 THEN ", "").removesuffix(" END").replace("t -", "k -").replace("- t)", "- k)").replace(
        "t = 0", "k = 0").replace("t > 0", "k > 0")


GAPPY = "CASE WHEN (epoch(bar_ts) // 1800 + length(ticker)) % 5 <> 2 THEN {} END"
VIEWS.update({
    "gappy": f"""SELECT ticker, session, bar_ts, {', '.join(f'{GAPPY.format(c)} AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))}
        FROM bars""",
    "known0": f"""SELECT *, row_number() OVER ({T_WINDOW}) - 1 AS k, lag(close) OVER ({T_WINDOW}) AS p FROM gappy WHERE close IS NOT NULL""",
    "known1": f"""SELECT *, {_known_ema('close', 2 / 10)} AS ema9, {_known_ema('volume', 2 / 6)} AS vol_ema5,
        {_known_ema('close', 2 / 13)} - {_known_ema('close', 2 / 27)} AS macd,
        {_known_ema('greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0))', 1 / 14)} AS atr FROM known0""",
    "known2": f"""SELECT *, macd - {_known_ema('macd', 2 / 10)} AS macd_hist FROM known1""",
    "known3": f"""SELECT ticker, session, bar_ts, {', '.join(f"{ema(f'greatest({x}, 0)', 1 / 14, 1).replace('t >=', 'k >=').replace('t -', 'k -').replace('- t)', '- k)').replace('t = 1', 'k = 1').replace('t > 1', 'k > 1')} AS {n}"
        for x, n in (('close - p', 'gain'), ('p - close', 'loss')))} FROM known0""",
    "known": """SELECT g.ticker, g.session, g.bar_ts, k.ema9, k.vol_ema5, k.macd, k.macd_hist, k.atr, CASE WHEN gain IS NULL THEN NULL
        WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi
        FROM gappy g ASOF LEFT JOIN (SELECT * FROM known2 JOIN (SELECT bar_ts, ticker, session, gain, loss FROM known3) USING (ticker, session, bar_ts)) k
        ON g.ticker = k.ticker AND g.session = k.session AND g.bar_ts >= k.bar_ts""",
})


@query("wn_11_missing_bars", sql(BAR_SQL + "r:ema9 r:vol_ema5 r:rsi r:macd r:macd_hist r:atr", "FROM known"))
def _(spark, d):
    """Exponential means, RSI, MACD and true range where a fifth of the bars have no prices."""
    bars = A.bars(spark, d)
    there = F.pmod(F.floor(F.unix_seconds("bar_ts") / 1800) + F.length("ticker"), F.lit(5)) != 2
    gappy = bars.withColumns({c: F.when(there, F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    out = I.atr_range(I.macd(I.rsi(I.emas(I.with_bar_no(gappy)))))
    return final(out, *BAR, "ema9", "vol_ema5", "rsi", "macd", "macd_hist", "atr")


def scored(spark, d):
    """All indicators with the day's gap and relative volume, and the composite score."""
    bars = A.stored_bars(spark, d)
    day = S.relative_volume(S.gap_pct(bars)).select(*KEYS, "gap_pct", "rvol")
    return I.proxy_score(I.indicators(bars).join(day, KEYS), min_rvol=0.8)


#: Half-hour test bars rarely hold twice the mean volume.
SPIKE = 0.5


def signals(spark, d):
    out = scored(spark, d)
    out = I.volume_shape(S.with_position(out), SPIKE)
    return scan.entry_signal(out, gap=(-8.0, 8.0), min_rvol=0.8, min_score=0.5, rsi=(40.0, 90.0), warmup_bars=8)


@query("wn_24_proxy_score", sql(BAR_SQL + "r:score", "FROM scored"))
def _(spark, d):
    return final(scored(spark, d), *BAR, "score")


@query("flt_08_entry_signal", sql(BAR_SQL + "r:score i:signal", "FROM signals"))
def _(spark, d):
    return final(signals(spark, d), *BAR, "score", "signal")


@query("flt_09_alerts", sql(BAR_SQL + "r:score", "FROM scored WHERE round(score, 9) > 0.65"))
def _(spark, d):
    rounded = scored(spark, d).withColumn("score", F.round("score", 9))
    return final(scan.alerts(rounded), *BAR, "score")


@query("wn_10_rank_watchlist", sql(BAR_SQL + "r:score i:rank",
    "FROM (SELECT *, rank() OVER (PARTITION BY session, bar_ts ORDER BY round(score, 9) DESC) AS rank FROM scored)"))
def _(spark, d):
    rounded = scored(spark, d).withColumn("score", F.round("score", 9))
    return final(scan.rank_watchlist(rounded, ("session", "bar_ts")), *BAR, "score", "rank")


@query("tk_01_top_candidates", sql("ticker d:session r:gap_pct r:rvol i:place",
    """FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rvol DESC NULLS LAST, ticker) AS place FROM rvols)
       WHERE place <= 3"""))
def _(spark, d):
    day = S.relative_volume(S.gap_pct(A.bars(spark, d)))
    return final(scan.top_candidates(day, 3, ("session",), "rvol"), "ticker", "session", "gap_pct", "rvol", "place")
