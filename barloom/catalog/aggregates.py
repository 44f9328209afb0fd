"""Aggregations, bar-to-bar windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import KEYS, bars as B, dataset as D, sessions as S
from ..operators.labels import binarize
from ..runtime import materialize
from ..schemas import FEATURES, SCORED
from ..sources import adapters as A
from .kit import COARSE, FINE, T_WINDOW, final, sql
from .rows import BAR, BAR_SQL, anchors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


OHLCV = ["open", "high", "low", "close", "volume", "is_premarket"]
OHLCV_SQL = BAR_SQL + "r:open r:high r:low r:close i:volume b:is_premarket"


@query("ag_01_ohlcv", sql(OHLCV_SQL, "FROM bars"))
def _(spark, d):
    return final(B.ohlcv(A.ticks(spark, d), COARSE, A.is_premarket()), *BAR, *OHLCV)


@query("ag_01_ohlcv_fine", sql(OHLCV_SQL, "FROM fine"))
def _(spark, d):
    return final(A.fine_bars(spark, d), *BAR, *OHLCV)


@query("ag_01_rollup", sql(OHLCV_SQL, "FROM bars"))
def _(spark, d):
    return final(A.bars(spark, d), *BAR, *OHLCV)


@query("ag_02_premarket_range", sql("ticker d:session r:pm_high r:pm_low", "FROM pre"))
def _(spark, d):
    return final(S.premarket_range(A.bars(spark, d)))


@query("ag_03_class_counts", sql(
    ["i:n_rows=count(*)", "i:n_pos=count(*) FILTER (y = 1)", "i:n_neg=count(*) FILTER (y = 0)"], "FROM hard"))
def _(spark, d):
    return final(D.class_counts(binarize(anchors(spark, d))))


@query("ag_03_class_counts_recent", sql(
    ["recent", "i:n_rows=count(*)", "i:n_pos=count(*) FILTER (y = 1)", "i:n_neg=count(*) FILTER (y = 0)"],
    "FROM (SELECT *, CAST(session >= DATE '2024-01-17' AS INTEGER) AS recent FROM hard) GROUP BY recent"))
def _(spark, d):
    rows = binarize(anchors(spark, d)).withColumn(
        "recent", (F.col("session") >= F.lit("2024-01-17").cast("date")).cast("int"))
    return final(D.class_counts(rows, ["recent"]))


@query("ag_04_feature_stats", sql(
    [f"r:{c}__mean=avg({c})" for c in SCORED] + [f"r:{c}__std=stddev_samp({c})" for c in SCORED], "FROM hard"))
def _(spark, d):
    return final(D.feature_stats(materialize(anchors(spark, d), "anchors")))


@query("ag_05_profile", sql(
    ["feature", "i:count=count(x)", "r:mean=avg(x)", "r:std=stddev_samp(x)", "r:min=min(x)", "r:q25=quantile_cont(x, 0.25)",
     "r:q50=quantile_cont(x, 0.5)", "r:q75=quantile_cont(x, 0.75)", "r:max=max(x)"],
    f"FROM (SELECT unnest({FEATURES}) AS feature, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in FEATURES)}]) AS x FROM anchored) GROUP BY feature"))
def _(spark, d):
    return final(D.profile(materialize(anchors(spark, d), "anchors"), FEATURES))


@query("ag_07_prev_close", sql("ticker d:session r:last_close=day_close r:prev_close", "FROM gaps"))
def _(spark, d):
    return final(S.prev_close(A.bars(spark, d)))


@query("ag_08_relative_volume", sql("ticker d:session i:day_volume r:rvol", "FROM rvols"))
def _(spark, d):
    return final(S.relative_volume(S.daily(A.bars(spark, d))), "ticker", "session", "day_volume", "rvol")


@query("ag_08_relative_volume_daily", sql("ticker d:session i:day_volume r:rvol",
    """FROM (SELECT *, day_volume / nullif(avg(day_volume) OVER (PARTITION BY ticker ORDER BY session
       ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS rvol FROM supplied)"""))
def _(spark, d):
    return final(S.relative_volume(A.lineitem_daily(spark, d)), "ticker", "session", "day_volume", "rvol")


@query("ag_09_bar_counts", sql("ticker d:session i:n_coarse i:n_fine r:fine_per_coarse=n_fine/n_coarse",
    """FROM (SELECT ticker, session, count(*) AS n_coarse FROM bars WHERE NOT is_premarket GROUP BY 1, 2)
       JOIN (SELECT ticker, session, count(*) AS n_fine FROM fine WHERE NOT is_premarket GROUP BY 1, 2)
       USING (ticker, session)"""))
def _(spark, d):
    return final(bar_counts(A.stored_fine(spark, d)))


def bar_counts(fine):
    return B.bar_counts(B.rollup_bars(fine, COARSE), fine)


@query("ag_10_gap_pct", sql("ticker d:session r:day_open r:day_close r:prev_close r:gap_pct", "FROM gaps"))
def _(spark, d):
    return final(S.gap_pct(A.bars(spark, d)), "ticker", "session", "day_open", "day_close", "prev_close", "gap_pct")


@query("ag_15_cum_volume_ratio", sql(BAR_SQL + "i:cum_volume r:expected_cum_volume r:cum_volume_ratio",
    f"""FROM (SELECT *, cum_volume / nullif(expected_cum_volume, 0) AS cum_volume_ratio FROM (SELECT *,
       avg(cum_volume) OVER (PARTITION BY ticker, slot ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS expected_cum_volume
       FROM (SELECT g.ticker, g.session, g.slot, b.bar_ts, coalesce(sum(b.volume) OVER (PARTITION BY g.ticker, g.session ORDER BY g.slot), 0) AS cum_volume
         FROM (SELECT ticker, session, unnest(range(0, 86400, {COARSE})) AS slot FROM (SELECT DISTINCT ticker, session FROM bars)) g
         LEFT JOIN bars b ON g.ticker = b.ticker AND g.session = b.session AND epoch(b.bar_ts) % 86400 = g.slot)))
       WHERE bar_ts IS NOT NULL"""))
def _(spark, d):
    return final(S.cum_volume_ratio(A.bars(spark, d), COARSE), *BAR, "cum_volume", "expected_cum_volume", "cum_volume_ratio")


@query("ag_16_premarket_volume", sql(
    "ticker d:session i:pm_volume=coalesce(sum(volume)FILTER(is_premarket),0)", "FROM bars GROUP BY ticker, session"))
def _(spark, d):
    return final(S.premarket_volume(A.bars(spark, d)))


# ---------------------------------------------------------------- bar-to-bar windows

QBARS = f"""(SELECT ticker, session, time_bucket(INTERVAL {COARSE} SECOND, ts) AS bar_ts,
    last(price ORDER BY ts, event_id) AS close, arg_min(event_id, ts) AS total_open, arg_max(event_id, ts) AS total_close
    FROM ticks GROUP BY 1, 2, 3)"""


@query("wn_06_volume_delta", sql(
    BAR_SQL + "r:close i:volume", f"""FROM (SELECT *, total_close - coalesce(lag(total_close) OVER ({T_WINDOW}), total_open)
    AS volume FROM {QBARS})"""))
def _(spark, d):
    quotes = A.as_quotes(A.ticks(spark, d))
    return final(B.volume_delta(B.quote_bars(quotes, COARSE)), *BAR, "close", "volume")


FILLED = f"""(SELECT ticker, session, unnest(generate_series(bar_ts, coalesce(nxt - INTERVAL {FINE} SECOND, bar_ts),
    INTERVAL {FINE} SECOND)) AS slot, bar_ts, open, high, low, close, volume
    FROM (SELECT *, lead(bar_ts) OVER ({T_WINDOW}) AS nxt FROM fine))"""


@query("wn_07_locf", sql(
    ["ticker", "d:session", "t:bar_ts=slot", "b:is_filled=slot > bar_ts", "r:close",
     *[f"r:{c}=CASE WHEN slot > bar_ts THEN close ELSE {c} END" for c in ("open", "high", "low")],
     "i:volume=CASE WHEN slot > bar_ts THEN 0 ELSE volume END"], f"FROM {FILLED}"))
def _(spark, d):
    return final(B.locf(A.fine_bars(spark, d), FINE), *BAR, "is_filled", "close", "open", "high", "low", "volume")


# ---------------------------------------------------------------- set operations

def vendors(spark, d):
    """One vendor covers regular hours, the other everything at slightly other prices."""
    bars = A.stored_bars(spark, d)
    first = bars.filter(~F.col("is_premarket"))
    second = bars.withColumns({c: F.col(c) + 1 for c in ("open", "high", "low", "close")})
    return ("first", first), ("second", second)


@query("src_08_merge_bars", sql(
    BAR_SQL + "vendor r:open r:close i:volume",
    """FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session, bar_ts ORDER BY p) AS rn FROM
       (SELECT *, 'first' AS vendor, 0 AS p FROM bars WHERE NOT is_premarket UNION ALL
        SELECT * REPLACE (open + 1 AS open, close + 1 AS close), 'second', 1 FROM bars)) WHERE rn = 1"""))
def _(spark, d):
    merged = B.merge_bars(*vendors(spark, d), priority=["first", "second"])
    return final(merged, *BAR, "vendor", "open", "close", "volume")


@query("set_03_deduplicate", sql("vendor i:n_bars=count(*) i:volume=sum(volume)",
    """FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session, bar_ts ORDER BY p) AS rn FROM
       (SELECT *, 'first' AS vendor, 1 AS p FROM bars WHERE NOT is_premarket UNION ALL
        SELECT *, 'second', 0 FROM bars)) WHERE rn = 1 GROUP BY vendor"""))
def _(spark, d):
    merged = B.merge_bars(*vendors(spark, d), priority=["second", "first"])
    return final(merged.groupBy("vendor").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("volume").alias("volume")))


@query("set_01_append", sql("ticker i:n_rows=count(*) i:volume=sum(volume)",
    "FROM (SELECT ticker, volume FROM bars UNION ALL SELECT ticker, volume FROM fine) GROUP BY ticker"))
def _(spark, d):
    fine = A.stored_fine(spark, d)
    both = B.rollup_bars(fine, COARSE).unionByName(fine)
    return final(both.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume")))


def _balanced(shift: float) -> str:
    return sql("y i:n_rows=count(*) r:f=avg(f5_1_u)", f"""FROM (SELECT h.*, unnest(generate_series(0, CASE WHEN y = 1
        THEN greatest(CAST(round_even((SELECT count(*) FILTER (y = 0) / count(*) FILTER (y = 1) FROM hard) - {shift}, 0)
        AS INTEGER), 0) ELSE 0 END)) AS copy FROM hard h) GROUP BY y""")


@query("set_02_balance", _balanced(3.0))
def _(spark, d):
    rows = D.balance(materialize(binarize(anchors(spark, d)), "hard"))
    return final(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("f5_1_u").alias("f")))


@query("set_02_balance_shift0", _balanced(0.0))
def _(spark, d):
    rows = D.balance(materialize(binarize(anchors(spark, d)), "hard"), shift=0.0)
    return final(rows.groupBy("y").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("f5_1_u").alias("f")))
