"""Streaming twins, run over everything that has landed and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import KEYS, sessions as S
from ..runtime import materialize, scratch_path
from ..schemas import FEATURES
from ..sources import adapters as A, streams as SRC
from ..streaming import bars as SB, live as LV, state as ST
from .aggregates import OHLCV, OHLCV_SQL, QBARS
from .kit import COARSE, OPEN_MINUTE, T_WINDOW, VIEWS, final, lags, sql
from .rows import BAR, BAR_SQL, FEATURE_SQL
from .trades import LIVE, SPEC

QUERIES: dict = {}
SQL: dict[str, str] = {}

HALF = "2024-01-17"

VIEWS.update({
    "live_fine": f"""SELECT *, {lags(['w', 'u'], 5, 1, 'f1')} FROM pfine WHERE NOT is_premarket WINDOW t AS ({T_WINDOW})""",
    "live_last": f"""SELECT * EXCLUDE (bar_ts) FROM live_fine f JOIN (SELECT ticker AS k, session AS s,
        time_bucket(INTERVAL {COARSE} SECOND, bar_ts) AS coarse_ts, max(bar_ts) AS m FROM live_fine GROUP BY 1, 2, 3) g
        ON f.ticker = g.k AND f.session = g.s AND f.bar_ts = g.m""",
    "live_coarse": f"""SELECT *, {lags(['w', 'u'], 8, 1, 'f5')}, row_number() OVER t - 1 AS i,
        max(high) OVER t AS day_high, min(low) OVER t AS day_low
        FROM pbars WHERE NOT is_premarket WINDOW t AS ({T_WINDOW})""",
    "live_feats": "SELECT c.ticker, c.session, c.bar_ts, c.i, 1 AS good_news, 0 AS earnings, "
        "1 - c.close / c.high52 AS high52_ratio, 1 - c.low52 / c.close AS low52_ratio, "
        "coalesce(1 - c.close / nullif(pm_high, 0), 0) AS pm_high_ratio, "
        "coalesce(1 - c.close / nullif(pm_low, 0), 0) AS pm_low_ratio, 0 AS y, "
        "1 - c.close / day_high AS day_high_ratio, 1 - day_low / c.close AS day_low_ratio, "
        + ", ".join(f"f5_{k}_w, f5_{k}_u, f5_{k}_w * f5_{k}_w AS f5_{k}_sq" for k in range(8, 0, -1)) + ", "
        + ", ".join(f"f1_{k}_w, f1_{k}_u, f1_{k}_w * f1_{k}_w AS f1_{k}_sq" for k in range(5, 0, -1))
        + """ FROM live_coarse c JOIN live_last l ON c.ticker = l.ticker AND c.session = l.session
        AND c.bar_ts = l.coarse_ts LEFT JOIN pre p ON c.ticker = p.ticker AND c.session = p.session WHERE c.i >= 7""",
})


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


class Run:
    """Paths of one streaming run below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, stream: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Run to the end of what has landed, in append mode, and read the result."""
        SB.run_available(stream, self.path(name), self.path(f"{name}-checkpoint"), by)
        return self.spark.read.schema(stream.schema).parquet(self.path(name))

    def follow(self, name: str, schema) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(self.path(name))

    def ticks(self, sf_dir: str) -> DataFrame:
        """All ticks, then an end-of-feed row that lets the last bars close."""
        return SRC.stream_ticks(self.spark, sf_dir, SRC.write_closing(self.spark, self.path("closing")))


@query("src_07_quote_stream", sql(["ticker", "i:ts_us=epoch_us(ts)", "r:last_price=price", "i:total_volume=event_id"],
                                  "FROM ticks"))
def _(spark, d):
    run = Run(spark, "quotes")
    A.as_quotes(A.ticks(spark, d)).drop("session").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(run.path("landing"))
    out = run.append(SRC.stream_quotes(spark, run.path("landing")), "quotes")
    return final(out.withColumn("ts_us", F.unix_micros("ts")), "ticker", "ts_us", "last_price", "total_volume")


@query("st_01_ohlcv", sql(OHLCV_SQL, "FROM bars"))
def _(spark, d):
    run = Run(spark, "ohlcv")
    bars = SB.stream_ohlcv(run.ticks(d), COARSE, premarket=A.is_premarket())
    return final(run.append(bars, "bars"), *BAR, *OHLCV)


@query("st_01_ohlcv_origin", sql(BAR_SQL + "r:open r:high r:low r:close i:volume",
    """FROM (SELECT ticker, session, time_bucket(INTERVAL 1800 SECOND, ts - INTERVAL 97 SECOND) + INTERVAL 97 SECOND AS bar_ts,
       first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, event_id) AS close, sum(vol) AS volume FROM ticks GROUP BY 1, 2, 3)"""))
def _(spark, d):
    run = Run(spark, "ohlcv-origin")
    bars = SB.stream_ohlcv(run.ticks(d), COARSE, origin=97)
    return final(run.append(bars, "bars"), *BAR, "open", "high", "low", "close", "volume")


def quote_bars(run: Run, d: str) -> DataFrame:
    stream = SB.stream_quote_bars(A.as_quotes(run.ticks(d)), COARSE)
    run.append(stream, "bars")
    return run.follow("bars", stream.schema)


@query("st_02_volume_delta", sql(
    BAR_SQL + "r:close i:volume", f"""FROM (SELECT *, total_close - coalesce(lag(total_close) OVER ({T_WINDOW}), total_open)
    AS volume FROM {QBARS})"""))
def _(spark, d):
    run = Run(spark, "volume")
    out = run.append(ST.stream_volume_delta(quote_bars(run, d), watermark="2 hours"), "out")
    return final(out, *BAR, "close", "volume")


@query("st_03_premarket", sql(["ticker", "d:session", "r:pm_high=max(price) FILTER (hour(ts) < 8)",
                               "r:pm_low=min(price) FILTER (hour(ts) < 8)"], "FROM ticks GROUP BY ticker, session"))
def _(spark, d):
    run = Run(spark, "premarket")
    stream = SB.stream_premarket(SRC.stream_ticks(spark, d), OPEN_MINUTE)
    SB.run_foreach(stream, SB.upsert_batch(run.path("out")), run.path("checkpoint"))
    return final(SB.read_upserts(spark, run.path("out"), KEYS), *KEYS, "pm_high", "pm_low")


@query("st_04_features", sql(["ticker", "d:session", "t:bar_ts", "i:i", *FEATURE_SQL], "FROM live_feats"))
def _(spark, d):
    run = Run(spark, "features")
    pre = SB.stream_premarket(SRC.stream_ticks(spark, d), OPEN_MINUTE)
    SB.run_foreach(pre, SB.upsert_batch(run.path("premarket")), run.path("premarket-checkpoint"))
    fine = SB.stream_ohlcv(run.ticks(d), A.FINE, premarket=A.is_premarket())
    run.append(fine, "fine", "session")
    LV.stream_features(run.follow("fine", fine.schema), run.path("fine"), run.path("out"),
                       run.path("checkpoint"), A.fundamentals(spark, d), COARSE, run.path("premarket"))
    return final(SB.read_upserts(spark, run.path("out"), BAR), *BAR, "i", *FEATURES)


@query("st_05_fill", sql(
    ["ticker", "d:session", "t:bar_ts=slot", "b:is_filled=slot > bar_ts", "r:close",
     "i:volume=CASE WHEN slot > bar_ts THEN 0 ELSE volume END"],
    f"""FROM (SELECT ticker, session, unnest(generate_series(bar_ts, greatest(bar_ts, coalesce(nxt, least(seen,
    CAST(session AS TIMESTAMP) + INTERVAL 24 HOUR)) - INTERVAL {COARSE} SECOND), INTERVAL {COARSE} SECOND)) AS slot, bar_ts, close, volume
    FROM (SELECT *, lead(bar_ts) OVER ({T_WINDOW}) AS nxt, max(bar_ts) OVER () AS seen,
    total_close - coalesce(lag(total_close) OVER ({T_WINDOW}), total_open) AS volume FROM {QBARS}))"""))
def _(spark, d):
    """Quiet slots are carried to the end of the day, as far as the newest bar of any ticker has come."""
    run = Run(spark, "fill")
    out = run.append(ST.stream_fill(quote_bars(run, d), COARSE), "out")
    return final(out, *BAR, "is_filled", "close", "volume")


def followed_bars(run: Run, d: str) -> DataFrame:
    stream = SB.stream_ohlcv(run.ticks(d), COARSE, premarket=A.is_premarket())
    run.append(stream, "bars")
    return run.follow("bars", stream.schema)


@query("st_06_session_timers", sql(BAR_SQL + "r:close b:can_enter=elapsed<36000-5400", f"""FROM (SELECT *,
    max(CASE WHEN (open - prev_close) / prev_close * 100 <= -2 THEN 1 ELSE 0 END) OVER
    ({T_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone,
    epoch(bar_ts) - min(epoch(bar_ts)) OVER (PARTITION BY ticker, session) AS elapsed
    FROM (SELECT bars.*, prev_close FROM bars JOIN gaps USING (ticker, session)) b WHERE NOT is_premarket)
    WHERE coalesce(gone, 0) = 0 AND elapsed <= 36000"""))
def _(spark, d):
    run = Run(spark, "timers")
    closes = S.prev_close(A.bars(spark, d)).select(*KEYS, "prev_close")
    live = followed_bars(run, d).filter(~F.col("is_premarket")).join(closes, KEYS)
    return final(run.append(ST.session_timers(live, -2.0, 36000, 5400), "out"), *BAR, "close", "can_enter")


@query("st_07_positions", sql(
    ["ticker", "d:session", "t:entry_ts", "leg", "t:exit_ts=l.exit_ts", "r:pct=l.pct"],
    "FROM legs l JOIN kept k USING (ticker, session, entry_ts) WHERE l.exit_ts IS NOT NULL"))
def _(spark, d):
    run = Run(spark, "positions")
    signal = (~F.col("is_premarket") & (F.col("close") > F.col("open"))).cast("int")
    live = followed_bars(run, d).withColumn("signal", signal)
    out = run.append(ST.stream_positions(live, LIVE, "2 hours"), "out")
    return final(out, *KEYS, "entry_ts", "leg", "exit_ts", "pct")


@query("st_07_positions_spec", sql(
    ["ticker", "d:session", "t:entry_ts", "leg", "t:exit_ts=l.exit_ts", "r:pct=l.pct"],
    "FROM slegs l JOIN skept k USING (ticker, session, entry_ts) WHERE l.exit_ts IS NOT NULL"))
def _(spark, d):
    run = Run(spark, "positions")
    signal = (~F.col("is_premarket") & (F.col("close") > F.col("open"))).cast("int")
    live = followed_bars(run, d).withColumn("signal", signal)
    return final(run.append(ST.stream_positions(live, SPEC, "2 hours"), "out"), *KEYS, "entry_ts", "leg", "exit_ts", "pct")


VIEWS.update({
    "wscan": f"""SELECT ticker, session, pm_volume, price, (price - prev_close) / prev_close * 100 AS gap_pct, pm_volume / nullif(mean_pm, 0) AS rvol
        FROM (SELECT *, lag(last_close) OVER w AS prev_close, avg(coalesce(pm_volume, 0)) OVER (PARTITION BY ticker ORDER BY session
          ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean_pm FROM (SELECT ticker, session, sum(vol) FILTER (hour(ts) < 8) AS pm_volume,
          arg_max(price, ts) FILTER (hour(ts) < 8) AS price, arg_max(price, ts) AS last_close FROM ticks GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY ticker ORDER BY session))""",
    "wscored": VIEWS["scored"].replace("JOIN rvols USING", "JOIN wscan USING"),
    "wnewest": "SELECT * FROM wscored WHERE NOT is_premarket QUALIFY row_number() OVER (PARTITION BY ticker, session ORDER BY bar_ts DESC) = 1",
})


@query("st_08_watchlist", sql(
    ["ticker", "d:session", "i:pm_volume", "r:price", "r:gap_pct", "r:rvol", "t:bar_ts", "r:score", "r:float_shares", "r:entry_price", "i:rank"],
    """FROM (SELECT w.*, n.bar_ts, n.score, 1000000.0 * length(ticker) AS float_shares, least(n.close, greatest(n.vwap, n.ema9)) AS entry_price,
       rank() OVER (PARTITION BY session ORDER BY round(n.score, 9) DESC) AS rank FROM wscan w JOIN wnewest n USING (ticker, session)
       WHERE w.gap_pct BETWEEN -8 AND 8 AND w.pm_volume > 100 AND w.price BETWEEN 1 AND 1000 AND w.rvol > 0.8)"""))
def _(spark, d):
    """The premarket scan, then the bars of its members only, scored into the same table."""
    run = Run(spark, "watchlist")
    history = A.stored_fine(spark, d)
    prior = materialize(LV.prior_facts(history), "prior")                     # read by every trigger
    LV.stream_scan(SRC.stream_ticks(spark, d), run.path("watch"), run.path("scan-checkpoint"), prior,
                   OPEN_MINUTE, (-8.0, 8.0), 100, (1.0, 1000.0), 0.8)
    bars = SB.stream_ohlcv(run.ticks(d), COARSE, premarket=A.is_premarket())
    run.append(bars, "bars", "session")
    LV.stream_scores(run.follow("bars", bars.schema), run.path("bars"), run.path("watch"), run.path("score-checkpoint"),
                     A.fundamentals_of(history), 0.8)
    out = LV.watchlist(spark, run.path("watch")).withColumn("rank", F.rank().over(
        Window.partitionBy("session").orderBy(F.round("score", 9).desc())))
    return final(out, *KEYS, "pm_volume", "price", "gap_pct", "rvol", "bar_ts", "score", "float_shares", "entry_price", "rank")


def half_late(spark, d):
    """Bars of a run in which the second half of the month lands first, so that the first half is
    late and is dropped; and the folder of all that landed."""
    run = Run(spark, "late")
    quotes = A.as_quotes(A.ticks(spark, d))
    closing = (spark.read.parquet(SRC.write_closing(spark, run.path("closing"))).transform(A.as_ticks)
               .transform(A.as_quotes))
    late = F.col("session") < F.lit(HALF).cast("date")
    for part in (quotes.filter(~late).unionByName(closing), quotes.filter(late)):
        part.drop("session").write.mode("append").option(
            "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(run.path("landing"))
        out = run.append(SB.stream_quote_bars(SRC.stream_quotes(spark, run.path("landing")), COARSE, counted=True), "bars")
    return out, quotes


@query("st_09_late_quotes", sql(BAR_SQL + "r:close", f"FROM {QBARS} WHERE session >= DATE '{HALF}'"))
def _(spark, d):
    return final(half_late(spark, d)[0], *BAR, "close")


@query("st_09_late_counts", sql(BAR_SQL + "i:n_landed=count(*) i:n_late=count(*)", f"""FROM (SELECT *,
    time_bucket(INTERVAL {COARSE} SECOND, ts) AS bar_ts FROM ticks) WHERE session < DATE '{HALF}' GROUP BY ticker, session, bar_ts"""))
def _(spark, d):
    """Each late quote is counted, in its bar."""
    bars, landed = half_late(spark, d)
    return final(SB.late_quotes(landed, bars, COARSE), *BAR, "n_landed", "n_late")


@query("snk_03_snapshot", sql("ticker d:session t:bar_ts r:close i:volume",
    "FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS rn FROM bars) WHERE rn = 1"))
def _(spark, d):
    run = Run(spark, "snapshot")
    SB.write_snapshot(followed_bars(run, d), run.path("out"), run.path("checkpoint"))
    return final(SB.read_snapshot(spark, run.path("out")), *BAR, "close", "volume")
