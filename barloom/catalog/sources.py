"""File round trips: what Spark derives from the tables is written in each native format
and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import KEYS, trades as T
from ..operators.labels import binarize
from ..plans import training as TR
from ..runtime import materialize, scratch_path
from ..schemas import FEATURES
from ..sources import adapters as A, files as R, sinks as W
from ..streaming import bars as SB
from .kit import COARSE, final, sql
from .rows import BAR, BAR_SQL, FEATURE_SQL, anchors
from .trades import LEG_COLS, TRADE_COLS, backtest, kept, legs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            SQL[name] = oracle
        return fn
    return register


def write_candles(bars, path: str) -> str:
    """One response per (ticker, session): at most one day of bars in an array."""
    candle = F.struct(F.unix_millis("bar_ts").alias("datetime"), "open", "high", "low", "close", "volume")
    (bars.groupBy(*KEYS).agg(F.array_sort(F.collect_list(candle)).alias("candles"))
     .select(F.col("ticker").alias("symbol"), "candles").write.json(path))
    return path


@query("src_01_candles", sql(BAR_SQL + "freq='30min' i:pos r:open r:high r:low r:close i:volume",
    "FROM (SELECT *, row_number() OVER (PARTITION BY ticker, session ORDER BY bar_ts) - 1 AS pos FROM bars)"))
def _(spark, d):
    path = write_candles(A.bars(spark, d), scratch_path(spark, "candles"))
    return final(R.read_candles(spark, path, "30min"), *BAR, "freq", "pos", "open", "high", "low", "close", "volume")


@query("src_02_fundamentals", sql("ticker r:high52 r:low52 r:float_shares", "FROM fund"))
def _(spark, d):
    path = scratch_path(spark, "fundamentals")
    inner = F.struct((F.col("float_shares") / 1000000).alias("marketCapFloat"), "high52", "low52")
    doc = F.to_json(F.create_map("ticker", F.struct(inner.alias("fundamental"))))
    A.fundamentals(spark, d).select(doc).write.text(path)
    return final(R.read_fundamentals(spark, path))


@query("src_03_quotes", sql(["ticker", "i:ts_ms=epoch_us(ts)//1000", "r:last_price=price", "i:total_volume=event_id",
                             "r:wk52_high=high52", "r:wk52_low=low52"], "FROM ticks JOIN fund USING (ticker)"))
def _(spark, d):
    path = scratch_path(spark, "quotes")
    doc = F.to_json(F.create_map("ticker", F.struct(
        F.col("last_price").alias("lastPrice"), F.col("total_volume").alias("totalVolume"),
        F.col("high52").alias("52WkHigh"), F.col("low52").alias("52WkLow"),
        F.unix_millis("ts").alias("quoteTimeInLong"))))
    A.as_quotes(A.ticks(spark, d)).join(A.fundamentals(spark, d), "ticker").select(doc).write.text(path)
    read = R.read_quotes(spark, path)
    return final(read.withColumn("ts_ms", F.unix_millis("ts")),
                 "ticker", "ts_ms", "last_price", "total_volume", "wk52_high", "wk52_low")


def logged(spark, d):
    """The event log as text: header, one line per event, and for every session of one
    ticker a line without a time."""
    path = scratch_path(spark, "event-log")
    events = A.event_log(spark, d).withColumn("ticker", F.upper("ticker"))
    broken = events.filter(F.col("ticker") == "VIEW").select(F.col("ticker").alias("value"))
    spark.createDataFrame([("Ticker Epoch",)], "value string").unionByName(broken).write.text(path)
    W.append_event_log(events, path)
    return R.read_event_log(spark, path)


LOG_SQL = sql(["ticker=upper(ticker)", "i:start_ms=epoch_us(start_ts)//1000"], "FROM log_events")


@query("src_04_event_log", LOG_SQL)
def _(spark, d):
    good, _bad = logged(spark, d)
    return final(good.select("ticker", F.unix_millis("start_ts").alias("start_ms")))


@query("src_04_event_log_quarantine", sql(["value=upper(ticker)"], "FROM log_events WHERE ticker = 'view'"))
def _(spark, d):
    _good, bad = logged(spark, d)
    return final(bad.select("value"))


@query("snk_05_append_event_log", LOG_SQL)
def _(spark, d):
    path = scratch_path(spark, "event-log")
    events = A.event_log(spark, d).withColumn("ticker", F.upper("ticker"))
    half = F.col("session") < F.lit("2024-01-17").cast("date")
    W.append_event_log(events.filter(half), path)
    W.append_event_log(events.filter(~half), path)
    return final(R.read_event_log(spark, path)[0].select("ticker", F.unix_millis("start_ts").alias("start_ms")))


@query("snk_06_roll_event_log", sql("ticker d:session", "FROM log_events ORDER BY start_ts DESC, ticker LIMIT 40"))
def _(spark, d):
    return final(W.roll_event_log(A.event_log(spark, d), keep_n=40, added="start_ts"), "ticker", "session")


@query("snk_06_roll_event_log_days", sql("ticker d:session",
    "FROM log_events WHERE start_ts > (SELECT max(start_ts) FROM log_events) - INTERVAL 14 DAY"))
def _(spark, d):
    return final(W.roll_event_log(A.event_log(spark, d), days=14, added="start_ts"), "ticker", "session")


HISTORY = ["ticker", "leg", "r:pct", "r:profit=exit_price-entry_price",
           "r:open_minutes=(epoch(entry_ts)-epoch(CAST(session AS TIMESTAMP)))/60-480",
           "r:held_minutes=(epoch(exit_ts)-epoch(entry_ts))/60"]


def history(spark, d) -> str:
    path = scratch_path(spark, "history")
    W.append_trades(T.trade_rows(legs(spark, d), 480), path, "text")
    return path


@query("src_05_trade_history", sql(HISTORY, "FROM legs WHERE exit_ts IS NOT NULL"))
def _(spark, d):
    return final(R.read_trade_history(spark, history(spark, d)),
                 "ticker", "leg", "pct", "profit", "open_minutes", "held_minutes")


@query("src_05_trade_history_last_match", sql(["leg", "i:n=count(*)"], "FROM legs WHERE exit_ts IS NOT NULL GROUP BY leg"))
def _(spark, d):
    out = R.read_trade_history(spark, history(spark, d), "legacy_regex")
    return final(out.groupBy("leg").agg(F.count(F.lit(1)).alias("n")))


@query("snk_04_append_trades", sql(TRADE_COLS, "FROM legs WHERE exit_ts IS NOT NULL"))
def _(spark, d):
    path = scratch_path(spark, "trades")
    rows = T.trade_rows(legs(spark, d), 480)
    W.append_trades(rows.filter("leg = 2"), path)
    W.append_trades(rows.filter("leg <> 2"), path)
    return final(spark.read.schema(rows.schema).parquet(path))


@query("src_06_training_csv", sql([*FEATURE_SQL, "r:y"], "FROM anchored"))
def _(spark, d):
    path = scratch_path(spark, "training-csv")
    rows = anchors(spark, d).select(F.monotonically_increasing_id().alias("_c0"), *FEATURES, "y")
    rows.write.csv(path, header=True)
    return final(R.read_training_csv(spark, path).withColumns(
        {c: F.col(c).cast("int") for c in ("good_news", "earnings")}))


@query("snk_01_write_training", sql(["ticker", "d:session", "t:bar_ts", "i:i", *FEATURE_SQL, "r:y"], "FROM anchored"))
def _(spark, d):
    path = scratch_path(spark, "training")
    rows = anchors(spark, d)
    W.write_training(rows, path)
    return final(spark.read.schema(rows.schema).parquet(path))


@query("snk_02_write_balanced", sql(["d:session", "y", "i:n_rows=count(*)"],
    """FROM (SELECT h.*, unnest(generate_series(0, CASE WHEN y = 1 THEN greatest(CAST(round_even((SELECT count(*)
       FILTER (y = 0) / count(*) FILTER (y = 1) FROM hard), 0) AS INTEGER), 0) ELSE 0 END)) AS copy FROM hard h)
       GROUP BY session, y"""))
def _(spark, d):
    first, second = scratch_path(spark, "hard"), scratch_path(spark, "balanced")
    rows = binarize(anchors(spark, d))
    W.write_training(rows, first)
    stored = spark.read.schema(rows.schema).parquet(first)
    balanced = TR.balanced_training_set(stored, shift=0.0)
    W.write_training(balanced, second)
    out = spark.read.schema(balanced.schema).parquet(second)
    return final(out.groupBy("session", "y").agg(F.count(F.lit(1)).alias("n_rows")))


@query("snk_07_write_orders", sql(["ticker", "d:session", "t:entry_ts", "r:entry_price",
    "i:quantity=round_even(1000.0/entry_price,0)+2-(CAST(round_even(1000.0/entry_price,0)AS BIGINT)%2)"], "FROM kept"))
def _(spark, d):
    from ..functions.columns import even_quantity
    path = scratch_path(spark, "orders")
    orders = kept(spark, d).select(*KEYS, "entry_ts", "entry_price",
                                   even_quantity("entry_price", 1000.0).alias("quantity"))
    W.write_orders(orders, path)
    return final(spark.read.schema(orders.schema).parquet(path))


@query("snk_07_order_log", sql(["ticker", "d:session", "t:entry_ts", "p:entry_price", "p:limit_price=entry_price*1.001",
    "i:quantity=round_even(1000.0/entry_price,0)+2-(CAST(round_even(1000.0/entry_price,0)AS BIGINT)%2)"],
    "FROM bordered JOIN bwalk USING (session, rn) WHERE ok"))
def _(spark, d):
    """Scan, features, score, signal, fills, exits and account rules, then the orders; the second
    half of the month is replayed."""
    path = scratch_path(spark, "order-log")
    orders = W.order_log(materialize(backtest(spark, d), "taken"))
    W.write_order_log(orders, path)
    W.write_order_log(orders.filter(F.col("session") >= F.lit("2024-01-17").cast("date")), path)
    return final(spark.read.schema(orders.schema).parquet(path), *KEYS, "entry_ts", "entry_price", "limit_price", "quantity", places=8)


# History lines with whole numbers, so that both engines print the same text.
LINE = """concat('S', l_suppkey, ' -', l_orderkey, 'Time Bought: ', l_linenumber, ' Time Sold: ', l_partkey,
    ' Percent: -', l_partkey, '.', l_suppkey, CASE WHEN l_returnflag = 'N' THEN ' HELD ' ELSE ' SOLD ' END, l_linenumber)"""


def lines(spark, d):
    path = scratch_path(spark, "lines")
    A.table(spark, d, "lineitem").select(F.expr(LINE).alias("value")).write.text(path)
    return path


@query("flt_06_line_filter", sql(["leg=l_linenumber", "i:n=count(*)", "i:profit=sum(-l_orderkey)", "i:held=sum(l_partkey)"],
       "FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_linenumber"))
def _(spark, d):
    out = R.read_trade_history(spark, lines(spark, d))
    return final(out.groupBy("leg").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("profit").cast("long")).alias("profit"),
        F.sum(F.col("held_minutes").cast("long")).alias("held")))


@query("src_05_history_quarantine", sql(["value", "i:n=count(*)"],
       f"FROM (SELECT {LINE} AS value, l_returnflag FROM lineitem) WHERE l_returnflag = 'N' GROUP BY value"))
def _(spark, d):
    _trades, rejected = R.read_trade_history_split(spark, lines(spark, d))
    return final(rejected.groupBy("value").agg(F.count(F.lit(1)).alias("n")))


@query("tk_03_last_match", sql(["leg", "i:n=count(*)", "r:low=min(pct)", "r:high=max(pct)", "i:n_pct=count(DISTINCT pct)"],
    f"""FROM (SELECT CAST(regexp_extract_all({LINE}, '([,-9]+)\\w+', 1)[-1] AS DOUBLE) AS pct,
        CAST(regexp_extract_all({LINE}, '([0-9]+)', 1)[-1] AS INTEGER) AS leg FROM lineitem) GROUP BY leg"""))
def _(spark, d):
    out = R.read_trade_history(spark, lines(spark, d), "legacy_regex")
    return final(out.groupBy("leg").agg(
        F.count(F.lit(1)).alias("n"), F.min("pct").alias("low"), F.max("pct").alias("high"),
        F.countDistinct("pct").alias("n_pct")))
