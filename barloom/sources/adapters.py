"""The test tables seen as market data. All derivations are Spark expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import ratio
from ..operators.bars import ohlcv, rollup_bars
from ..runtime import materialize

COARSE = 1800          # stands for the five-minute grid
FINE = 360             # stands for the one-minute grid
OPEN_MINUTE = 480      # premarket ends at 08:00
VOLUME = r'"k":\s*(\d+)'   # the one number in props; four times faster than a JSON parse

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_ticks(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_type").alias("ticker"), F.to_date(ts).alias("session"), ts.alias("ts"),
        (100 + F.col("value") / 10).alias("price"),
        F.regexp_extract("props", VOLUME, 1).try_cast("long").alias("vol"), "event_id")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_ticks(table(spark, sf_dir, "events"))


def as_quotes(ticks_df: DataFrame) -> DataFrame:
    """The event number is a counter that only grows: a cumulative market volume."""
    return ticks_df.select("ticker", "session", "ts", F.col("price").alias("last_price"),
                           F.col("event_id").alias("total_volume"), F.col("event_id").alias("seq"))


def is_premarket():
    return F.hour("bar_ts") * 60 + F.minute("bar_ts") < OPEN_MINUTE


def fine_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(ticks(spark, sf_dir), FINE, is_premarket())


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_bars(fine_bars(spark, sf_dir), COARSE)


def stored_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine bars as a table: jobs that need them more than once scan the ticks once."""
    return materialize(fine_bars(spark, sf_dir), "fine-bars")


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(bars(spark, sf_dir), "bars")


def fundamentals_of(priced: DataFrame) -> DataFrame:
    """One row per ticker of a bar table: its price range, and a float that depends on
    its name. Stored, so that its real size decides whether Spark broadcasts it."""
    rows = (priced.groupBy("ticker")
            .agg(F.max("high").alias("high52"), F.min("low").alias("low52"))
            .withColumn("float_shares", 1000000.0 * F.length("ticker")))
    return materialize(rows, "fundamentals")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals_of(fine_bars(spark, sf_dir))


def market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fine bars, fundamentals), both stored, from one scan of the ticks."""
    fine = stored_fine(spark, sf_dir)
    return fine, fundamentals_of(fine)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tick of each (ticker, session)."""
    return ticks(spark, sf_dir).groupBy("ticker", "session").agg(F.min("ts").alias("start_ts"))


def lineitem_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily trades: supplier as ticker, ship date as session; order-free aggregates only."""
    li = table(spark, sf_dir, "lineitem")
    price = ratio("l_extendedprice", "l_quantity")
    return (li.groupBy(F.col("l_suppkey").cast("string").alias("ticker"),
                       F.to_date("l_shipdate").alias("session"))
            .agg(F.max(price).alias("day_high"), F.min(price).alias("day_low"),
                 F.sum(F.col("l_quantity").cast("long")).alias("day_volume"),
                 F.sum("l_extendedprice").alias("turnover")))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector of each supplier: its region's name."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slow facts per ticker, one row a week dated its Monday."""
    week = F.to_date(F.date_trunc("week", "session"))
    weekly = (ticks(spark, sf_dir).groupBy("ticker", week.alias("as_of"))
              .agg(F.max("vol").alias("v")))
    return weekly.select("ticker", "as_of", (F.col("v") / 100.0).alias("short_ratio"),
                         F.date_sub("as_of", F.length("ticker")).alias("earnings_date"))
