"""Batch readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import nan_to_null
from ..schemas import CANDLE_RESPONSE, FUNDAMENTAL_RESPONSE, QUOTE_RESPONSE, TRAINING

# Fixed line formats of the two text logs.
LOG_LINE = r"^([A-Z][A-Z0-9.]*)\s+(\d+)$"
HISTORY_LINE = (r"^(\S+) (\S+?)Time Bought: (\S+) Time Sold: (\S+) "
                r"Percent: (\S+) SOLD (\d+)\s*$")
LEGACY_PERCENT = r"([,-9]+)\w+"
LEGACY_LEG = r"([0-9]+)"


def read_candles(spark: SparkSession, path: str, freq: str, whole_file: bool = False) -> DataFrame:
    """Price-history responses to one row per bar, with its position in the response.

    One response per line is splittable; ``whole_file`` reads one document per file.
    """
    raw = spark.read.schema(CANDLE_RESPONSE).json(path, multiLine=whole_file)
    bars = raw.select(F.col("symbol").alias("ticker"), F.posexplode("candles").alias("pos", "c"))
    ts = F.timestamp_millis("c.datetime")
    return bars.select(
        "ticker", F.to_date(ts).alias("session"), F.lit(freq).alias("freq"), "pos",
        ts.alias("bar_ts"), *[nan_to_null(f"c.{c}").alias(c) for c in ("open", "high", "low", "close")],
        F.col("c.volume").alias("volume"))


def _keyed(spark: SparkSession, path: str, schema, whole_file: bool) -> DataFrame:
    raw = spark.read.text(path, wholetext=whole_file)
    return raw.select(F.explode(F.from_json("value", schema)).alias("ticker", "v"))


def read_fundamentals(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Ticker-keyed documents; the float is given in millions of shares."""
    f = F.col("v.fundamental")
    return _keyed(spark, path, FUNDAMENTAL_RESPONSE, whole_file).select(
        "ticker", f["high52"].alias("high52"), f["low52"].alias("low52"),
        (f["marketCapFloat"] * 1000000).alias("float_shares"))


def read_quotes(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    v = F.col("v")
    return _keyed(spark, path, QUOTE_RESPONSE, whole_file).select(
        "ticker", F.timestamp_millis(v["quoteTimeInLong"]).alias("ts"),
        v["lastPrice"].alias("last_price"), v["totalVolume"].alias("total_volume"),
        v["52WkHigh"].alias("wk52_high"), v["52WkLow"].alias("wk52_low"))


def parse_event_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined lines). Ticker and time are taken from the same line or not
    at all; the header and blank lines are neither."""
    line = F.trim(F.col("value"))
    body = lines.filter((line != "") & ~F.col("value").contains("Ticker"))
    good = body.filter(line.rlike(LOG_LINE)).select(
        F.regexp_extract(line, LOG_LINE, 1).alias("ticker"),
        F.timestamp_millis(F.regexp_extract(line, LOG_LINE, 2).cast("long")).alias("start_ts"))
    return good, body.filter(~line.rlike(LOG_LINE))


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_event_log(spark.read.text(path))


HISTORY_COLUMNS = {"ticker": "string", "profit": "double", "open_minutes": "double", "held_minutes": "double",
                   "pct": "double", "leg": "int"}


def split_trade_history(lines: DataFrame, mode: str = "anchored") -> tuple[DataFrame, DataFrame]:
    """(trades, quarantined lines). A line is a trade or in quarantine, as it stands; blank
    lines are neither. In ``anchored`` mode a number that cannot be read also sends its line
    there.

    ``legacy_regex`` takes the last match of two loose patterns and so loses the last
    digit of the percentage; it exists to compare with older reports.
    """
    v = F.col("value")
    if mode == "anchored":
        # One pass of the pattern over a line: it splits the line, and a line without a match stays whole.
        parts = F.split(F.regexp_replace(v, HISTORY_LINE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
        fields = [F.get("_parts", F.lit(k)).try_cast(kind) for k, kind in enumerate(HISTORY_COLUMNS.values())]
        known = (F.size("_parts") == len(fields)) & F.forall(F.array(*[f.isNotNull() for f in fields]), lambda x: x)
        rows = lines.withColumn("_parts", parts)
        values = [f.alias(c) for f, c in zip(fields, HISTORY_COLUMNS)]
    elif mode == "legacy_regex":
        last = lambda pattern: F.element_at(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)), -1)
        known, rows = v.rlike(LEGACY_PERCENT), lines
        values = [last(LEGACY_PERCENT).try_cast("double").alias("pct"), last(LEGACY_LEG).cast("int").alias("leg")]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    known = F.coalesce(known, F.lit(False))
    return rows.filter(known).select(*values), rows.filter(~known & (F.trim(v) != "")).select(*lines.columns)


def parse_trade_history(lines: DataFrame, mode: str = "anchored") -> DataFrame:
    """The trades of ``split_trade_history`` alone."""
    return split_trade_history(lines, mode)[0]


def read_trade_history(spark: SparkSession, path: str, mode: str = "anchored") -> DataFrame:
    return parse_trade_history(spark.read.text(path), mode)


def read_trade_history_split(spark: SparkSession, path: str, mode: str = "anchored") -> tuple[DataFrame, DataFrame]:
    """Trades and the lines that are none, as ``read_event_log`` gives them for events."""
    return split_trade_history(spark.read.text(path), mode)


def read_training_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A training table with its unnamed index column dropped and NaN read as NULL."""
    df = spark.read.schema(TRAINING).csv(path, header=header, enforceSchema=True).drop("_c0")
    return df.select(*[nan_to_null(c).alias(c) for c in df.columns])
