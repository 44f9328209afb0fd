"""Explicit schemas and column orders; nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

CANDLE = T.StructType([
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("datetime", T.LongType()),
])

CANDLE_RESPONSE = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("candles", T.ArrayType(CANDLE)),
])

FUNDAMENTAL_RESPONSE = T.MapType(
    T.StringType(),
    T.StructType([T.StructField("fundamental", T.StructType([
        T.StructField("marketCapFloat", T.DoubleType()),
        T.StructField("high52", T.DoubleType()),
        T.StructField("low52", T.DoubleType()),
    ]))]),
)

QUOTE_RESPONSE = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("lastPrice", T.DoubleType()),
        T.StructField("totalVolume", T.LongType()),
        T.StructField("52WkHigh", T.DoubleType()),
        T.StructField("52WkLow", T.DoubleType()),
        T.StructField("quoteTimeInLong", T.LongType()),
    ]),
)

QUOTES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("total_volume", T.LongType()),
    T.StructField("seq", T.LongType()),
])

BARS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("session", T.DateType()),
    T.StructField("bar_ts", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("is_premarket", T.BooleanType()),
])

COARSE_LOOKBACK = 8
FINE_LOOKBACK = 5

FLAGS = ["good_news", "earnings"]
RATIOS = ["high52_ratio", "low52_ratio", "pm_high_ratio", "pm_low_ratio",
          "day_high_ratio", "day_low_ratio"]
COARSE_FEATURES = [f"f5_{k}_{s}" for k in range(COARSE_LOOKBACK, 0, -1) for s in ("w", "u", "sq")]
FINE_FEATURES = [f"f1_{k}_{s}" for k in range(FINE_LOOKBACK, 0, -1) for s in ("w", "u", "sq")]

# 47 features in training-table order; the oldest bar has the highest suffix.
FEATURES = FLAGS + RATIOS + COARSE_FEATURES + FINE_FEATURES
LABEL = "y"

# The 40 columns a model sees: no flags, no squared fine pressure.
SCORED = RATIOS + COARSE_FEATURES + [c for c in FINE_FEATURES if not c.endswith("_sq")]

TRAINING = T.StructType(
    [T.StructField("_c0", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    + [T.StructField(LABEL, T.DoubleType())]
)
