"""Technical indicators over bars. State starts anew with every session.

Everything here is a window over (ticker, session), so the bars are shuffled once. Exponential
means work on blocks of a session, which Spark sorts by inside the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import pct_change, ratio
from . import KEYS, session_window


def _running() -> "Window":
    return session_window().rowsBetween(Window.unboundedPreceding, 0)


def _last(n: int) -> "Window":
    return session_window().rowsBetween(-(n - 1), 0)


def _known_before(col: str) -> Column:
    """The last known value on an earlier bar of the session."""
    return F.last(col, ignorenulls=True).over(session_window().rowsBetween(Window.unboundedPreceding, -1))


def with_bar_no(bars: DataFrame) -> DataFrame:
    """``t``: number of the bar in its session, from 0."""
    return bars.withColumn("t", F.row_number().over(session_window()) - 1)


#: Bars of one block of an exponential mean.
EMA_BLOCK = 128


def with_emas(bars: DataFrame, specs: dict[str, tuple[Column, float, int]]) -> DataFrame:
    """Exponential means ``{name: (values, alpha, first bar)}`` of the known values from that bar on, the
    first of which seeds the mean. A bar without value keeps the mean as it is and ages nothing;
    before the seed the mean is null. Needs ``t``.

    With q = 1 - alpha the mean is a sum of weights q^age, where age counts known values. It is taken
    inside blocks of bars, in powers relative to the block's start, which stay finite; what earlier
    blocks add is one number each, carried over by a fold. So a session may have any number of bars.
    """
    inside = (Window.partitionBy(*KEYS, "_block").orderBy("bar_ts")
              .rowsBetween(Window.unboundedPreceding, 0))
    session = Window.partitionBy(*KEYS).orderBy("_block", "bar_ts")
    before = session.rowsBetween(Window.unboundedPreceding, -1)
    names = list(specs)
    df = bars.withColumns({"_block": F.floor(F.col("t") / EMA_BLOCK), "_r": F.pmod("t", F.lit(EMA_BLOCK))})
    df = df.withColumns({f"_x{k}": F.when(F.col("t") >= seed, x) for k, (x, _, seed) in enumerate(specs.values())})
    df = df.withColumns({f"_n{k}": F.count(f"_x{k}").over(session.rowsBetween(Window.unboundedPreceding, 0)) for k in range(len(names))})
    own = {f"_m{k}": F.count(f"_x{k}").over(inside) for k in range(len(names))}       # known ones of the block so far
    df = df.withColumns(own)
    for k, (_, alpha, _) in enumerate(specs.values()):
        x = F.when(F.col(f"_n{k}") == 1, F.col(f"_x{k}")).otherwise(F.col(f"_x{k}") * alpha)
        q = 1.0 - alpha
        if q < 0.01:             # powers of so small a number would leave a double
            own[f"_own{k}"] = F.aggregate(F.collect_list(x).over(inside), F.lit(0.0), _horner(q))
        else:
            power = F.pow(F.lit(q), (F.col(f"_m{k}") - 1).cast("double"))     # 1 at the first, which stays exact
            own[f"_own{k}"] = power * F.coalesce(F.sum(x / power).over(inside), F.lit(0.0))
    df = df.withColumns({c: e for c, e in own.items() if c.startswith("_own")})
    whole = F.struct(*[F.col(c) for c in own])
    df = df.withColumn("_ends", F.collect_list(F.when(F.col("_r") == EMA_BLOCK - 1, whole)).over(before))
    out = {}
    for k, (name, (_, alpha, _)) in enumerate(specs.items()):
        q = 1.0 - alpha
        carry = F.aggregate("_ends", F.lit(0.0), _block_sum(k, q))
        out[name] = F.when(F.col(f"_n{k}") > 0, F.col(f"_own{k}") + _faded(carry, F.col(f"_m{k}"), q))
    scratch = [f"_{v}{k}" for v in ("x", "n") for k in range(len(names))]
    return df.withColumns(out).drop("_block", "_r", "_ends", *own, *scratch)


def _faded(value: Column, age: Column, q: float) -> Column:
    return value * F.pow(F.lit(q), age.cast("double"))


def _horner(q: float):
    return lambda c, v: c * q + v


def _block_sum(k: int, q: float):
    return lambda c, e: _faded(c, e[f"_m{k}"], q) + e[f"_own{k}"]


def ema(bars: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """EMA of span ``n``; needs ``t``."""
    return with_emas(bars, {out or f"ema_{col}_{n}": (F.col(col), 2.0 / (n + 1), 0)})


def emas(bars: DataFrame) -> DataFrame:
    """Price EMAs 5/9/20 with distances and volume EMAs 5/10/20 with ratios."""
    specs = {f"ema{n}": (F.col("close"), 2.0 / (n + 1), 0) for n in (5, 9, 20)}
    specs |= {f"vol_ema{n}": (F.col("volume").cast("double"), 2.0 / (n + 1), 0) for n in (5, 10, 20)}
    return with_emas(bars, specs).withColumns(
        {f"ema{n}_dist": pct_change("close", f"ema{n}") for n in (5, 9, 20)}
        | {f"vol_ema{n}_ratio": ratio("volume", f"vol_ema{n}") for n in (5, 10, 20)})


def rsi(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength with Wilder smoothing; NULL on the first bar, 100 without losses. A bar
    without close changes nothing, the next one is compared with the last known close."""
    diff = F.col("close") - _known_before("close")
    gain, loss = (F.when(F.col("_diff").isNotNull(), F.greatest(x, F.lit(0.0))) for x in (F.col("_diff"), -F.col("_diff")))
    df = with_emas(bars.withColumn("_diff", diff), {"_gain": (gain, 1.0 / n, 0), "_loss": (loss, 1.0 / n, 0)})
    value = (F.when(F.col("_gain").isNull(), F.lit(None).cast("double"))
             .when((F.col("_loss") == 0) & (F.col("_gain") == 0), F.lit(50.0))
             .when(F.col("_loss") == 0, F.lit(100.0))
             .otherwise(100 - 100 / (1 + F.try_divide("_gain", "_loss"))))
    return df.withColumn(out, value).drop("_diff", "_gain", "_loss")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, histogram and the histogram's change."""
    close = F.col("close")
    df = with_emas(bars, {"_fast": (close, 2.0 / (fast + 1), 0), "_slow": (close, 2.0 / (slow + 1), 0)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_emas(df, {"_signal": (F.when(close.isNotNull(), F.col("macd")), 2.0 / (signal + 1), 0)})
    df = df.withColumn("macd_hist", F.col("macd") - F.col("_signal")).drop("_signal")
    return df.withColumn("macd_accel",
                         F.col("macd_hist") - F.lag("macd_hist").over(session_window()))


def roc(bars: DataFrame, n: int) -> DataFrame:
    return bars.withColumn(f"roc{n}", pct_change("close", F.lag("close", n).over(session_window())))


def stochastic(bars: DataFrame, n: int = 14) -> DataFrame:
    """Stochastic %K and Williams %R over the last ``n`` bars (fewer at the start)."""
    df = bars.withColumns({"_hh": F.max("high").over(_last(n)), "_ll": F.min("low").over(_last(n))})
    span = F.col("_hh") - F.col("_ll")
    return df.withColumns({
        "stoch_k": ratio(F.col("close") - F.col("_ll"), span) * 100,
        "williams_r": ratio(F.col("_hh") - F.col("close"), span) * -100}).drop("_hh", "_ll")


def atr_range(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average true range (Wilder) and the bar's range in units of it."""
    df = bars.withColumn("_prev", _known_before("close"))
    true_range = F.greatest(F.col("high") - F.col("low"),
                            F.abs(F.col("high") - F.col("_prev")),
                            F.abs(F.col("low") - F.col("_prev")))
    df = with_emas(df.withColumn("_tr", true_range), {"atr": (F.col("_tr"), 1.0 / n, 0)})
    return (df.withColumn("atr_range", ratio(F.col("high") - F.col("low"), "atr"))
            .drop("_prev", "_tr"))


def vwap(bars: DataFrame) -> DataFrame:
    """Volume-weighted typical price since the start of the session."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    w = _running()
    return bars.withColumn(
        "vwap", ratio(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))


def candle_shape(bars: DataFrame) -> DataFrame:
    """Body and wick shares of the range, and OHLC relative to VWAP; needs ``vwap``."""
    span = F.col("high") - F.col("low")
    cols = {"body_ratio": ratio(F.abs(F.col("close") - F.col("open")), span),
            "upper_wick": ratio(F.col("high") - F.greatest("open", "close"), span),
            "lower_wick": ratio(F.least("open", "close") - F.col("low"), span)}
    cols |= {f"{c}_vwap": ratio(c, "vwap") for c in ("open", "high", "low", "close")}
    return bars.withColumns(cols)


def streak(bars: DataFrame) -> DataFrame:
    """Signed length of the current run of green (+) or red (-) bars; a doji ends it at 0."""
    t = session_window()
    df = bars.withColumns({"_dir": F.signum(F.col("close") - F.col("open")).cast("int"),
                           "_bar": F.row_number().over(t)})
    change = F.col("_dir") != F.coalesce(F.lag("_dir").over(t), F.lit(9))
    df = df.withColumn("_from", F.when(change, F.col("_bar")))
    began = F.last("_from", ignorenulls=True).over(_running())
    return (df.withColumn("streak", F.col("_dir") * (F.col("_bar") - began + 1))
            .drop("_dir", "_bar", "_from"))


def volume_flow(bars: DataFrame, n: int = 14, slope: int = 10) -> DataFrame:
    """Volume-price trend, on-balance volume with its slope, money flow index."""
    t = session_window()
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumns({"_prev": F.lag("close").over(t), "_tp": typical,
                           "_bar": F.row_number().over(t)})
    df = df.withColumn("_ptp", F.lag("_tp").over(t))
    signed = F.coalesce(F.signum(F.col("close") - F.col("_prev")), F.lit(0.0)) * F.col("volume")
    trend = F.coalesce(F.col("volume") * ratio(F.col("close") - F.col("_prev"), "_prev"), F.lit(0.0))
    flow = F.col("_tp") * F.col("volume")
    df = df.withColumns({
        "vpt": F.sum(trend).over(_running()),
        "obv": F.sum(signed).over(_running()),
        "_up": F.sum(F.when(F.col("_tp") > F.col("_ptp"), flow).otherwise(0.0)).over(_last(n)),
        "_dn": F.sum(F.when(F.col("_tp") < F.col("_ptp"), flow).otherwise(0.0)).over(_last(n))})
    df = df.withColumns({
        "obv_slope": F.regr_slope("obv", F.col("_bar").cast("double")).over(_last(slope)),
        "mfi": ratio(F.col("_up"), F.col("_up") + F.col("_dn")) * 100})
    return df.drop("_prev", "_tp", "_ptp", "_bar", "_up", "_dn")


def volume_shape(bars: DataFrame, k: float = 2.0) -> DataFrame:
    """Log volume, spread proxy, spike flag against EMA20 and EMA5-over-EMA20 crossing;
    needs ``vol_ema5`` and ``vol_ema20``."""
    above = F.col("vol_ema5") > F.col("vol_ema20")
    was = F.lag(above).over(session_window())
    return bars.withColumns({
        "log_volume": F.log1p(F.col("volume").cast("double")),
        "spread": F.col("high") - F.col("low"),
        "volume_spike": (F.col("volume") > k * F.col("vol_ema20")).cast("int"),
        "volume_cross": (above & ~was).cast("int")})


def vwap_dynamics(bars: DataFrame, n: int = 10) -> DataFrame:
    """Distance, slope, touches in the last ``n`` bars, bars since the last cross, reclaim
    from below; needs ``vwap``."""
    t = session_window()
    # Nine places: a bar of one trade sits on its own VWAP, not a rounding error beside it.
    side = F.signum(F.round(F.col("close") - F.col("vwap"), 9)).cast("int")
    df = bars.withColumns({"_side": side, "_bar": F.row_number().over(t)})
    df = df.withColumn("_was", F.lag("_side").over(t))
    crossed = (F.col("_side") != F.col("_was")) & F.col("_was").isNotNull()
    touch = ((F.round(F.col("low") - F.col("vwap"), 9) <= 0)
             & (F.round(F.col("high") - F.col("vwap"), 9) >= 0)).cast("int")
    df = df.withColumns({
        "vwap_dist": pct_change("close", "vwap"),
        "vwap_slope": pct_change("vwap", F.lag("vwap").over(t)),
        "vwap_touches": F.sum(touch).over(_last(n)),
        "bars_since_cross": F.col("_bar") - F.last(F.when(crossed, F.col("_bar")), ignorenulls=True).over(_running()),
        "vwap_reclaim": ((F.col("_was") < 0) & (F.col("_side") > 0)).cast("int")})
    return df.drop("_side", "_was", "_bar")


def session_return(bars: DataFrame) -> DataFrame:
    first = F.first("open").over(_running())
    return bars.withColumn("session_return", pct_change("close", first))


def price_structure(bars: DataFrame, n: int = 5) -> DataFrame:
    """New ``n``-bar high and holding above the EMAs; needs ``ema9`` and ``ema20``."""
    prior = F.max("high").over(session_window().rowsBetween(-n, -1))
    return bars.withColumns({
        "new_high": (F.col("high") >= prior).cast("int"),
        "above_emas": ((F.col("close") > F.col("ema9")) & (F.col("close") > F.col("ema20"))).cast("int")})


PROXY_WEIGHTS = {"momentum": 0.2, "volume": 0.2, "vwap": 0.2, "rsi": 0.2, "structure": 0.2}


def indicators(bars: DataFrame) -> DataFrame:
    """All per-bar indicators in one chain; one exchange for all of them."""
    df = vwap(emas(with_bar_no(bars)))
    df = macd(rsi(df))
    df = stochastic(roc(roc(df, 5), 10))
    df = atr_range(df)
    df = candle_shape(df)
    df = volume_shape(volume_flow(df))
    df = vwap_dynamics(df)
    return price_structure(streak(session_return(df)))


def proxy_score(df: DataFrame, weights: dict[str, float] | None = None, min_rvol: float = 3.0
                ) -> DataFrame:
    """Composite 0..1 score: five parts, each the mean of its 0/1 conditions. Needs the
    ``indicators`` columns and ``rvol``."""
    w = PROXY_WEIGHTS if weights is None else weights

    def part(*conditions: Column) -> Column:
        flags = [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions]
        return sum(flags[1:], flags[0]) / float(len(flags))

    parts = {
        "momentum": part((F.col("ema5") > F.col("ema9")) & (F.col("ema9") > F.col("ema20")),
                         F.col("macd_accel") > 0, F.col("streak") >= 2),
        "volume": part(F.col("rvol") > min_rvol, F.col("volume_spike") == 1,
                       F.col("vol_ema5") > F.col("vol_ema20")),
        "vwap": part(F.col("close") > F.col("vwap"), F.col("vwap_reclaim") == 1),
        "rsi": part(F.col("rsi").between(50, 80)),
        "structure": part(F.col("above_emas") == 1, F.col("new_high") == 1),
    }
    score = sum((w[k] * p for k, p in parts.items()), F.lit(0.0))
    return df.withColumn("score", score)
