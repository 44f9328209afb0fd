"""Column expressions. All of them stay in the JVM and inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = [
    "ratio", "pressure", "pct_change", "even_quantity", "equity_quantity", "minutes_between",
    "nan_to_null", "sequence_key", "bucket_start", "hard_label", "sigmoid", "uniform_hash",
    "normal_hash", "scan_gap_bucket",
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """Division that yields NULL for a zero divisor instead of failing the job."""
    return F.try_divide(_c(num), _c(den))


def pressure(o, h, l, c, v, float_shares) -> tuple[Column, Column, Column]:
    """Candle pressure: plain, weighted by turnover of the float, and weighted squared."""
    o, h, l, c, v, float_shares = map(_c, (o, h, l, c, v, float_shares))
    u = ratio((c - l) - (h - c), o) * 1000
    w = u * (ratio(v, float_shares) * 100)
    return u, w, w * w


def pct_change(price, base) -> Column:
    return ratio(_c(price) - _c(base), base) * 100


def even_quantity(price, amount: float = 25.0) -> Column:
    """Shares for ``amount``, moved up to an even number so that two legs are equal."""
    q = F.bround(ratio(F.lit(float(amount)), price), 0).cast("long")
    return q + 2 - F.pmod(q, F.lit(2))


def equity_quantity(equity, price, cap: float, fraction: float = 0.10) -> Column:
    return F.floor(ratio(F.least(_c(equity) * fraction, F.lit(float(cap))), price)).cast("long")


def minutes_between(later, earlier) -> Column:
    return (F.unix_seconds(_c(later)) - F.unix_seconds(_c(earlier))) / 60.0


def nan_to_null(col) -> Column:
    """NaN sorts above every number in Spark, so it must not reach a comparison."""
    col = _c(col)
    return F.when(~F.isnan(col), col)


def sequence_key(ts, seq) -> Column:
    """Total order (ts, seq) as one decimal.

    A decimal fits the fixed-width aggregation buffer, so ``min_by``/``max_by`` on it
    stay hash aggregates; a struct key would make Spark sort all ticks first.
    ``seq`` must be non-negative.
    """
    return (F.unix_micros(_c(ts)).cast("decimal(18,0)")
            * F.lit("10000000000000000000").cast("decimal(20,0)")
            + _c(seq).cast("decimal(19,0)"))


def bucket_start(ts, seconds: int, origin: int = 0) -> Column:
    """Start of the ``seconds`` wide bucket holding ``ts``; ``origin`` shifts the grid."""
    s = F.unix_seconds(_c(ts)) - origin
    return F.timestamp_seconds(F.floor(s / seconds) * seconds + origin)


def hard_label(y, threshold: float = 0.7) -> Column:
    return F.when(nan_to_null(y) >= threshold, 1).otherwise(0)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def uniform_hash(seed: str, *cols) -> Column:
    """A number in (0, 1) fixed by the row's key: equal after a retry and on any
    partitioning, unlike ``rand()``."""
    text = F.concat_ws("|", F.lit(seed), *[_c(c).cast("string") for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal_hash(seed: str, *cols) -> Column:
    """Standard normal number fixed by the row's key (Box-Muller)."""
    u1, u2 = uniform_hash(seed + ":a", *cols), uniform_hash(seed + ":b", *cols)
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * F.pi() * u2)


def scan_gap_bucket(gap, edges=(25.0, 30.0, 40.0, 50.0)) -> Column:
    """Label of the gap range, lower edge inclusive; outside all edges gives 'other'."""
    gap = _c(gap)
    out = None
    for lo, hi in zip(edges, edges[1:]):
        cond = (gap >= lo) & (gap < hi)
        name = F.lit(f"{lo:g}-{hi:g}")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("other")
