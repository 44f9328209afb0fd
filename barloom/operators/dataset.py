"""Training-set operators: counts, balance, statistics, profile, folds, augmentation."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import nan_to_null, normal_hash, ratio, uniform_hash
from ..schemas import SCORED
from . import session_window


def class_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, positives and negatives, optionally per table or fold."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("y") == 0).alias("n_neg"))


def copies(df: DataFrame, shift: float = 3.0) -> Column:
    """Extra copies of each positive, round(neg/pos - shift) half to even, at least 0.
    A one-row scalar subquery; a table without positives stops the job."""
    counts = class_counts(df)
    k = F.bround(F.col("n_neg") / F.col("n_pos") - shift, 0)
    none = F.raise_error(F.lit("no positive rows to balance with")).cast("double")
    return counts.select(F.when(F.col("n_pos") == 0, none)
                         .otherwise(F.greatest(k, F.lit(0.0))).cast("int").alias("k")).scalar()


def balance(df: DataFrame, shift: float = 3.0) -> DataFrame:
    """Oversample: each positive row once plus ``copies`` times. Rows multiply where they
    are; there is no shuffle of the table."""
    n = F.when(F.col("y") == 1, copies(df, shift)).otherwise(0)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), n)))


def feature_stats(df: DataFrame, columns: list[str] = SCORED) -> DataFrame:
    """One row: mean and sample deviation of each column, missing values skipped."""
    return df.agg(*[F.avg(nan_to_null(c)).alias(f"{c}__mean") for c in columns],
                  *[F.stddev_samp(nan_to_null(c)).alias(f"{c}__std") for c in columns])


def zscore(df: DataFrame, stats: DataFrame, columns: list[str] = SCORED) -> DataFrame:
    """(x - mean) / std against the one-row ``stats``; NULL where std is 0."""
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = df.withColumn("_s", s)
    return out.withColumns(
        {c: ratio(F.col(c) - F.col("_s")[f"{c}__mean"], F.col("_s")[f"{c}__std"]) for c in columns}
    ).drop("_s")


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), nan_to_null(F.col(c).cast("double")).alias("x"))
                      for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.feature", "p.x")
            .filter(F.col("x").isNotNull()))


#: Size of the quantile sketches, and three times the rank error that they keep 99 times of 100.
SKETCH = 4096
RANK_ERROR = 3 * 2.296 / SKETCH ** 0.9021
#: Values of one range that a task may rank; a range with more is cut into this many parts first.
RANKED, PARTS = 200_000, 512
QUARTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


def profile(df: DataFrame, columns: list[str], ranked: int = RANKED) -> DataFrame:
    """count, mean, std, min, exact quartiles (linear interpolation) and max per column.

    Mergeable sketches, combined map-side, give each quartile a narrow range of values. A range that
    holds more than ``ranked`` of them is cut into parts, which are counted, until the part with the wanted
    ranks is small; then only its values are ranked. What a sketch has missed shows in the counts,
    and its search starts again from the whole column. The driver sees a few numbers per column.
    A column without values has count 0. ``df`` is read at least twice and should be stored.
    """
    spark = df.sparkSession
    values = _long(df, columns)
    sides = [F.array(*[F.lit(min(max(p + side * RANK_ERROR, 0.0), 1.0)) for p in QUARTILES]) for side in (-1, 1)]
    rows = (values.groupBy("feature").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"),
        F.max("x").alias("max"), F.kll_sketch_agg_double("x", SKETCH).alias("s"))
        .select("*", F.kll_sketch_get_quantile_double("s", sides[0]).alias("low"),
                F.kll_sketch_get_quantile_double("s", sides[1]).alias("high")).drop("s").collect())
    whole = {r.feature: (r.min, r.max, r["count"]) for r in rows}
    spans = [Span(r.feature, p, (r["count"] - 1) * p, low, high, 2 * RANK_ERROR * r["count"])
             for r in rows for p, low, high in zip(QUARTILES, r.low, r.high)]
    found: dict[tuple, float] = {}
    while spans:
        wide = [s for s in spans if s.inside > ranked and s.low < s.high]
        if wide:
            spans = [s for s in spans if s not in wide] + _narrowed(values, wide, whole)
        else:
            found |= _ranked(values, spans)
            spans = [replace(s, low=whole[s.feature][0], high=whole[s.feature][1], inside=whole[s.feature][2])
                     for s in spans if (s.feature, s.p) not in found]
    by_name = {r.feature: r for r in rows}
    out = []
    for c in columns:
        r = by_name.get(c)
        out.append((c, 0, *[None] * 7) if r is None else
                   (c, r["count"], r.mean, r.std, r.min, *[found[c, p] for p in QUARTILES], r.max))
    return spark.createDataFrame(out, "feature string, count long, mean double, std double, min double, "
                                      "q25 double, q50 double, q75 double, max double")


@dataclass(frozen=True)
class Span:
    """Where quantile ``p`` of a column is looked for: position ``at`` in order, values between
    ``low`` and ``high``, of which there are about ``inside``."""

    feature: str
    p: float
    at: float
    low: float
    high: float
    inside: float


def _within(values: DataFrame, spans: list[Span]) -> DataFrame:
    """Values up to each span's upper end, with the span; three spans per column at most."""
    known = values.sparkSession.createDataFrame(
        [(s.feature, s.p, s.at, s.low, s.high) for s in spans], "feature string, p double, at double, low double, high double")
    return values.join(F.broadcast(known), "feature").filter(F.col("x") <= F.col("high"))


def _narrowed(values: DataFrame, spans: list[Span], whole: dict) -> list[Span]:
    """Each span cut down to the parts with its two ranks, by exact counts."""
    part = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * PARTS)
    counted = (_within(values, spans).withColumn("part", F.when(F.col("x") < F.col("low"), -1).otherwise(part))
               .groupBy("feature", "p", "part").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
               .orderBy("part").collect())
    out = []
    for s in spans:
        mine = [r for r in counted if (r.feature, r.p) == (s.feature, s.p)]
        before, hit = 0, []
        for r in mine:
            if before + r.n > math.floor(s.at) and before <= math.ceil(s.at):
                hit.append(r)
            before += r.n
        if not hit or hit[0].part < 0 or before <= math.ceil(s.at):
            low, high, n = whole[s.feature]
            out.append(replace(s, low=low, high=high, inside=n))
            continue
        new = replace(s, low=hit[0].low, high=hit[-1].high, inside=sum(r.n for r in hit))
        out.append(new if (new.low, new.high) != (s.low, s.high) else replace(new, inside=0))     # no narrower: rank it
    return out


def _ranked(values: DataFrame, spans: list[Span]) -> dict[tuple, float]:
    """The quantiles whose span holds both neighbouring ranks. Equal values and all that lie below a span
    are one row each before the sort."""
    x = F.when(F.col("x") >= F.col("low"), F.col("x"))
    order = (Window.partitionBy("feature", "p").orderBy(F.asc_nulls_first("v"))
             .rowsBetween(Window.unboundedPreceding, 0))
    got = (_within(values, spans).withColumn("v", x).groupBy("feature", "p", "v")
           .agg(F.count("x").alias("n"), F.first("at").alias("at"))
           .withColumn("upto", F.sum("n").over(order))
           .groupBy("feature", "p").agg(
               F.first("at").alias("at"), F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("below"),
               *[F.min(F.when(F.col("v").isNotNull() & (F.col("upto") > f("at")), F.col("v"))).alias(name)
                 for name, f in (("a", F.floor), ("b", F.ceil))]).collect())
    return {(r.feature, r.p): r.a + (r.b - r.a) * (r["at"] - math.floor(r["at"])) for r in got
            if r.below <= math.floor(r["at"]) and r.a is not None and r.b is not None}


def walk_forward(df: DataFrame, start: str, train_months: int, n_folds: int = 4,
                 date: str = "session") -> DataFrame:
    """Rows tagged (fold, role): ``train_months`` of training, the next month to validate,
    the one after to test, moved by a month per fold. Map-only: the few folds a row is in
    are computed from its own month."""
    first = F.to_date(F.lit(start))
    month = ((F.year(date) - F.year(first)) * 12 + F.month(date) - F.month(first))
    role = [F.when((month >= f) & (month < f + train_months), F.lit("train"))
            .when(month == f + train_months, F.lit("validate"))
            .when(month == f + train_months + 1, F.lit("test")) for f in range(n_folds)]
    tags = F.array(*[F.struct(F.lit(f + 1).alias("fold"), r.alias("role"))
                     for f, r in enumerate(role)])
    tagged = df.withColumn("_tag", F.explode(F.filter(tags, lambda s: s["role"].isNotNull())))
    return tagged.select(*df.columns, "_tag.fold", "_tag.role")


def augment(bars: DataFrame, seed: str = "a", noise: float = 0.001, max_shift: int = 2,
            drop_rate: float = 0.1, features: tuple[str, ...] = ("volume",)) -> DataFrame:
    """Each bar once per shift in -max..max, prices from the shifted bar with Gaussian
    noise, listed features zeroed at ``drop_rate``. Randomness is a hash of the row's
    key, so a recomputed task gives the same rows."""
    t = session_window()
    prices = ["open", "high", "low", "close"]
    values = [*prices, *features]
    shifts = list(range(-max_shift, max_shift + 1))
    moved = bars.withColumn("_v", F.array(*[
        F.struct(F.lit(s).alias("shift"),
                 *[(F.lag(c, s).over(t) if s > 0 else F.lead(c, -s).over(t) if s < 0 else F.col(c))
                   .alias(c) for c in values]) for s in shifts]))
    rows = moved.select("ticker", "session", "bar_ts", F.inline("_v")).filter(F.col("close").isNotNull())
    key = ["ticker", F.unix_seconds("bar_ts"), "shift"]
    factor = 1 + noise * normal_hash(seed, *key)
    rows = rows.withColumn("_f", factor)
    return rows.select(
        "ticker", "session", "bar_ts", "shift",
        *[(F.col(c) * F.col("_f")).alias(c) for c in prices],
        *[F.when(uniform_hash(f"{seed}:{c}", *key) < drop_rate, F.lit(0)).otherwise(F.col(c)).alias(c)
          for c in features])
