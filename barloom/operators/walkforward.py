"""Walk-forward learning: all folds fitted at once, thresholds from validation months, results from test months.

The classifier is Gaussian naive Bayes, whose fit is a handful of sums per fold and class. One aggregate
fits every fold side by side, the model is one row per fold, and scoring is an expression; the
rows of a fold are never gathered. ``scoring.train`` has the iterative classifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import nan_to_null, ratio, sigmoid

#: Variances are at least this.
LEAST_VARIANCE = 1e-9
#: Probabilities are ranked in so many steps for the ROC area, and in hundredths for thresholds.
STEPS = 10_000


def fit(tagged: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """One row per fold from its ``train`` rows with a label: means that stand for missing values, and per class
    the count and each column's mean and variance."""
    train = tagged.filter((F.col("role") == "train") & F.col(label).isin(0, 1))
    fill = train.groupBy("fold").agg(F.array(*[F.avg(nan_to_null(F.col(c).cast("double"))) for c in columns]).alias("fill"))
    rows = filled(train, fill, columns)
    one = {0: F.col(label) == 0, 1: F.col(label) == 1}
    return rows.groupBy("fold").agg(
        F.first("fill").alias("fill"),
        *[F.count_if(is_k).alias(f"n{k}") for k, is_k in one.items()],
        *[F.array(*[F.avg(F.when(is_k, F.col("_x")[j])) for j in range(len(columns))]).alias(f"mean{k}") for k, is_k in one.items()],
        *[F.array(*[F.var_pop(F.when(is_k, F.col("_x")[j])) for j in range(len(columns))]).alias(f"var{k}") for k, is_k in one.items()])


def filled(rows: DataFrame, by_fold: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the row of their fold (one per fold) and ``_x``, the values with the fold's means for missing
    ones; a column that the fold never saw counts as 0."""
    x = F.array(*[F.coalesce(nan_to_null(F.col(c).cast("double")), F.col("fill")[j], F.lit(0.0)) for j, c in enumerate(columns)])
    return rows.join(F.broadcast(by_fold), "fold").withColumn("_x", x)


def _log_odds(n: int) -> Column:
    """Log of the odds of class 1 over class 0."""
    total = F.log(F.col("n1") / F.col("n0"))
    for j in range(n):
        v0, v1 = (F.greatest(F.col(f"var{k}")[j], F.lit(LEAST_VARIANCE)) for k in (0, 1))
        d0, d1 = (F.col("_x")[j] - F.col(f"mean{k}")[j] for k in (0, 1))
        total = total + (F.log(v0 / v1) + d0 * d0 / v0 - d1 * d1 / v1) / 2
    return total


def probabilities(tagged: DataFrame, models: DataFrame, columns: list[str], out: str = "p") -> DataFrame:
    """Every row of a fitted fold with its probability; a fold that has seen one class only gives that class."""
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    p = F.when(both, sigmoid(_log_odds(len(columns)))).otherwise((F.col("n1") > 0).cast("double"))
    return filled(tagged, models, columns).withColumn(out, p).select(*tagged.columns, out)


def thresholds(scored: DataFrame, label: str = "y") -> DataFrame:
    """``fold, threshold`` in hundredths: the one with the most right answers on the fold's ``validate`` rows, the
    smallest of several. Rows become counts per hundredth before anything is ordered."""
    bins = (scored.filter((F.col("role") == "validate") & F.col(label).isin(0, 1))
            .groupBy("fold", F.least(F.floor(F.col("p") * 100), F.lit(99)).alias("bin"))
            .agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")))
    up = Window.partitionBy("fold").orderBy("bin")
    right = (F.sum("pos").over(up.rowsBetween(0, Window.unboundedFollowing))
             + F.coalesce(F.sum("neg").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    best = Window.partitionBy("fold").orderBy(F.desc("right"), "bin")
    return (bins.withColumn("right", right).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
            .select("fold", F.col("bin").cast("long").alias("threshold")))


def decide(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ``test`` rows with ``hit``, the fold's decision. A fold without validation rows decides at 50."""
    return (scored.filter("role = 'test'").join(F.broadcast(chosen), "fold", "left")
            .withColumn("threshold", F.coalesce("threshold", F.lit(50)))
            .withColumn("hit", (F.least(F.floor(F.col("p") * 100), F.lit(99)) >= F.col("threshold")).cast("int")))


def metrics(decided: DataFrame, label: str = "y") -> DataFrame:
    """Per fold over labelled rows: counts, accuracy, precision, recall and the ROC area, a rank sum over
    probabilities in ``STEPS`` steps in which ties count half. At most that many rows per fold are ordered."""
    step = F.round(F.col("p") * STEPS).cast("long")
    cells = (decided.filter(F.col(label).isin(0, 1)).groupBy("fold", "threshold", step.alias("step"))
             .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"), F.sum(F.col("hit").cast("long")).alias("hits"),
                  F.sum((F.col("hit") * F.col(label)).cast("long")).alias("true_hits")))
    below = Window.partitionBy("fold").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("below", F.coalesce(F.sum(F.col("n") - F.col("pos")).over(below), F.lit(0)))
    won = F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2.0)
    total = ranked.groupBy("fold", "threshold").agg(
        F.sum("n").alias("n_rows"), F.sum("pos").alias("n_pos"), F.sum("hits").alias("n_hits"), F.sum("true_hits").alias("tp"), F.sum(won).alias("won"))
    neg = F.col("n_rows") - F.col("n_pos")
    return total.select(
        "fold", "threshold", "n_rows", "n_pos", "n_hits",
        ratio(F.col("tp") + neg - (F.col("n_hits") - F.col("tp")), "n_rows").alias("accuracy"),
        ratio("tp", "n_hits").alias("precision"), ratio("tp", "n_pos").alias("recall"),
        ratio(F.col("won"), F.col("n_pos") * neg).alias("roc_area"))
