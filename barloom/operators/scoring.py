"""Model scoring. The only Python in the batch path, fed by Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import ratio
from ..schemas import SCORED
from .dataset import feature_stats

Layers = list[tuple[np.ndarray, np.ndarray]]


def mlp_probability(features: Column, layers: Layers, batch_size: int = 4096) -> Column:
    """Forward pass tanh -> leaky(0.05) -> sigmoid over an array column. The weights are
    a few hundred kilobytes and travel with the function, independent of the data."""
    n_inputs = layers[0][0].shape[1]

    def make():
        net = [(w.astype(np.float64), b.astype(np.float64)) for w, b in layers]

        def predict(x: np.ndarray) -> np.ndarray:
            (w1, b1), (w2, b2), (w3, b3) = net
            h = np.tanh(x @ w1.T + b1)
            h = h @ w2.T + b2
            h = np.where(h > 0, h, 0.05 * h)
            return (1.0 / (1.0 + np.exp(-(h @ w3.T + b3))))[:, 0]
        return predict

    udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=[[n_inputs]])
    return udf(features)


def mlp_score(df: DataFrame, layers: Layers, out: str = "p", columns: list[str] = SCORED,
              threshold: float = 0.5, stats: DataFrame | None = None) -> DataFrame:
    """Probability and 0/1 decision; rows with a missing input get NULL, never a stale or
    guessed signal. With one-row ``stats`` the inputs are normalized on the way, without
    a second copy of the columns."""
    values = [F.col(c).cast("double") for c in columns]
    if stats is not None:
        df = df.withColumn("_s", stats.select(F.struct(*stats.columns)).scalar())
        s = F.col("_s")
        values = [ratio(v - s[f"{c}__mean"], s[f"{c}__std"]) for c, v in zip(columns, values)]
    inputs = df.withColumn("_x", F.array(*values)).drop("_s")
    complete = ~F.exists("_x", lambda x: x.isNull())
    filled = F.transform("_x", lambda x: F.coalesce(x, F.lit(0.0)))
    scored = inputs.withColumn(out, mlp_probability(filled, layers))
    return (scored.withColumn(out, F.when(complete, F.col(out)))
            .withColumn(f"{out}_hit", (F.col(out) > threshold).cast("int")).drop("_x"))


def ensemble_and(df: DataFrame, first: str = "p_all_hit", second: str = "p_recent_hit") -> DataFrame:
    """Signal only when both models say yes; no signal when either has no answer."""
    both = (F.col(first) == 1) & (F.col(second) == 1)
    return df.withColumn("signal", F.coalesce(both, F.lit(False)).cast("int"))


def score(df: DataFrame, train_all: DataFrame, train_recent: DataFrame,
          all_layers: Layers, recent_layers: Layers) -> DataFrame:
    """Normalize by each training set, score with its model, AND the decisions.

    ``train_*`` are either feature tables or their stored one-row statistics.
    """
    def stats(t: DataFrame) -> DataFrame:
        return t if f"{SCORED[0]}__mean" in t.columns else feature_stats(t)

    keys = [c for c in df.columns if c not in SCORED]
    step = mlp_score(df, all_layers, "p_all", stats=stats(train_all))
    step = mlp_score(step, recent_layers, "p_recent", stats=stats(train_recent))
    return ensemble_and(step.select(*keys, "p_all", "p_all_hit", "p_recent", "p_recent_hit"))


def train(df: DataFrame, columns: list[str] = SCORED, max_iter: int = 20, kind: str = "logistic"):
    """A ``pyspark.ml`` pipeline on the hard label ``y``: means for missing values, vector, standardize,
    classify. Every row gets a probability.

    ``mlp`` is Spark's own perceptron (sigmoid hidden units, softmax output), which is a
    different network from the one ``mlp_score`` evaluates.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    known = [f"{c}__known" for c in columns]
    parts = [Imputer(inputCols=columns, outputCols=known),
             VectorAssembler(inputCols=known, outputCol="raw"),
             StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    if kind == "logistic":
        parts.append(LogisticRegression(labelCol="y", maxIter=max_iter))
    elif kind == "mlp":
        parts.append(MultilayerPerceptronClassifier(
            labelCol="y", layers=[len(columns), 128, 128, 2], maxIter=max_iter, seed=7))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return Pipeline(stages=parts).fit(df.withColumn("y", F.col("y").cast("double")))
