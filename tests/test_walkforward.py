"""Walk-forward learning against scikit-free plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import walkforward as W


def tagged(spark, seed=2, n=600):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in (1, 2):
        for role in ("train", "validate", "test"):
            for k in range(n):
                y = int(rng.random() < 0.4)
                a = float(rng.normal(2.0 * y, 1.0))
                rows.append((fold, role, k, None if k % 7 == 0 else a, float("nan") if k % 11 == 0 else float(rng.normal()), None if k % 13 == 0 else y))
    return spark.createDataFrame(rows, "fold int, role string, k int, a double, b double, y int"), rows


def test_every_row_has_a_probability_and_folds_learn(spark):
    df, rows = tagged(spark)
    models = W.fit(df, ["a", "b"])
    scored = W.probabilities(df, models, ["a", "b"]).cache()
    assert scored.count() == len(rows) and scored.filter("p IS NULL OR isnan(p)").count() == 0
    chosen = W.thresholds(scored)
    decided = W.decide(scored, chosen).cache()
    for m in W.metrics(decided).collect():
        mine = [(r.p, r.y, r.hit) for r in decided.filter((F.col("fold") == m.fold) & F.col("y").isNotNull()).collect()]
        pos, neg = [round(p * W.STEPS) for p, y, _ in mine if y], [round(p * W.STEPS) for p, y, _ in mine if not y]
        area = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        assert m.roc_area == pytest.approx(area) and area > 0.85
        assert m.accuracy == pytest.approx(np.mean([y == h for _, y, h in mine])) and m.accuracy > 0.75
        assert m.n_rows == len(mine) and m.n_pos == len(pos)


def test_threshold_is_the_best_on_validation_rows_only(spark):
    df, _ = tagged(spark)
    scored = W.probabilities(df, W.fit(df, ["a", "b"]), ["a", "b"]).cache()
    got = {r.fold: r.threshold for r in W.thresholds(scored).collect()}
    for fold, t in got.items():
        mine = [(min(math.floor(r.p * 100), 99), r.y) for r in scored.filter(f"fold = {fold} AND role = 'validate' AND y IS NOT NULL").collect()]
        right = lambda k: sum((b >= k) == bool(y) for b, y in mine)
        assert right(t) == max(right(k) for k in range(100))


def test_one_class_and_unseen_columns(spark):
    rows = [(1, "train", 1.0, None, 1), (1, "train", 2.0, None, 1), (1, "test", 5.0, 3.0, 0), (1, "test", None, None, None)]
    df = spark.createDataFrame(rows, "fold int, role string, a double, b double, y int")
    scored = W.probabilities(df, W.fit(df, ["a", "b"]), ["a", "b"])
    assert {r.p for r in scored.collect()} == {1.0}
    out = W.decide(scored, W.thresholds(scored)).collect()
    assert len(out) == 2 and all(r.threshold == 50 and r.hit == 1 for r in out)
