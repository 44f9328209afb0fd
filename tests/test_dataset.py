"""Balance, statistics, profile, folds, augmentation and scoring."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from barloom.operators import dataset as D, scoring as M
from barloom.schemas import SCORED
from tests.helpers import make_bars


def labels(spark, pos, neg):
    return spark.createDataFrame([(1,)] * pos + [(0,)] * neg, "y int")


@pytest.mark.parametrize("pos, neg, k", [(10, 5, 0), (10, 30, 0), (10, 55, 2), (10, 65, 4), (2, 11, 2), (3, 18, 3)])
def test_balance_copies(spark, pos, neg, k):
    """neg/pos - 3 = 2.5 gives 2 and 3.5 gives 4: half to even."""
    got = D.class_counts(D.balance(labels(spark, pos, neg))).first()
    assert (got.n_pos, got.n_neg) == (pos * (1 + k), neg)


def test_balance_without_positives_stops(spark):
    with pytest.raises(Exception, match="no positive rows"):
        D.balance(labels(spark, 0, 5)).collect()


def test_zscore_has_mean_0_and_std_1(spark):
    df = spark.range(100).select(*[(F.col("id") * (i + 1) % 37 + i).cast("double").alias(c) for i, c in enumerate(SCORED)])
    z = D.zscore(df, D.feature_stats(df))
    m = z.agg(F.max(F.abs(F.lit(0.0))).alias("x"), *[F.avg(c).alias(c) for c in SCORED[:5]],
              *[F.stddev_samp(c).alias("s" + c) for c in SCORED[:5]]).first()
    assert all(abs(m[c]) < 1e-9 and abs(m["s" + c] - 1) < 1e-9 for c in SCORED[:5])
    flat = df.withColumn(SCORED[0], F.lit(3.0))
    assert D.zscore(flat, D.feature_stats(flat)).filter(F.col(SCORED[0]).isNotNull()).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.just(float("nan")), st.integers(-3, 3).map(float),
                          st.floats(-1e6, 1e6)), min_size=1, max_size=80),
       st.sampled_from([2, 4, 256]))
def test_profile_equals_pandas(spark, values, slices):
    df = spark.createDataFrame([(v, 1.0) for v in values], "a double, b double").repartition(3)
    got = {r.feature: r for r in D.profile(df, ["a", "b"], slices).collect()}
    clean = np.array([v for v in values if v is not None and v == v])
    assert got["a"]["count"] == len(clean) and got["b"].q50 == 1.0
    if len(clean):
        for name, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            assert got["a"][name] == pytest.approx(np.quantile(clean, q), rel=1e-9, abs=1e-9)


def test_profile_with_one_value_in_a_third_of_the_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 0.001).alias("a"))
    r = D.profile(df, ["a"], 64).first()
    want = df.toPandas().a.quantile([0.25, 0.5, 0.75]).tolist()
    assert [r.q25, r.q50, r.q75] == pytest.approx(want)


def test_walk_forward_has_no_overlap_in_time(spark):
    days = spark.sql("SELECT explode(sequence(date'2023-01-01', date'2024-12-31')) AS session")
    folds = D.walk_forward(days, "2023-01-01", 6).groupBy("fold", "role").agg(
        F.min("session").alias("lo"), F.max("session").alias("hi")).collect()
    by = {(r.fold, r.role): r for r in folds}
    assert len(by) == 12
    for f in (1, 2, 3, 4):
        assert by[f, "train"].hi < by[f, "validate"].lo and by[f, "validate"].hi < by[f, "test"].lo


def test_augment_is_repeatable_and_small(spark):
    bars = make_bars(spark, [100.0] * 40)
    a = D.augment(bars.repartition(5)).orderBy("bar_ts", "shift").collect()
    b = D.augment(bars.repartition(2)).orderBy("bar_ts", "shift").collect()
    assert a == b and len(a) == 5 * 40 - 6
    noise = np.array([r.close / 100 - 1 for r in a])
    assert 0.0005 < noise.std() < 0.002 and len({r.close for r in a}) > 150
    assert D.augment(bars, seed="b").orderBy("bar_ts", "shift").first().close != a[0].close


def net(seed):
    r = np.random.default_rng(seed)
    return [(r.normal(size=(128, 40)) / 6, r.normal(size=128)), (r.normal(size=(128, 128)) / 11, r.normal(size=128)),
            (r.normal(size=(1, 128)), r.normal(size=1))]


def test_mlp_equals_numpy_and_skips_missing(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(50, 40))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", *SCORED])
    (w1, b1), (w2, b2), (w3, b3) = layers = net(1)
    h = np.tanh(x @ w1.T + b1) @ w2.T + b2
    h = np.where(h > 0, h, 0.05 * h)
    want = 1 / (1 + np.exp(-(h @ w3.T + b3)))[:, 0]
    got = M.mlp_score(df, layers).orderBy("id").select("p", "p_hit").toPandas()
    np.testing.assert_allclose(got.p, want, rtol=1e-9)
    assert list(got.p_hit) == list((want > 0.5).astype(int))
    hole = df.withColumn(SCORED[2], F.when(F.col("id") > 0, F.col(SCORED[2])))
    first = M.ensemble_and(M.mlp_score(hole, layers).withColumn("q_hit", F.lit(1)), "p_hit", "q_hit").orderBy("id").first()
    assert first.p is None and first.signal == 0


def test_train_both_kinds(spark):
    df = spark.range(200).select(((F.col("id") % 10) / 10.0).alias("a"), ((F.col("id") % 7) / 7.0).alias("b"),
                                 (F.col("id") % 10 > 4).cast("int").alias("y"))
    for kind in ("logistic", "mlp"):
        model = M.train(df, ["a", "b"], max_iter=15, kind=kind)
        right = model.transform(df).filter(F.col("prediction") == F.col("y")).count()
        assert right > 160
    with pytest.raises(ValueError):
        M.train(df, ["a"], kind="tree")


def test_profile_recovers_from_a_sketch_that_missed(spark, monkeypatch):
    monkeypatch.setattr(D, "SKETCH", 8)
    monkeypatch.setattr(D, "RANK_ERROR", 1e-4)
    df = spark.range(20000).select(F.sin(F.col("id")).alias("a"), F.lit(None).cast("double").alias("b")).repartition(4)
    a, b = D.profile(df, ["a", "b"], 50).collect()
    want = df.toPandas().a.quantile([0.25, 0.5, 0.75]).tolist()
    assert [a.q25, a.q50, a.q75] == pytest.approx(want, rel=1e-12) and b["count"] == 0 and b.q50 is None
