"""Bars, sessions and features on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from barloom.functions import columns as C
from barloom.operators import bars as B, features as FE, labels as L, sessions as S
from tests.helpers import DAY, at, make_bars


def one(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_ties_follow_sequence(spark):
    ticks = spark.createDataFrame(
        [("T", DAY, at(600), p, 1, i) for p, i in ((3.0, 7), (1.0, 2), (2.0, 9), (5.0, 4))],
        "ticker string, session date, ts timestamp, price double, vol long, event_id long")
    for parts in (1, 3):
        got = B.ohlcv(ticks.repartition(parts), 300).first()
        assert (got.open, got.high, got.low, got.close, got.volume) == (1.0, 5.0, 1.0, 2.0, 4)


def test_origin_shifts_grid(spark):
    ts = spark.createDataFrame([(at(600),)], "ts timestamp")
    assert ts.select(C.bucket_start("ts", 300, 97)).first()[0] == at(596).replace(second=37, minute=56)


def test_rollup_equals_direct(spark, small):
    from barloom.sources import adapters as A
    direct = B.ohlcv(A.ticks(spark, small), A.COARSE, A.is_premarket())
    rolled = A.bars(spark, small).select(direct.columns)
    assert direct.exceptAll(rolled).count() == 0 and rolled.exceptAll(direct).count() == 0


def test_locf_fills_long_pause(spark):
    bars = make_bars(spark, [10, 11]).withColumn(
        "bar_ts", F.when(F.col("close") == 11, F.lit(at(620))).otherwise(F.col("bar_ts")))
    got = one(B.locf(bars, 300).orderBy("bar_ts"), "bar_ts", "close", "volume", "is_filled")
    assert got == [(at(600), 10.0, 100, False), (at(605), 10.0, 0, True), (at(610), 10.0, 0, True),
                   (at(615), 10.0, 0, True), (at(620), 11.0, 100, False)]


def test_volume_match_by_chance_and_never(spark):
    ext = make_bars(spark, [1] * 6, volumes=[5, 9, 7, 9, 8, 6])
    reg = ext.filter(F.col("bar_ts") >= F.lit(at(615)))
    assert S.premarket_limit(ext, reg).first().premarket_limit == 1      # an earlier bar matches
    other = reg.withColumn("volume", F.lit(1000).cast("long"))
    assert S.premarket_limit(ext, other).first().premarket_limit == 5    # none: last position
    split = S.tag_session_by_volume(ext, reg).orderBy("bar_ts")
    assert [r.is_premarket for r in split.collect()] == [True] + [False] * 5


@pytest.mark.parametrize("n, last", [(24, 21), (25, 21), (26, 22), (20, 19)])
def test_anchor_range(spark, n, last):
    """round(n/2)+10 is half to even: 25 bars end at 21 like 24."""
    got = S.anchors(make_bars(spark, [10.0] * n)).agg(F.min("i"), F.max("i")).first()
    assert tuple(got) == (8, min(last, n - 1))


@pytest.mark.parametrize("path, y", [
    ([100, 105, 90, 90], 1.0), ([100, 104.9, 94, 200], 0.0), ([100, 100, 100, 105], 1.0),
    ([100, 95, 200, 200], 0.0), ([100, 101, 101, 102], 0.7), ([100, 100, 100, 100], 0.5),
    ([100, 106], 1.0), ([100, 101], None), ([100], None)])
def test_barrier_label(spark, path, y):
    got = L.barrier_label(make_bars(spark, path)).orderBy("bar_ts").first().y
    assert got == (None if y is None else pytest.approx(y))


def test_label_needs_no_bar_after_a_hit_only(spark):
    got = L.barrier_label(make_bars(spark, [100, 101, 110])).orderBy("bar_ts").first().y
    assert got == 1.0


def test_strict_event_drops_whole_session(spark):
    bars = L.barrier_label(make_bars(spark, [100] * 6))
    assert L.keep_complete(bars, ["y"]).count() == 3
    assert L.keep_complete(bars, ["y"], strict_event=True).count() == 0


def test_binarize_edges_and_idempotence(spark):
    df = spark.createDataFrame([(0.7,), (0.69,), (float("nan"),), (None,), (1.0,)], "y double")
    once = L.binarize(df)
    assert [r.y for r in once.collect()] == [1, 0, 0, 0, 1]
    assert L.binarize(once).collect() == once.collect()


def test_pressure_formula_and_zero_open(spark):
    df = make_bars(spark, [10.5, 1.0], opens=[10.0, 0.0], highs=[11.0, 1.0], lows=[9.5, 0.0], volumes=[200, 1])
    out = FE.with_pressure(df.withColumn("float_shares", F.lit(1000.0))).orderBy("bar_ts").collect()
    u = ((10.5 - 9.5) - (11.0 - 10.5)) / 10.0 * 1000
    assert out[0].u == u and out[0].w == u * (200 / 1000.0 * 100) and out[0].sq == out[0].w ** 2
    assert out[1].u is None and out[1].w is None
    live = FE.with_pressure(df.withColumn("float_shares", F.lit(1000.0)), zero_on_failure=True)
    assert live.orderBy("bar_ts").collect()[1].w == 0.0


def test_premarket_ratios(spark):
    bars = make_bars(spark, [10, 12, 11, 13], premarket=2, highs=[10, 12, 11.5, 13], lows=[9, 11, 10.5, 12])
    row = FE.premarket_ratios(FE.with_premarket(bars)).orderBy("bar_ts").collect()[2]
    assert row.pm_high_ratio == pytest.approx(1 - 11.5 / 12) and row.pm_low_ratio == pytest.approx(1 - 9 / 11.5)
    none = FE.premarket_ratios(FE.with_premarket(make_bars(spark, [10, 11]))).first()
    assert none.pm_high_ratio is None and none.pm_low_ratio is None
    live = FE.premarket_ratios(FE.with_premarket(make_bars(spark, [10, 11])), "live", price="close").first()
    assert live.pm_high_ratio == 0.0


def test_running_range_excludes_or_includes_the_bar(spark):
    bars = make_bars(spark, [10, 12, 11])
    assert one(FE.running_range(bars).orderBy("bar_ts"), "day_high") == [(None,), (10.0,), (12.0,)]
    assert one(FE.running_range(bars, True).orderBy("bar_ts"), "day_high") == [(10.0,), (12.0,), (12.0,)]


def test_even_quantity(spark):
    prices = [25.0, 10.0, 3.0, 1000.0, 7.0]       # round(25/10) = 2, half to even
    got = spark.createDataFrame([(p,) for p in prices], "p double").select(C.even_quantity("p")).collect()
    assert [r[0] for r in got] == [2, 4, 10, 2, 6]


def test_abandon_keeps_the_weak_bar(spark):
    bars = make_bars(spark, [12, 10.5, 12], opens=[12, 10.5, 12]).withColumn("prev_close", F.lit(10.0))
    assert [r.close for r in S.until_abandoned(bars).orderBy("bar_ts").collect()] == [12.0, 10.5]


def test_merge_prefers_priority(spark):
    a, b = make_bars(spark, [1, 2]), make_bars(spark, [5, 6, 7])
    got = B.merge_bars(("a", a), ("b", b), priority=["a", "b"]).orderBy("bar_ts")
    assert one(got, "close", "vendor") == [(1.0, "a"), (2.0, "a"), (7.0, "b")]


def test_range_join_bounds(spark):
    bars = make_bars(spark, list(range(1, 61)), step=1)
    log = spark.createDataFrame([("T", at(610)), ("T", at(615)), ("X", at(610))], "ticker string, start_ts timestamp")
    got = S.event_window(bars, log, 600).groupBy("start_ts").agg(F.min("bar_ts"), F.max("bar_ts"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == [(at(610), at(610), at(619), 10), (at(615), at(615), at(624), 10)]


def test_facts_asof_and_context(spark):
    bars = make_bars(spark, [1, 2, 3])
    facts = spark.createDataFrame([("T", "2024-03-01", 0.1, "2024-02-20"), ("T", "2024-03-05", 0.9, "2024-03-05")],
                                  "ticker string, as_of string, short_ratio double, earnings_date string")
    facts = facts.withColumns({c: F.to_date(c) for c in ("as_of", "earnings_date")})
    got = S.with_facts_asof(bars, facts).first()
    assert got.short_ratio == 0.1 and got.days_since_earnings == 13
    ctx = make_bars(spark, [7], ticker="I").select("session", "bar_ts", F.col("close").alias("x"))
    assert [r.x for r in S.with_context(bars, ctx).collect()] == [7.0] * 3


def test_align_modes_agree_on_dense_bars(spark):
    fine = make_bars(spark, [10 + (k * 7 % 5) for k in range(60)], opens=[10] * 60, step=1)
    coarse = B.rollup_bars(fine, 300)
    pressed = FE.with_pressure(fine.withColumn("float_shares", F.lit(1e6)))
    results = []
    for mode in ("asof", "bucket", "ratio"):
        out = FE.align_fine(coarse, pressed, 300, 60, mode).orderBy("bar_ts")
        results.append(one(out, "f1_5_u", "f1_3_w", "f1_1_sq"))
    assert results[0] == results[1] == results[2] and len(results[0]) == 12


def test_features_do_not_look_ahead(spark):
    from barloom.plans.training import feature_frame
    from barloom.schemas import FEATURES
    closes = [10 + (k * 13 % 17) / 10 for k in range(150)]
    fund = spark.createDataFrame([("T", 20.0, 5.0, 1e6)], "ticker string, high52 double, low52 double, float_shares double")

    def at_bar(cs):
        fine = make_bars(spark, cs, start=540, step=1, premarket=30, opens=[10.0] * 150)
        return feature_frame(fine, fund, 300).filter(F.col("i") == 10).select(FEATURES).first()

    cut = 30 + 11 * 5                              # first fine bar after anchor 10
    assert at_bar(closes) == at_bar(closes[:cut] + [99.0] * (150 - cut))
    assert at_bar(closes) != at_bar(closes[:cut - 8] + [99.0] * (158 - cut))
