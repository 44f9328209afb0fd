"""Shape of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as driver
from barloom.operators import bars as B, indicators as I
from barloom.sources import adapters as A

QUERIES = driver.queries()
BATCH = ["prj_07_feature_row", "flt_01_event_window", "flt_05_until_abandoned", "flt_07_gap_scan", "jn_01_rejects",
         "jn_02_volume_match", "jn_03_align_ratio", "jn_05_prev_close", "jn_07_context", "jn_07_sector_context",
         "jn_08_facts_asof", "jn_09_restrict_to", "jn_11_entry_paths", "ag_05_profile", "ag_06_pnl_by_leg",
         "ag_08_relative_volume_daily", "ag_11_performance", "ag_12_trade_distribution", "ag_15_cum_volume_ratio",
         "wn_07_locf", "wn_24_proxy_score", "set_02_balance", "src_08_merge_bars", "scr_06_walk_forward",
         "scr_07_augment", "trd_02_exits_spec", "trd_03_non_overlapping", "trd_04_risk_limits", "prj_09_zscore"]


def plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def shuffles(text: str) -> list[str]:
    return re.findall(r"[^t]Exchange (\w+\([^)]*\))", text)


def test_bars_combine_before_the_shuffle(spark, small):
    text = plan(B.ohlcv(A.ticks(spark, small), 1800))
    assert len(shuffles(text)) == 1 and "SortAggregate" not in text
    assert text.count("HashAggregate") == 2
    assert "user_id" not in text                     # not read from the file


def test_one_shuffle_serves_all_indicators(spark, bars):
    text = plan(I.indicators(bars))
    # The exponential means sort anew by block inside the partitions of that one shuffle.
    assert len(shuffles(text)) == 1 and text.count("Sort [") <= 9


def test_one_shuffle_serves_all_features(spark, small):
    from barloom.plans.training import labelled_anchors
    text = plan(labelled_anchors(*A.market(spark, small), A.COARSE))
    assert len(shuffles(text)) == 1
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_risk_limits_prune_before_the_shuffle(spark, small):
    from barloom.catalog.trades import closed
    from barloom.operators.trades import risk_limits
    assert plan(risk_limits(closed(spark, small))).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in text


def test_large_side_tables_are_not_broadcast(spark, bars):
    """Without a size below the threshold the same join runs as sort-merge."""
    from barloom.operators.sessions import with_fundamentals
    fund = bars.groupBy("ticker").agg({"high": "max"}).withColumnRenamed("max(high)", "high52").selectExpr(
        "ticker", "high52", "high52 AS low52", "1.0D AS float_shares")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(with_fundamentals(bars, fund)[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
