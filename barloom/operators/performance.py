"""Profit reports over trade rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import minutes_between, ratio, scan_gap_bucket

YEAR = 252


def pnl_by_leg(trades: DataFrame) -> DataFrame:
    """Summed percent per leg (1, 2, anything else as 3) and the grand total as leg 0."""
    leg = F.when(F.col("leg").isin(1, 2), F.col("leg")).otherwise(3)
    return (trades.groupBy(leg.alias("_leg")).agg(F.sum("pct").alias("pct"), F.count(F.lit(1)).alias("n"))
            .rollup("_leg").agg(F.sum("pct").alias("sum_pct"), F.sum("n").alias("n_legs"))
            .select(F.coalesce("_leg", F.lit(0)).alias("leg"), "sum_pct", "n_legs"))


def daily_pnl(trades: DataFrame, by: list[str] | None = None, size_pct: float = 10.0) -> DataFrame:
    """Day results in percent of equity, each trade being ``size_pct`` of it."""
    return trades.groupBy(*(by or []), "session").agg(
        (F.sum("pct") * (size_pct / 100.0)).alias("day_pct"), F.count(F.lit(1)).alias("n_trades"))


def with_idle_days(daily: DataFrame, days: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Day results with a row of 0 for each of ``days(session)`` between the first and the last
    day that has trades."""
    keys = by or []
    span = daily.groupBy(*keys).agg(F.min("session").alias("_first"), F.max("session").alias("_last"))
    idle = (span.select(*keys, F.explode(F.sequence("_first", "_last")).alias("session"))
            .join(days.select("session").distinct(), "session", "left_semi")
            .select(*keys, "session", F.lit(0.0).alias("day_pct"), F.lit(0).cast("long").alias("n_trades")))
    return daily.unionByName(idle).groupBy(*keys, "session").agg(
        F.sum("day_pct").alias("day_pct"), F.sum("n_trades").alias("n_trades"))


def equity_curve(trades: DataFrame, by: list[str] | None = None, size_pct: float = 10.0,
                 days: DataFrame | None = None) -> DataFrame:
    """Cumulative day result, high-water mark and drawdown in percent points. The ordered
    windows run over days (after the aggregation), a few hundred rows a year. ``days(session)``,
    for instance an exchange calendar, gives days without trades their row."""
    keys = by or []
    daily = daily_pnl(trades, keys, size_pct)
    days = daily if days is None else with_idle_days(daily, days, keys)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    curve = days.withColumn("equity_pct", F.sum("day_pct").over(w))
    curve = curve.withColumn("peak_pct", F.greatest(F.max("equity_pct").over(w), F.lit(0.0)))
    return curve.withColumn("drawdown_pct", F.col("equity_pct") - F.col("peak_pct"))


def performance(trades: DataFrame, by: list[str] | None = None, size_pct: float = 10.0,
                days: DataFrame | None = None) -> DataFrame:
    """Return, annualized return, Sharpe, Sortino, drawdown, win rate, averages, profit
    factor, duration and trades per day of ``trades(session, entry_ts, exit_ts, pct)``. The figures
    per day and per year count the idle ones of ``days`` too; without it they are of days with trades."""
    keys = by or []
    won, lost = F.col("pct") > 0, F.col("pct") < 0
    per_trade = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg(won.cast("double")).alias("win_rate"),
        F.avg(F.when(won, F.col("pct"))).alias("avg_win"),
        F.avg(F.when(lost, F.col("pct"))).alias("avg_loss"),
        ratio(F.sum(F.when(won, F.col("pct"))), -F.sum(F.when(lost, F.col("pct")))).alias("profit_factor"),
        F.avg(minutes_between("exit_ts", "entry_ts")).alias("avg_minutes"))
    down = F.when(F.col("day_pct") < 0, F.col("day_pct") * F.col("day_pct")).otherwise(0.0)
    curve = equity_curve(trades, keys, size_pct, days)
    per_day = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.sum("day_pct").alias("total_return_pct"),
        (F.avg("day_pct") * YEAR).alias("annual_return_pct"),
        (ratio(F.avg("day_pct"), F.stddev_samp("day_pct")) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"),
        (ratio(F.avg("day_pct"), F.sqrt(F.avg(down))) * F.sqrt(F.lit(float(YEAR)))).alias("sortino"),
        F.min("drawdown_pct").alias("max_drawdown_pct"))
    if keys:
        both = per_trade.join(per_day, keys)
    else:
        # Two one-row results: the second is read as a scalar subquery.
        days = per_day.select(F.struct(*per_day.columns)).scalar()
        both = per_trade.withColumn("_d", days).select("*", "_d.*").drop("_d")
    return both.withColumns({
        "win_loss_ratio": ratio(F.col("avg_win"), -F.col("avg_loss")),
        "trades_per_day": ratio("n_trades", "n_days")})


def trade_distribution(trades: DataFrame, edges: tuple[float, ...] = (25.0, 30.0, 40.0, 50.0)) -> DataFrame:
    """Count and mean percent by hour, by day of week and by gap bucket, each on its own.

    One first aggregate to the (hour, weekday, bucket) cube of at most a few hundred
    cells, then grouping sets over the cells, so the trades themselves are not expanded.
    """
    cells = (trades
             .groupBy(F.hour("entry_ts").alias("hour"), F.dayofweek("session").alias("weekday"),
                      scan_gap_bucket("gap_pct", edges).alias("gap_bucket"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("pct").alias("s")))
    return (cells.groupingSets([["hour"], ["weekday"], ["gap_bucket"]], "hour", "weekday", "gap_bucket")
            .agg(F.sum("n").alias("n_trades"), (F.sum("s") / F.sum("n")).alias("avg_pct")))


def performance_by_fold(trades: DataFrame) -> DataFrame:
    """Per walk-forward window and over all of them (fold 0)."""
    won, lost = F.col("pct") > 0, F.col("pct") < 0
    cells = trades.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pct").alias("s"), F.count_if(won).alias("w"),
        F.sum(F.when(won, F.col("pct")).otherwise(0.0)).alias("g"),
        F.sum(F.when(lost, -F.col("pct")).otherwise(0.0)).alias("l"))
    return (cells.rollup("fold").agg(
                F.sum("n").alias("n_trades"), F.sum("s").alias("sum_pct"),
                (F.sum("w") / F.sum("n")).alias("win_rate"),
                ratio(F.sum("g"), F.sum("l")).alias("profit_factor"))
            .withColumn("fold", F.coalesce("fold", F.lit(0))))


def evaluate(trades: DataFrame, min_win_rate: float = 0.55, min_profit_factor: float = 1.5,
             by: list[str] | None = None) -> DataFrame:
    """Win rate and profit factor against the targets."""
    p = performance(trades, by)
    return p.select(*(by or []), "n_trades", "win_rate", "profit_factor",
                    ((F.col("win_rate") > min_win_rate)
                     & (F.col("profit_factor") > min_profit_factor)).cast("int").alias("passes"))
