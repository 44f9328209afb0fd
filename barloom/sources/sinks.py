"""Batch writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import even_quantity
from ..operators import KEYS


def write_training(df: DataFrame, path: str, mode: str = "overwrite", by: str | None = "session"
                   ) -> None:
    """Feature or label table as Parquet, one folder per session.

    The rebalance hint lets Spark split a large session over several files and join
    small ones, instead of one task per session or one file per task and session.
    """
    if by is None:
        df.hint("rebalance").write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def history_lines(trades: DataFrame) -> DataFrame:
    """Trade rows in the text format of the trade history."""
    return trades.select(F.concat(
        "ticker", F.lit(" "), F.col("profit").cast("string"),
        F.lit("Time Bought: "), F.col("open_minutes").cast("string"),
        F.lit(" Time Sold: "), F.col("held_minutes").cast("string"),
        F.lit(" Percent: "), F.col("pct").cast("string"),
        F.lit(" SOLD "), F.col("leg").cast("string")).alias("value"))


def append_trades(trades: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "text":
        history_lines(trades).write.mode("append").text(path)
    else:
        trades.write.mode("append").parquet(path)


def log_lines(events: DataFrame) -> DataFrame:
    return events.select(F.concat(
        "ticker", F.lit(" "), F.unix_millis("start_ts").cast("string")).alias("value"))


def append_event_log(events: DataFrame, path: str) -> None:
    log_lines(events).write.mode("append").text(path)


def roll_event_log(log: DataFrame, keep_n: int | None = None, days: int | None = None,
                   added: str = "add_ts") -> DataFrame:
    """The newest ``keep_n`` entries, or those of the last ``days`` before the newest one."""
    if keep_n is not None:
        return log.orderBy(F.col(added).desc(), "ticker").limit(keep_n)
    newest = log.agg(F.max(added).alias("m")).scalar()
    return log.filter(F.col(added) > newest - F.expr(f"INTERVAL {int(days)} DAY"))


def order_log(taken: DataFrame, amount: float = 1000.0, slack: float = 0.001) -> DataFrame:
    """Limit orders of the positions that the account takes: an even number of shares worth about
    ``amount``, with a limit a little above the price of the entry."""
    return taken.select(*KEYS, "entry_ts", "entry_price", (F.col("entry_price") * (1 + slack)).alias("limit_price"),
                        even_quantity("entry_price", amount).alias("quantity"))


def write_order_log(orders: DataFrame, path: str) -> None:
    """Order log of whole sessions, one folder each. A session that is written again replaces its
    own folder and no other, so a replayed batch leaves every order once."""
    (orders.hint("rebalance", "session").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("session").parquet(path))


def write_orders(orders: DataFrame, path: str) -> None:
    """Paper mode: orders go to a file instead of a broker."""
    orders.write.mode("append").parquet(path)
