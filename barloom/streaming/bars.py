"""Streaming bars, premarket range and their sinks."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.columns import sequence_key
from ..operators import KEYS
from ..runtime import drop_folder, folders, get_text, put_text


def stream_ohlcv(ticks: DataFrame, seconds: int, origin: int = 0, watermark: str = "1 hour",
                 premarket: Column | None = None) -> DataFrame:
    """Tumbling OHLCV bars; ``origin`` shifts the grid off the clock, as a feed started at
    an odd second would. Partial aggregation runs before the state shuffle."""
    key = sequence_key("ts", "event_id")
    win = F.window("ts", f"{seconds} seconds", f"{seconds} seconds", f"{origin} seconds")
    out = (ticks.withWatermark("ts", watermark)
           .groupBy(*KEYS, win.alias("w"))
           .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"),
                F.min("price").alias("low"), F.max_by("price", key).alias("close"),
                F.sum("vol").alias("volume"))
           .select(*KEYS, F.col("w.start").alias("bar_ts"), "open", "high", "low", "close", "volume"))
    return out if premarket is None else out.withColumn("is_premarket", premarket)


def stream_quote_bars(quotes: DataFrame, seconds: int, watermark: str = "1 hour", counted: bool = False) -> DataFrame:
    """Price bars with the cumulative counter at both ends of the bar; failed polls, which
    carry no price, add nothing. ``counted`` adds the number of quotes, for ``late_quotes``."""
    key = sequence_key("ts", "seq")
    number = [F.count(F.lit(1)).alias("n_quotes")] if counted else []
    return (quotes.filter(F.col("last_price").isNotNull()).withWatermark("ts", watermark)
            .groupBy(*KEYS, F.window("ts", f"{seconds} seconds").alias("w"))
            .agg(F.min_by("last_price", key).alias("open"), F.max("last_price").alias("high"),
                 F.min("last_price").alias("low"), F.max_by("last_price", key).alias("close"),
                 F.min_by("total_volume", key).alias("total_open"),
                 F.max_by("total_volume", key).alias("total_close"), *number)
            .select(*KEYS, F.col("w.start").alias("bar_ts"), "open", "high", "low", "close",
                    "total_open", "total_close", *(["n_quotes"] if counted else [])))


def stream_premarket(ticks: DataFrame, open_minute: int, watermark: str = "1 hour") -> DataFrame:
    """Premarket high and low per ticker and day, frozen at the open: later ticks do not
    count, and the day's state is dropped once the watermark has passed it."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    pre = minute < open_minute
    return (ticks.withWatermark("ts", watermark)
            .groupBy("ticker", F.window("ts", "1 day").alias("w"))
            .agg(F.max(F.when(pre, F.col("price"))).alias("pm_high"),
                 F.min(F.when(pre, F.col("price"))).alias("pm_low"))
            .select("ticker", F.to_date("w.start").alias("session"), "pm_high", "pm_low"))


# ---------------------------------------------------------------- sinks

def run_available(stream: DataFrame, path: str, checkpoint: str, by: str | None = None) -> StreamingQuery:
    """Append what has landed to Parquet, one folder per value of ``by``, and stop."""
    writer = stream.writeStream.outputMode("append").format("parquet")
    if by:
        writer = writer.partitionBy(by)
    q = (writer.option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_foreach(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
                mode: str = "update", **trigger) -> StreamingQuery:
    q = (stream.writeStream.outputMode(mode).foreachBatch(fn)
         .option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})).start())
    if not trigger or trigger.get("availableNow"):
        q.awaitTermination()
    return q


def upsert_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: each batch owns a folder it overwrites, so a replayed batch
    changes nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of each key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


POINTER = "_newest"        # names the newest whole version; Spark's readers skip such files


def snapshot_batch(path: str, key: str = "ticker", ts: str = "bar_ts", keep: int = 3,
                   keep_seconds: float = 600.0) -> Callable[[DataFrame, int], None]:
    """Sink keeping the newest row per ticker. The version that the pointer names is merged
    with the batch into a new folder, and the pointer moves once that folder is whole.

    A crash before the move leaves readers on the old version, and the replayed batch
    overwrites the half-written folder; a batch replayed after the move changes nothing.
    Versions beyond the newest ``keep`` go when they are older than ``keep_seconds``, the
    time that a reader may need: with a batch every second, some 600 small folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = get_text(spark, f"{path}/{POINTER}")
        if before is not None and int(before) >= batch_id:
            return
        rows = batch
        if before is not None:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/version={before}"))
        values = [c for c in batch.columns if c not in (key, ts)]
        (rows.groupBy(key).agg(F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in values])
         .write.mode("overwrite").parquet(f"{path}/version={batch_id}"))
        put_text(spark, f"{path}/{POINTER}", str(batch_id))
        old = sorted(((int(name.split("=")[1]), age) for name, age in folders(spark, path) if name.startswith("version=")))
        for version, age in old[:-keep]:
            if age > keep_seconds:
                drop_folder(spark, f"{path}/version={version}")
    return write


def write_snapshot(stream: DataFrame, path: str, checkpoint: str, keep: int = 3, keep_seconds: float = 600.0,
                   **trigger) -> StreamingQuery:
    return run_foreach(stream, snapshot_batch(path, keep=keep, keep_seconds=keep_seconds), checkpoint, "append", **trigger)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The version that the pointer names; no other folder is listed or read."""
    return spark.read.parquet(f"{path}/version={get_text(spark, f'{path}/{POINTER}')}")


class LateRows(StreamingQueryListener):
    """One number per batch and query: rows that a watermark has dropped.

    Spark's own list of progress reports ends at 100; this keeps a number for every batch that
    ran since ``watch``. Rows are dropped after the partial aggregation, so several late quotes
    of one bar in one task are one row here; ``late_quotes`` counts quotes.
    """

    def __init__(self) -> None:
        self.by_batch: dict[tuple[str, int], int] = {}
        self.ended: dict[str, threading.Event] = {}

    @classmethod
    def watch(cls, spark: SparkSession) -> LateRows:
        listener = cls()
        spark.streams.addListener(listener)
        return listener

    def onQueryStarted(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.by_batch[str(p.runId), p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def total(self, query: StreamingQuery, wait: float = 30.0) -> int:
        """All rows dropped in this run. Reports come in order, so that of a query that has ended
        is complete when its end has been told."""
        run = str(query.runId)
        if not query.isActive and not self.ended.setdefault(run, threading.Event()).wait(wait):
            raise TimeoutError(f"the end of run {run} was not reported within {wait} seconds")
        return sum(n for (r, _), n in self.by_batch.items() if r == run)


def late_quotes(landed: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """Per closed bar, the landed quotes with a price that are not in it: they came after the
    watermark had passed. ``bars`` come from ``stream_quote_bars(.., counted=True)``.

    Quotes are counted per bar before the shuffle. A bar start later than the newest one
    of ``bars`` is still open and is left out.
    """
    start = F.window("ts", f"{seconds} seconds").start
    seen = (landed.filter(F.col("last_price").isNotNull()).groupBy(*KEYS, start.alias("bar_ts"))
            .agg(F.count(F.lit(1)).alias("n_landed")))
    return (seen.filter(F.col("bar_ts") <= bars.agg(F.max("bar_ts")).scalar())
            .join(bars.select(*KEYS, "bar_ts", "n_quotes"), [*KEYS, "bar_ts"], "left")
            .withColumn("n_late", F.col("n_landed") - F.coalesce("n_quotes", F.lit(0)))
            .filter("n_late > 0").select(*KEYS, "bar_ts", "n_landed", "n_late"))


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark has dropped, over the progress reports that Spark has kept: the last
    100. For longer runs use ``LateRows``."""
    return sum(op.numRowsDroppedByWatermark
               for p in query.recentProgress for op in p.stateOperators)
