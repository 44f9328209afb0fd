"""Streaming sources: files that land in a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import QUOTES
from .adapters import EVENTS, as_ticks


def stream_quotes(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Quotes landing as JSON lines; one file per poll or per batch of polls."""
    reader = spark.readStream.schema(QUOTES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).withColumn("session", F.to_date("ts"))


def stream_ticks(spark: SparkSession, sf_dir: str, closing_path: str | None = None) -> DataFrame:
    """The events table as a tick stream.

    ``closing_path`` holds an end-of-feed row in the same schema; being newer than all
    ticks it moves the watermark past the last open bar and never closes a bar itself.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")
    if closing_path:
        source = source.unionByName(spark.readStream.schema(EVENTS).parquet(closing_path))
    return as_ticks(source)


def write_closing(spark: SparkSession, path: str, ts: str = "9000-01-01 00:00:00") -> str:
    spark.sql(f"""SELECT cast(0 as bigint) event_id, timestamp_ntz'{ts}' ts, cast(0 as bigint) user_id,
                         '' event_type, 0.0D value, '{{"k": 0}}' props""").write.parquet(path)
    return path
