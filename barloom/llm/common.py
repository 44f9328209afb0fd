"""Shared pieces of the corpus operators: table access, Arrow batches, names, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..runtime import scratch_path

#: A word, as every contract counts them: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts do not add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def append_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]],
                   fields: list[T.StructField]) -> DataFrame:
    """``df`` with the columns that ``fn`` makes from each Arrow batch. A column that is
    there already under one of the new names is replaced."""
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([f for f in df.schema if f.name in keep] + fields)
    arrow_types = [arrow_type(f.dataType) for f in fields]

    def run(batches):
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            made = [a if isinstance(a, pa.Array) else pa.array(a, t)
                    for a, t in zip(fn(b), arrow_types)]
            yield pa.RecordBatch.from_arrays(cols + made, names=keep + [f.name for f in fields])

    return map_arrow(df, run, schema)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def texts(batch: pa.RecordBatch, col: str) -> list[str]:
    """The texts of a batch, an empty one for null."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(col)).to_pylist()]


def replace_column(df: DataFrame, name: str, value) -> DataFrame:
    """``withColumn`` that keeps the column's place and leaves the others alone."""
    if name not in df.columns:
        return df.withColumn(name, value)
    return df.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


class WordHashes(dict):
    """64-bit hashes of words, computed once per word; bounded, started anew when full."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of ``n`` words; the whole sequence when shorter."""
    n = min(n, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k:k + m])
    return h


def sha256_hex(col) -> "F.Column":
    return F.sha2(col, 256)


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut there. ``unstore``
    gives the space back once nothing reads it any more."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def unstore(*frames: DataFrame) -> None:
    for df in frames:
        jvm, path = df.sparkSession._jvm, df._stored_at
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; it does so when the driver's
    references to them are collected, which takes it a moment."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)
