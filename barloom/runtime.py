"""Session helpers: shared scratch space and settings the jobs rely on."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets one temporary
    folder per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="barloom-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole or not at all: written beside ``path``, then renamed over it."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target, part = fs.Path(path), fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    store = part.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(part, target, option)


def get_text(spark: SparkSession, path: str) -> str | None:
    """What ``put_text`` wrote last, or None."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return None
    stream = store.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def folders(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since its last change) of each folder directly below ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(target) if store.exists(target) else []
    return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000) for f in found if f.isDirectory()]


def drop_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df, name: str):
    """Write ``df`` to the shared folder and read it back: lineage is cut, and an
    executor lost later costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
