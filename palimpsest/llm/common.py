"""What the training-data operators share: scratch tables, tables, size-checked broadcasts."""

from __future__ import annotations

import functools
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: a run without ASCII white space. bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # tests and single machines only
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/palimpsest-{uuid.uuid4().hex}/{name}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(), "palimpsest.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(path)
    sc._palimpsest_shipped = True


_KEPT: list = []


def kept_by_worker(f):
    """functools.cache for what a worker keeps from one task to the next, until a task of another module makes room."""
    f = functools.cache(f)
    _KEPT.append(f)
    return f


def make_room(module: str) -> None:
    """Drops what modules other than this one keep in the process: Spark's Python workers live on from one stage to the next."""
    others = [f for f in _KEPT if f.__module__ != module and f.cache_info().currsize]
    for f in others:
        f.cache_clear()
    if others:
        gc.collect()  # caches and what fills them refer to each other
        pa.default_memory_pool().release_unused()


#: Rows and bytes that go to and from Python at a time: whole texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches that are bounded by rows and bytes; both are settings of the session, and smaller ones stay.

    Each task drops first what other modules' tasks have left in its worker.
    """
    spark = df.sparkSession
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        got = str(spark.conf.get(key))
        if not got.isdigit() or int(got) > most or int(got) == 0:
            spark.conf.set(key, str(most))
    module = run.__module__

    def alone(batches):
        make_room(module)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


#: Shuffle files of a write that has ended are of no use; Spark keeps them until the driver collects its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path, was = scratch(spark, name), spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, was)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the table that materialize wrote for df, once nothing reads it any more. Files elsewhere are left alone."""
    spark = df.sparkSession
    for folder in {m[0] for f in df.inputFiles() if (m := re.match(r".*/palimpsest-[0-9a-f]{32}(?=/)", f))}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)
