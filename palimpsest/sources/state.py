"""Memories on disk: notes and edges as Parquet tables with the settings that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings

VERSION = "memory_tables_v1"


def save(notes: DataFrame, edges: DataFrame, path: str, settings: Settings) -> None:
    """The metadata goes last: a memory without it counts as unfinished."""
    notes.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/notes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = notes.sparkSession.createDataFrame([(VERSION, settings.signature(with_retrieval=False))], "version string, signature string")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str, settings: Settings) -> tuple[DataFrame, DataFrame] | None:
    """notes and edges; None if there is no finished memory of these settings, so that callers build one."""
    try:
        meta = spark.read.schema("version string, signature string").json(f"{path}/meta").first()
        if meta is None or (meta["version"], meta["signature"]) != (VERSION, settings.signature(with_retrieval=False)):
            return None
        return spark.read.parquet(f"{path}/notes"), spark.read.parquet(f"{path}/edges")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return None
        raise


def fingerprint(spark: SparkSession, path: str) -> str:
    """The first 12 hex digits of a file's SHA-1."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha1("content"), 1, 12)).first()[0]
