"""Ingestion as a stream: turns arrive in micro-batches, sessions close with an end marker.

Every batch is written under its own id, so that a batch which runs again after a failure replaces
what it wrote before. A session that has been closed is not closed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TURNS = "session_id string, turn_idx int, speaker string, text string, is_end boolean"


def turn_notes(turns: DataFrame) -> DataFrame:
    return turns.filter("NOT coalesce(is_end, false)").select("session_id", "turn_idx", "speaker", F.concat(F.lit("Speaker "), "speaker", F.lit(" says: "), F.coalesce("text", F.lit(""))).alias("content"))


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    turn_notes(batch).dropDuplicates(["session_id", "turn_idx"]).write.mode("overwrite").parquet(f"{path}/notes/batch={batch_id}")
    batch.filter("is_end").select("session_id").distinct().write.mode("overwrite").parquet(f"{path}/closed/batch={batch_id}")


def ingest(turns: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return turns.writeStream.foreachBatch(lambda b, i: write_batch(b, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_sessions(spark, path: str) -> DataFrame:
    """Each closed session with its turns in order, once; late turns don't open it again."""
    closed = spark.read.parquet(f"{path}/closed").groupBy("session_id").agg(F.min("batch").alias("closed_in"))
    notes = spark.read.parquet(f"{path}/notes").dropDuplicates(["session_id", "turn_idx"])
    inside = notes.join(closed, "session_id").filter("batch <= closed_in")
    turns = F.array_sort(F.collect_list(F.struct("turn_idx", "content")))
    return inside.groupBy("session_id").agg(F.transform(turns, lambda t: t["content"]).alias("contents"), F.count(F.lit(1)).alias("n"))


def due_for_reclustering(n_episodes: int, n_at_last: int, every: int = 16) -> bool:
    return n_episodes - n_at_last >= every
