"""Readers for the two nested dialogue formats: whole JSON files in, flat sessions, turns and questions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = "struct<speaker:string,dia_id:string,text:string,img_url:string,blip_caption:string>"
_QA = "struct<question:string,answer:string,evidence:array<string>,category:int>"
_HAYSTACK = "array<struct<question_id:string,question_type:string,question:string,question_date:string,answer:string,answer_session_ids:array<string>,haystack_dates:array<string>,haystack_session_ids:array<string>,haystack_sessions:array<array<struct<role:string,content:string,has_answer:boolean>>>>>"
QUESTION_FIELDS = ("question_id", "question_type", "question", "question_date", "answer", "haystack_dates", "haystack_session_ids", "haystack_sessions")


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each element of the file's list, with its place."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.from_json("value", schema)).alias("pos", "x"))


def kind(spark: SparkSession, path: str, hint: str | None = None) -> str:
    """Which format a file has, by its first element's keys; a hint wins."""
    if hint:
        return hint
    head = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$[0].haystack_sessions").isNotNull().alias("h")).first()
    return "haystack" if head and head["h"] else "samples"


def sample_turns(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sample_id, session_id, date_time, turn_idx, dia_id, speaker, text); sessions without date or turns are dropped.

    Sessions are the keys session_<n> of a conversation; the caption of a shared image becomes part of the text.
    """
    rows = _whole(spark, path, "array<struct<conversation:map<string,string>>>")
    own = rows.select(F.col("pos").cast("string").alias("sample_id"), F.col("x.conversation").alias("c"), F.explode("x.conversation").alias("key", "value"))
    own = own.withColumn("session_id", F.regexp_extract("key", r"^session_(\d+)$", 1)).filter("session_id <> ''")
    own = own.withColumns({"date_time": F.expr("c[concat(key, '_date_time')]"), "turns": F.from_json("value", f"array<{_TURN}>")})
    own = own.filter(F.col("date_time").isNotNull() & (F.col("date_time") != "") & (F.size("turns") > 0))
    own = own.select("sample_id", "session_id", "date_time", F.posexplode("turns").alias("turn_idx", "t"))
    caption = F.concat(F.lit("[Image: "), F.col("t.blip_caption"), F.lit("]"))
    said = F.coalesce("t.text", F.lit(""))
    text = F.when(F.col("t.img_url").isNotNull() & F.col("t.blip_caption").isNotNull(), F.when(said == "", caption).otherwise(F.concat(caption, F.lit(" "), said))).otherwise(said)
    return own.select("sample_id", "session_id", "date_time", "turn_idx", "t.dia_id", "t.speaker", text.alias("text"))


def sample_questions(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path, f"array<struct<qa:array<{_QA}>>>")
    rows = rows.select(F.col("pos").cast("string").alias("sample_id"), F.posexplode("x.qa").alias("qa_idx", "q"))
    return rows.select("sample_id", F.concat_ws("_", "sample_id", "qa_idx").alias("qid"), "q.question", "q.answer", "q.evidence", "q.category")


def haystack_questions(spark: SparkSession, path: str) -> DataFrame:
    """Rows with all question fields; fails on a missing field or on arrays of unequal lengths."""
    x = _whole(spark, path, _HAYSTACK).select(F.col("pos").alias("ord"), "x.*")
    for f in QUESTION_FIELDS:
        x = x.withColumn(f, F.when(F.col(f).isNotNull(), F.col(f)).otherwise(F.raise_error(F.lit(f"missing field {f}")).cast(x.schema[f].dataType)))
    same = (F.size("haystack_dates") == F.size("haystack_session_ids")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    x = x.withColumn("haystack_dates", F.when(same, F.col("haystack_dates")).otherwise(F.raise_error(F.lit("haystack arrays differ in length")).cast("array<string>")))
    return x.withColumn("is_abstention", F.col("question_id").endswith("_abs"))


def haystack_turns(questions: DataFrame) -> DataFrame:
    """Rows (question_id, session_id, session_ord, date_time, turn_idx, dia_id, speaker, text)."""
    s = questions.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_ord", "s"))
    t = s.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), "session_ord", F.col("s.haystack_dates").alias("date_time"), F.posexplode("s.haystack_sessions").alias("turn_idx", "t"))
    return t.select("question_id", "session_id", "session_ord", "date_time", "turn_idx", F.concat_ws("_", "session_id", F.col("turn_idx") + 1).alias("dia_id"), F.col("t.role").alias("speaker"), F.coalesce("t.content", F.lit("")).alias("text"))
