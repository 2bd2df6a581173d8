"""A corpus pipeline of five operators: each stage works on all documents that the one before kept.

Quality rejects documents that score below its threshold; near-dedup keeps one document of each
group; PII replaces personal data in the texts; mixing drops and repeats documents towards the
sources' target weights; the last stage encodes what is left as token ids, decodes them again and
returns a row for each document that the mix takes, as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, neardup, pii, quality, source_mix
from palimpsest.llm.common import materialize, small, table

#: A stage of Python on whole texts can't be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.select(*(F.coalesce(n, F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded; at most twice.

    Documents without words are not taken. Rows of one id, or without an id, count together: each
    comes as often as the mix takes their words on the whole. Columns of any name stay as they are.
    """
    key, times, copy = (_free(docs, c) for c in ("id", "times", "copy"))
    took = source_mix.mix(docs.select("doc_id", "text", "source")).groupBy("doc_id").agg(F.sum("size").alias("s"), F.sum("taken").alias("t")).filter("t > 0")
    took = took.select(F.col("doc_id").alias(key), F.floor(F.col("t") / F.col("s") + 0.5).cast("int").alias(times)).filter(F.col(times) > 0)
    took = materialize(took, "times")
    out = docs.join(small(took, 1_000_000), docs["doc_id"].eqNullSafe(F.col(key)))
    return out.select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("quality", classify),
    ("near_dedup", deduplicate),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
