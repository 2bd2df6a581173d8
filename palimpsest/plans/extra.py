"""Queries that SQL can't say, or not in a way that holds on large tables, over the same input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.metrics import with_metrics
from ..operators import closest, cluster, packet
from ..operators import evidence as evi
from ..plans import catalog
from ..plans.dialect import plan


def _sql(spark: SparkSession, sf_dir: str, name: str, sql) -> DataFrame:
    catalog.PLANS[name] = sql
    try:
        return catalog.run(spark, sf_dir, name)
    finally:
        del catalog.PLANS[name]


def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of a sample by average linkage over their hashing vectors."""
    from pyspark.sql import functions as F

    rows = _sql(spark, sf_dir, "_episode_vectors", lambda d: plan(*catalog._episode_vectors(d), final="SELECT sample_id, CAST(episode_id AS BIGINT) AS episode_id, CAST(b AS INT) AS b, CAST(c AS DOUBLE) AS c FROM ev"))
    sparse = rows.groupBy("sample_id", "episode_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))
    dense = sparse.select("sample_id", "episode_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
    return cluster.topics(dense)


def evidence_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packet.packet(_sql(spark, sf_dir, "_candidates", lambda d: plan(*evi.candidates(d), final="SELECT qid, rnk, layer, CAST(id AS BIGINT) AS id, score, toks FROM evidence_ranked")))


def rouge_l_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import evaluation as ev

    return with_metrics(_sql(spark, sf_dir, "_pairs", lambda d: plan(*ev.pairs(d), final="SELECT pair_id, pred, ref FROM pairs")))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of this name says the same as a join of all pairs, and is its SQL."""
    return closest.closest(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"cosine_topk": cosine_topk, "topic_clusters": topic_clusters, "evidence_packet": evidence_packet, "rouge_l_bleu": rouge_l_bleu}
