"""The evidence packet: candidates in order of their scores, within the layers' quotas, without near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMITS = {"topic": 2, "episode": 5, "turn": 8}


def packet(candidates: DataFrame, limits: dict[str, int] = LIMITS, most_alike: float = 0.85) -> DataFrame:
    """Rows (qid, evidence_id, layer, id, score) from rows (qid, rnk, layer, id, score, toks), a few for each question.

    A fold over a question's ordered candidates; what has been chosen decides on the next one.
    """
    rows = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rnk", "layer", "id", "score", "toks"))).alias("all"))
    item = rows.schema["all"].dataType.simpleString()
    quota = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))

    def take(kept, x):
        full = F.size(F.filter(kept, lambda k: k["layer"] == x["layer"])) >= F.coalesce(quota[x["layer"]], F.lit(0))
        same = F.exists(kept, lambda k: F.when((F.size(k["toks"]) == 0) & (F.size(x["toks"]) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(k["toks"], x["toks"])) / F.greatest(F.lit(1), F.size(F.array_union(k["toks"], x["toks"])))) > most_alike)
        return F.when(full | same, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("all", F.array().cast(item), take)
    out = rows.select("qid", F.posexplode(kept).alias("pos", "x"))
    return out.select("qid", F.concat(F.lit("E"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("evidence_id"), "x.layer", "x.id", F.round("x.score", 6).alias("score"))
