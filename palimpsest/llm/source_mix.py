"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target number of words. The words of all targets are cut into equal blocks,
which go to the sources by highest quotients target / (2 k + 1), and a source's blocks to its
shards in the same way, by the shards' sizes. A shard is a seeded share of a source's documents in
seeded order; its words, one document after another, are its blocks. With a quota of q blocks out
of b, a shard is taken q div b times as a whole, and a run of q mod b more blocks, which starts at a
seeded block and wraps around. Since the run is an interval of words, what a document gives
is the length of an overlap and no block has to become a row.

A shard is the unit of work: hot sources have more of them, up to MOST_SHARDS. All of it is
DataFrame expressions and everything is computed from integers, so that reruns agree.

Defined results: null text has size 0; documents of size 0 give 0; null sources are a source of
their own, last in the order. Repeated rows count and give each on their own; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
BUDGET, MOST_REPEATS = 1.5, 2
BLOCK_WORDS, SHARD_WORDS, MOST_SHARDS, SEED = 16, 65_536, 4096, "mix-1"
_ALL = "__all"


def sainte_lague(rows: DataFrame, group: str, key: str, weight: str, seats: str) -> DataFrame:
    """rows and their column ``quota``: each group's seats, by highest quotients weight / (2 k + 1).

    All start with their rounded shares. What is then missing or too much is at most half a
    seat a row, so only the few quotients next to a row's share can matter; their number is linear
    in the rows. Ties go to the smaller key; weights of 0 get nothing.
    """
    w = Window.partitionBy(group)
    total, n = F.sum(F.col(weight)).over(w), F.count(F.lit(1)).over(w)
    share = F.when(total > 0, F.col(weight) * F.col(seats) / total).otherwise(F.lit(0.0))
    rows = rows.withColumns({"__n": n, "__part": F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0)), "__first": F.floor(share + 0.5)})
    rows = rows.withColumn("__d", F.when(total > 0, F.col(seats) - F.sum("__first").over(w)).otherwise(F.lit(0)))
    steps = F.ceil(F.col("__part") * F.col("__n") * 1.5) + 1
    near = rows.filter((F.col("__d") != 0) & (F.col(weight) > 0)).select(group, key, weight, "__first", "__d", F.explode(F.sequence(F.lit(0).cast("long"), steps)).alias("__j"))
    up = F.col("__d") > 0
    k = F.when(up, F.col("__first") + F.col("__j")).otherwise(F.col("__first") - 1 - F.col("__j"))
    near = near.withColumn("__k", k).filter("__k >= 0").withColumn("__q", F.when(up, -F.col(weight) / (2 * F.col("__k") + 1)).otherwise(F.col(weight) / (2 * F.col("__k") + 1)))
    place = F.row_number().over(Window.partitionBy(group).orderBy("__q", F.when(up, F.col(key)).otherwise(-F.col(key))))
    moved = near.withColumn("__place", place).filter("__place <= abs(__d)").groupBy(group, key).agg(F.sum(F.signum("__d")).cast("long").alias("__moved"))
    return rows.join(moved, [group, key], "left").withColumn("quota", (F.col("__first") + F.coalesce("__moved", F.lit(0))).cast("long")).drop("__n", "__part", "__first", "__d", "__moved")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size), one for each source, with src (its place), weight and target.

    The targets are least(most * size, weight * level), with the one level that spends the budget.
    The number of sources is small; they are ranked in one task.
    """
    one = Window.partitionBy(F.lit(1))
    ranked = sources.withColumn("src", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("src") - 1) % len(weights) + 1).cast("int")).cast("long"))
    full = F.col("source_size") * most
    before = one.orderBy(full / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(one) * F.lit(budget) - F.coalesce(F.sum(full).over(before), F.lit(0))) / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("__level", level).withColumn("__level", F.max(F.when(F.col("__level") <= full / F.col("weight"), F.col("__level"))).over(one))
    return ranked.withColumn("target", F.least(full.cast("double"), F.coalesce(F.col("weight") * F.col("__level"), full.cast("double")))).drop("__level")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, block: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    seeded = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = materialize(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), seeded.alias("h")), "sizes")
    sources = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget), "sources")
    n = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)))
    shard = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % n).alias("shard")
    rows = sizes.alias("d").join(small(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("doc_id", "d.source", "size", "h", "src", "source_size", "target", shard)
    blocks = F.floor(F.sum("target").over(Window.partitionBy(F.lit(1))) / block + 0.5).cast("long")
    quotas = sainte_lague(sources.withColumns({_ALL: F.lit(1), "seats": blocks}), _ALL, "src", "target", "seats").select("src", F.col("quota").alias("seats"))
    shards = rows.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"))
    plan = sainte_lague(shards.join(small(quotas), "src"), "src", "shard", "shard_size", "seats")
    b = F.ceil(F.col("shard_size") / block)
    plan = materialize(plan.select("src", "shard", b.alias("b"), F.least(F.col("quota"), MOST_REPEATS * b).alias("quota")), "plan")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("src"), F.col("shard"))), 1, 8), 16, 10).cast("long") % F.greatest(F.col("b"), F.lit(1))
    lo = F.sum("size").over(Window.partitionBy("src", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.join(plan.withColumn("start", start), ["src", "shard"]).withColumn("lo", lo)
    whole, more = F.floor(F.col("quota") / F.greatest(F.col("b"), F.lit(1))), F.col("quota") % F.greatest(F.col("b"), F.lit(1))
    end = F.col("start") + more

    def overlap(first, last):  # of the document's words and the blocks from first to last
        return F.greatest(F.lit(0), F.least(F.col("lo") + F.col("size"), last * block) - F.greatest(F.col("lo"), first * block))

    taken = whole * F.col("size") + overlap(F.col("start"), F.least(end, F.col("b"))) + overlap(F.lit(0), F.greatest(F.lit(0), end - F.col("b")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def oracle(weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, block: int = BLOCK_WORDS, seed: str = SEED, docs: str = "documents") -> str:
    """The same mix in DuckDB's SQL, but with every quotient listed and the blocks handed out by sorting them all."""
    number = lambda h: f"('0x' || substr({h}, 1, 8))::BIGINT"
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
    WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {docs}),
    s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM z GROUP BY source),
    s1 AS (SELECT *, (CASE (src - 1) % {len(weights)} {cases} END)::BIGINT AS weight, {MOST_REPEATS} * source_size AS most FROM s0),
    s2 AS (SELECT *, (sum(source_size) OVER ()::BIGINT * {budget}::DOUBLE - coalesce(sum(most) OVER b, 0)::BIGINT) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::BIGINT AS lev FROM s1
        WINDOW b AS (ORDER BY most / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT *, max(CASE WHEN lev <= most / weight::DOUBLE THEN lev END) OVER () AS level FROM s2),
    s AS (SELECT source, source_size, src, least(most::DOUBLE, coalesce(weight * level, most::DOUBLE)) AS target FROM s3),
    seats AS (SELECT floor(sum(target) / {block} + 0.5)::BIGINT AS seats FROM s),
    q1 AS (SELECT src, target / (2 * k + 1) AS q FROM s, (SELECT unnest(range(0, (SELECT seats FROM seats) + 1)) AS k) WHERE target > 0 AND k <= 2 * target / {block} + 2),
    q2 AS (SELECT src, row_number() OVER (ORDER BY q DESC, src) AS place FROM q1),
    quota AS (SELECT src, count(*)::BIGINT AS seats FROM q2, seats WHERE place <= seats.seats GROUP BY src),
    r AS (SELECT doc_id, z.source, size, h, src, source_size, target, {number('h')} % least({MOST_SHARDS}, greatest(1, ceil(source_size / {SHARD_WORDS}::DOUBLE)))::BIGINT AS shard FROM z JOIN s ON z.source IS NOT DISTINCT FROM s.source),
    sh AS (SELECT src, shard, sum(size)::BIGINT AS shard_size FROM r GROUP BY ALL),
    p1 AS (SELECT sh.src, shard, seats, row_number() OVER (PARTITION BY sh.src ORDER BY shard_size / (2 * k + 1)::DOUBLE DESC, shard) AS place
        FROM sh JOIN quota ON sh.src = quota.src, (SELECT unnest(range(0, (SELECT coalesce(max(shard_size), 0) // {block} * 3 + 10 FROM sh))) AS k) WHERE shard_size > 0 AND k <= 3 * (shard_size // {block}) + 8),
    p2 AS (SELECT src, shard, count(*)::BIGINT AS quota FROM p1 WHERE place <= seats GROUP BY ALL),
    p AS (SELECT sh.src, sh.shard, ceil(shard_size / {block}::DOUBLE)::BIGINT AS b, least(coalesce(quota, 0), {MOST_REPEATS} * ceil(shard_size / {block}::DOUBLE)::BIGINT) AS quota, {number(f"md5('{seed}:' || sh.src || ':' || sh.shard)")} AS h FROM sh LEFT JOIN p2 ON sh.src = p2.src AND sh.shard = p2.shard),
    l AS (SELECT r.*, b, quota, p.h % greatest(b, 1) AS f, sum(size) OVER (PARTITION BY r.src, r.shard ORDER BY r.h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS lo FROM r JOIN p ON r.src = p.src AND r.shard = p.shard),
    e AS (SELECT *, f + quota % greatest(b, 1) AS t FROM l)
    SELECT doc_id, source, size, source_size, target, (quota // greatest(b, 1) * size + greatest(0, least(lo + size, least(t, b) * {block}) - greatest(lo, f * {block}))
        + greatest(0, least(lo + size, greatest(0, t - b) * {block}) - greatest(lo, 0)))::BIGINT AS taken FROM e"""
