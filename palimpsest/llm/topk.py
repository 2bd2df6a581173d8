"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length, on a logarithmic scale, and groups are split into buckets of about
BUCKET vectors. The longest vectors give every query a first threshold: its k-th best product with
them. A query's threshold, over its own length and that of a bucket's longest vector, is the cosine
that a vector of the bucket needs at least. Above 1 the bucket is skipped for the query. From
COORDINATE on, the query's largest coordinate bounds the same coordinate of all vectors that can
reach the cosine; below, only the vectors that are too short are left out. What remains is verified
with whole integer products, and each query's best k of all buckets are its result.

Queries go in blocks of about BLOCK. A task takes some blocks and a part of the buckets, pairs them as
Spark's product of two tables does, which stores no pair, and keeps each query's best k so far: their
last one is its next threshold. Vectors are packed in the narrowest integers that hold all components.
Blocks, buckets and parts are bounded; the result is exact whatever the pruning leaves.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part. Missing last components of shorter vectors count as 0. A query's own row is the
rows with its id. A repeated query row gets its results again. An empty table has no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, ship

K, QUERY_EVERY, SCALE = 20, 20, 64
BUCKET, BLOCK, HEAD = 2048, 1024, 4096
#: Blocks that a task takes one after another; bytes of a task's part of the buckets; finds that wait for the next thresholds.
BLOCKS, PART_BYTES, WAITING = 32, 64 << 20, 1 << 17
#: Groups of length for each factor e of the squared length.
LEVELS = 20
COORDINATE = 0.7
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, q, n2): floor(scale * x) and the squared length, of the rows that take part."""
    x = vectors.filter("vec_id IS NOT NULL").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    x = x.filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
    x = x.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))
    return x.withColumn("n2", F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v))


def _matrix(rows: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    out = np.zeros((len(rows), width), np.int64)
    sizes = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _narrowest(least: int, most: int) -> str:
    return next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)


def _pack(width: int, kind: str, key: str):
    """Makes a group's rows one row: key, ids and vectors as binary, the longest first."""

    def run(t: pa.Table) -> pa.Table:
        m, ids = _matrix(t["q"], width), t["vec_id"].to_numpy().astype(np.int64)
        order = np.argsort(-t["n2"].to_numpy(), kind="stable")
        return pa.table({key: t[key].slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "m": pa.array([m[order].astype(kind).tobytes()], pa.binary())})

    return run


def _unpack(ids: pa.Scalar, m: pa.Scalar, width: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(ids.as_buffer(), np.int64)
    return a, np.frombuffer(m.as_buffer(), kind).reshape(len(a), width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows; by floating point where that can't round."""
    largest = lambda m: max(float(m.max(initial=0)), -float(m.min(initial=0)))
    most = largest(a) * largest(b) * a.shape[1]
    if most < 2**24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return a.astype(float) @ b.astype(float).T if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def lengths_of(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(float) ** 2).sum(1))


def reached(q: np.ndarray, theta: np.ndarray, c: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int, dict[int, np.ndarray]]:
    """What a block's queries need of a bucket, the longest vector first, by their thresholds.

    Places of the queries that take the first vectors, how many these are, and for other queries the
    places of the few vectors that can reach the threshold.
    """
    own, any_will_do = lengths_of(q), theta <= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(any_will_do, 0, np.where(own * lengths[0] > 0, theta / (own * lengths[0]), np.inf))
        least = np.where(any_will_do, 0, np.where(own > 0, theta / own * (1 - SLACK), np.inf))
    long_enough = np.searchsorted(-lengths, -least, "right")
    whole, few = local <= 1 + SLACK, {}
    near = np.flatnonzero(whole & (local >= COORDINATE))
    focus = np.argmax(np.abs(q[near].astype(float)), axis=1) if len(near) else near
    # the angle between the coordinate axis and any such vector differs from the query's by that of the local cosine at most
    towards, room = np.arccos(np.clip(q[near, focus] / own[near], -1, 1)), np.arccos(np.minimum(local[near], 1))
    low, high = np.cos(np.minimum(np.pi, towards + room)) - 1e-7, np.cos(np.maximum(0.0, towards - room)) + 1e-7
    for f in np.unique(focus):
        at = c[:, f] / np.maximum(lengths, 1e-300)
        order, some = np.argsort(at, kind="stable"), np.flatnonzero(focus == f)
        first, last = np.searchsorted(at[order], low[some], "left"), np.searchsorted(at[order], high[some], "right")
        for j, x, y in zip(near[some].tolist(), first.tolist(), last.tolist(), strict=True):
            if y - x <= len(c) // 4:
                places = order[x:y]
                few[j], whole[j] = places[places < long_enough[j]], False
    rows = np.flatnonzero(whole)
    return rows, int(long_enough[rows].max(initial=0)), few


class _Best:
    """The k best so far of each query of a block, ties to smaller ids, and the thresholds that they give."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, theta: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        # whole numbers: a float of 2**53 or more may be rounded up, so the one below it counts
        self.theta = np.where(theta > -(2.0**63), np.where(np.abs(theta) < 2**53, theta, np.nextafter(theta, -np.inf)), -(2.0**63)).astype(np.int64)
        #: The id of the k-th best where the threshold is its score: of that score only smaller ids are better.
        self.last = np.full(len(ids), np.iinfo(np.int64).max)
        self.found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        self.waiting = 0

    def _keep(self, slot: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        good = (vec_id != self.ids[slot]) & ((score > self.theta[slot]) | (vec_id < self.last[slot]))
        self.found.append((slot[good], vec_id[good], score[good]))
        self.waiting += int(good.sum())

    def add(self, ids: np.ndarray, c: np.ndarray) -> None:
        """A bucket's vectors."""
        rows, most, few = reached(self.q, self.theta.astype(float), c, lengths_of(c))
        if most:
            s = products(self.q[rows], c[:most])
            i, j = np.divmod(np.flatnonzero(s >= self.theta[rows, None].astype(s.dtype)), most)
            self._keep(rows[i], ids[j], s[i, j].astype(np.int64))
        for slot, places in few.items():
            if len(places):
                s = products(self.q[slot : slot + 1], c[places])[0].astype(np.int64)
                good = s >= self.theta[slot]
                self._keep(np.full(int(good.sum()), slot), ids[places[good]], s[good])
        if self.waiting > WAITING:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        slot, vec_id, score = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((vec_id, -score, slot))
        order = order[np.arange(len(order)) - np.searchsorted(slot[order], slot[order]) < self.k]
        slot, vec_id, score = slot[order], vec_id[order], score[order]
        full = np.flatnonzero(np.bincount(slot, minlength=len(self.ids)) == self.k)
        end = np.searchsorted(slot, full, "right") - 1
        self.theta[full], self.last[full] = score[end], vec_id[end]
        self.found, self.waiting = [(slot, vec_id, score)], 0
        return self.found[0]


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id query_every divides, its k best."""
    ship(vectors.sparkSession)
    v = materialize(integer_vectors(vectors, scale).withColumn("level", F.floor(F.log(F.col("n2") + 1) * LEVELS).cast("int")), "vectors")
    levels = v.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("d"), F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most")).collect()  # as many as there are scales of length
    width = max([1, *(r["d"] for r in levels)])
    kind = _narrowest(min([0, *(r["least"] or 0 for r in levels)]), max([0, *(r["most"] or 0 for r in levels)]))
    head = v.orderBy(F.col("n2").desc(), "vec_id").limit(HEAD).select("vec_id", "q").toArrow()
    head_ids, head_m = head["vec_id"].to_numpy().astype(np.int64), _matrix(head["q"], width).astype(kind)
    parts = v.sparkSession.createDataFrame([(r["level"], -(-r["n"] // BUCKET)) for r in levels], "level int, parts long")
    bucket = (F.col("level").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("bucket")
    buckets = v.join(F.broadcast(parts), "level").select(bucket, "vec_id", "q", "n2").groupBy("bucket").applyInArrow(_pack(width, kind, "bucket"), "bucket long, ids binary, m binary")
    queries = v.filter(F.col("vec_id") % query_every == 0)
    blocks = max(1, -(-queries.count() // BLOCK))
    queries = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), "vec_id", "q", "n2").groupBy("block").applyInArrow(_pack(width, kind, "block"), "block long, ids binary, m binary")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Thresholds, and the squared length below which no vector is long enough for any query of a block."""
        for batch in batches:
            for i in range(batch.num_rows):
                ids, m = _unpack(batch.column(1)[i], batch.column(2)[i], width, kind)
                scores, theta = products(m, head_m), np.full(len(ids), -np.inf)
                for j, own in enumerate(ids):
                    s = scores[j][head_ids != own]
                    if len(s) >= k:
                        theta[j] = np.partition(s, len(s) - k)[len(s) - k]
                need = np.where(theta > 0, theta / np.maximum(lengths_of(m), 1e-300) * (1 - SLACK), 0.0)
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([theta.tobytes()], pa.binary()), pa.array([float(need.min(initial=np.inf)) ** 2])], ["block", "ids", "m", "theta", "need"])

    queries = materialize(map_arrow(queries, first, "block long, ids binary, m binary, theta binary, need double"), "queries")
    n = sum(r["n"] for r in levels)
    # some blocks and a part of the buckets are a task: so many that all cores have some, and none is large
    tasks, bytes_each = 3 * v.sparkSession.sparkContext.defaultParallelism, width * np.dtype(kind).itemsize + 8
    left = max(-(-blocks // BLOCKS), min(blocks, tasks // 3))
    right = max(-(-n * bytes_each // PART_BYTES), min(-(-n // BUCKET), -(-tasks // left)), 1)
    lowest = F.floor(F.log(F.col("need") + 1) * LEVELS) - 1
    wanted = queries.select("block", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), "theta", lowest.alias("lowest")).repartition(left)
    dealt = buckets.select(F.shiftright("bucket", 32).alias("level"), "ids", "m").repartition(right)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None

        def done():
            slot, vec_id, score = best.cut()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), block, np.int64)), *(pa.array(x.astype(np.int64)) for x in (slot, best.ids[slot], vec_id, score))], ["block", "slot", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i] for c in batch.columns]
                if best is None or row[0].as_py() != block:
                    if best is not None:
                        yield done()
                    block, best = row[0].as_py(), _Best(*_unpack(row[1], row[2], width, kind), np.frombuffer(row[3].as_buffer()), k)
                best.add(*_unpack(row[4], row[5], width, kind))
        if best is not None:
            yield done()

    pairs = wanted.join(dealt.hint("shuffle_replicate_nl"), F.col("level") >= F.col("lowest")).select("block", "q_ids", "q_m", "theta", "ids", "m")
    found = map_arrow(pairs, verify, "block long, slot long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "slot").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = K, query_every: int = QUERY_EVERY, scale: int = SCALE) -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % {query_every} = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
